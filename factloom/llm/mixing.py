"""Mixing sources to target shares of all tokens.

Documents are counted by source and exact token length. The largest total at which every source can still give its share
within its cap of repeats fixes each source's budget. Whole passes over a source come first; of the rest an equal part of
every length is taken, and a bounded-knapsack dynamic program over the lengths (one bit set per step) fills what remains
as exactly as the lengths allow. The driver sees one row per source and distinct length, never a document. Within a
length the documents with the least seeded hashes are taken, so a run can be repeated.

Defined cases: a null text, a null or unlisted source and a document without tokens are left out; sources are compared
trimmed and in lower case; a document row that comes twice counts once; a target of share 0 or cap 0 takes nothing; a
source without documents makes the total 0 unless its share is 0; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEED = 17
#: A first, quick program fills budgets up to this many tokens after the longest documents; it counts only if nothing better is possible.
QUICK = 65_536
#: Documents of one length are ranked in hash buckets of about this many.
BUCKET_ROWS = 50_000
#: Targets the driver holds at most; a larger table is refused, since it would no longer be one of sources.
TARGETS_BOUND = 100_000
#: Fixed value: the public byte-level BPE's pattern, and its meaning on ASCII text for the standard library's engine.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")


class Counter(dict):
    """Token counts of pre-tokens, each encoded once."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(part))
        if len(self) < 1_000_000:
            self[part] = n
        return n

    def tokens(self, text: str) -> int:
        if text.isascii():
            return sum(map(self.__getitem__, _ASCII.findall(text)))
        return len(self.encoding.encode_ordinary(text))


_COUNTERS: dict[str, Counter] = {}


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (plain) and tokens of every document with a text and a source."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        counter = _COUNTERS[vocabulary]
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [counter.tokens(t) for t in batch["text"]]})

    plain = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source")).where("text IS NOT NULL AND source IS NOT NULL AND source <> ''")
    return spread(plain).mapInPandas(count, "doc_id long, source string, tokens long").where("tokens > 0").dropDuplicates(["doc_id"])


def _program(spare: dict[int, int], width: int) -> dict[int, int]:
    """The bounded-knapsack program on a bit set: numbers of each length whose sum is the largest that is not above width."""
    steps = []
    for k in sorted(spare):
        n, power = min(spare[k], width // k), 1
        while n > 0:
            part = min(power, n)
            steps.append((k, part))
            n -= part
            power *= 2
    # Every block's first state is kept; a block's states are made again on the way back, so memory grows with the root of the steps.
    block, mask = max(1, math.isqrt(len(steps))), (1 << (width + 1)) - 1
    reach, kept, done = 1, [], 0
    for done, (k, part) in enumerate(steps):
        if reach >> width & 1:
            break
        if done % block == 0:
            kept.append(reach)
        reach |= (reach << (k * part)) & mask
    else:
        done = len(steps)
    taken: dict[int, int] = {}
    at = reach.bit_length() - 1
    for first in range((len(kept) - 1) * block, -1, -block):
        states = [kept[first // block]]
        inside = steps[first : min(first + block, done)]
        for k, part in inside:
            states.append(states[-1] | (states[-1] << (k * part)) & mask)
        for (k, part), before in zip(reversed(inside), reversed(states[:-1])):
            if not before >> at & 1:
                taken[k] = taken.get(k, 0) + part
                at -= k * part
    return taken


def fill(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes as near below the budget as can be.

    An equal part of every length is fixed first, which keeps the source's mix of lengths and leaves room for at least two
    of the longest documents; what it leaves is filled to the best sum the remaining documents have. A quick filling takes long documents first and runs the program on the rest; if
    it reaches the budget (down to the lengths' common divisor) nothing can be better, otherwise the program covers all.
    """
    total = sum(k * n for k, n in lengths.items())
    if budget >= total:
        return dict(lengths)
    fixed = max(0, budget - 2 * max((k for k in lengths if k <= budget), default=0))
    taken = {k: n * fixed // total for k, n in lengths.items()}
    left = budget - sum(k * n for k, n in taken.items())
    spare = {k: n - taken[k] for k, n in lengths.items() if n > taken[k] and k <= left}
    if left <= 0 or not spare:
        return taken
    step = math.gcd(*spare)
    more: dict[int, int] = {}
    rest = left // step
    spare = {k // step: n for k, n in spare.items()}
    for k in sorted(spare, reverse=True):
        if rest <= QUICK // 2:
            break
        more[k] = min(spare[k], max(0, rest - QUICK // 4) // k)
        rest -= k * more[k]
    if rest <= QUICK:
        for k, n in _program({k: n - more.get(k, 0) for k, n in spare.items() if k <= rest}, rest).items():
            more[k] = more.get(k, 0) + n
    if sum(k * n for k, n in more.items()) < left // step:
        more = _program(spare, left // step)
    for k, n in more.items():
        taken[k * step] += n
    return taken


def plan(lengths: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, dict[int, int]]]:
    """For each source the whole passes and the numbers of documents by length of the last, partial pass."""
    have = {s: sum(k * n for k, n in lengths.get(s, {}).items()) for s in targets}
    if total is None:
        limits = [cap * have[s] / share for s, (share, cap) in targets.items() if share > 0]
        total = int(min(limits, default=0))
    out = {}
    for s, (share, cap) in targets.items():
        budget = min(round(total * share), cap * have[s])
        passes = budget // have[s] if have[s] else 0
        rest = fill(lengths[s], budget - passes * have[s]) if passes < cap and have[s] else {}
        out[s] = (passes, {k: n for k, n in rest.items() if n})
    return out


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, repeats of every document the mixture uses. targets is a small table of one row per source."""
    spark = documents.sparkSession
    docs = written(sized(documents, vocabulary))
    rows = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source IS NOT NULL").limit(TARGETS_BOUND + 1).collect()
    if len(rows) > TARGETS_BOUND:
        raise ValueError(f"more than {TARGETS_BOUND} target sources")
    goal = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in rows}
    lengths: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "tokens").agg(F.count("*").alias("n")).toLocalIterator():
        if r["source"] in goal:
            lengths.setdefault(r["source"], {})[r["tokens"]] = r["n"]
    made = plan(lengths, goal, total)
    rows = [(s, k, passes, rest.get(k, 0)) for s, (passes, rest) in made.items() for k in lengths.get(s, {}) if passes or rest.get(k)]
    quota = spark.createDataFrame(pd.DataFrame(rows, columns=["source", "tokens", "passes", "take"]), "source string, tokens long, passes long, take long")
    # Ranks within a length: whole hash buckets first, then the order within one bucket, so that a length all documents have is not one group.
    buckets = 1 + max((n for by in lengths.values() for n in by.values()), default=0) // BUCKET_ROWS
    docs = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.expr(f"pmod(h, {buckets})"))
    by = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = docs.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    quota = before.join(quota, ["source", "tokens"]).withColumn("more", F.col("take") - F.col("before")).select("source", "tokens", "bucket", "passes", "more", "n")
    ranked = docs.join(quota, ["source", "tokens", "bucket"])
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id"))
    return ranked.withColumn("repeats", F.col("passes") + (rank <= F.col("more")).cast("long")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, tokens and the share reached."""
    used = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    goal = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    joined = goal.join(used, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    whole = joined.agg(F.sum("tokens").alias("all_tokens"))
    return joined.join(whole, F.lit(True)).select("source", "target_share", "max_repeats", "documents", "tokens", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"))
