"""Repetition inside single documents, and n-gram perplexity of documents.

`repeated` counts, in one pass and without a shuffle, the words that lie in a run of N consecutive words with another
place in the same document: the runs' hashes of many documents are sorted together in one array, and equal neighbours
are repeats. `perplexity` scores documents under a modified Kneser-Ney model that Spark counts over the whole corpus.
Perplexity cannot tell the repeated share of a document, so `repeated` does not follow from it (see README).

Words are maximal runs of letters, compared without case. Null texts give no row; a text without words has share 0 and
no perplexity; a document row that comes twice gives one row; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.facts import latest
from ..operators.quantiles import nearest_rank
from ..session import spread, written

RUN, SHARE = 8, 0.5
_WORD = re.compile(r"[^\W\d_]+")
_ASCII = re.compile(r"[a-z]+")
_U = np.uint64
_WORDS = 400_000


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    words = _WORD.findall(text)
    return "\n".join(words).casefold().split("\n") if words else []


def _mix(a: np.ndarray, b) -> np.ndarray:
    x = (a * _U(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shares(documents: list[list[str]], run: int = RUN) -> np.ndarray:
    """For each document the number of words in a run of `run` words that stands at two places of it (places may overlap)."""
    sizes = np.array([len(d) for d in documents])
    starts = np.cumsum(np.append(0, sizes))
    names = np.fromiter((hash(w) for d in documents for w in d), np.int64, int(sizes.sum())).view(_U)
    owner = np.repeat(np.arange(len(documents)), sizes)
    n = len(names) - run + 1
    if n < 1:
        return np.zeros(len(documents), int)
    value = owner[:n].astype(_U)
    for k in range(run):
        value = _mix(value, names[k : k + n])
    whole = owner[:n] == owner[run - 1 :]
    place = np.flatnonzero(whole)
    order = place[np.argsort(value[place], kind="stable")]
    equal = value[order[1:]] == value[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= equal
    again[:-1] |= equal
    cover = np.zeros(len(names) + 1, int)
    at = order[again]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + run, -1)
    covered = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
    return covered[starts[1:]] - covered[starts[:-1]]


def exact_share(words: list[str], run: int = RUN) -> int:
    """The same count for one document from the runs themselves."""
    places: dict[tuple, list[int]] = {}
    for k in range(len(words) - run + 1):
        places.setdefault(tuple(words[k : k + run]), []).append(k)
    marked = bytearray(len(words))
    for at in places.values():
        if len(at) > 1:
            for k in at:
                marked[k : k + run] = b"\x01" * run
    return sum(marked)


def repeated(documents: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, words, repeated_words, share of every document. Every document with a hit is counted again from its runs themselves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def made() -> pd.DataFrame:
            found = shares([w for _, w in held], run)
            for k, (_, words) in enumerate(held):
                if found[k]:
                    found[k] = exact_share(words, run)
            n = np.array([len(w) for _, w in held])
            return pd.DataFrame({"doc_id": [d for d, _ in held], "words": n, "repeated_words": found, "share": found / np.maximum(n, 1)})

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if text is None:
                    continue
                words = words_of(text)
                held.append((doc, words))
                size += len(words)
                if size >= _WORDS:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    return spread(documents.select("doc_id", "text")).mapInPandas(count, "doc_id long, words long, repeated_words long, share double").dropDuplicates(["doc_id"])


# --- modified Kneser-Ney, order 3 -------------------------------------------------------------------------------------

_GRAMS = "three long, context long, two long, middle long, one long, n long"
SHARD_ENTRIES = 1_000_000
#: Least number of tasks the requests to one shard are spread over, and the words one of them may ask for; each holds the shard's array once.
SPREAD, TASK_WORDS = 4, 20_000_000


def _grams(documents: list[list[str]]):
    """Hashes of each document's trigrams, padded with two starts: three words, first two, last two, middle one, last one."""
    import xxhash

    cache: dict[str, int] = {}
    flat, sizes = [], []
    for words in documents:
        flat += [1, 1]
        for w in words:
            if (h := cache.get(w)) is None:
                h = cache[w] = xxhash.xxh64_intdigest(w) | 2
            flat.append(h)
        sizes.append(len(words))
    names = np.array(flat, dtype=_U)
    sizes = np.array(sizes)
    ends = np.cumsum(sizes + 2)
    last = np.concatenate([np.arange(e - s, e) for e, s in zip(ends, sizes)]) if len(sizes) else np.empty(0, int)
    a, b, c = names[last - 2], names[last - 1], names[last]
    context, two = _mix(_mix(a, b), _U(11)), _mix(_mix(b, c), _U(13))
    return _mix(context, c), context, two, b, c, np.repeat(np.arange(len(sizes)), sizes)


def _held(batches: Iterator[pd.DataFrame], size: int):
    ids, held, n = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            if text is not None:
                ids.append(doc)
                held.append(words_of(text))
                n += len(held[-1])
                if n >= size:
                    yield ids, held
                    ids, held, n = [], [], 0
    if held:
        yield ids, held


def counts(documents: DataFrame) -> DataFrame:
    """Counts of all trigrams of the corpus, summed in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, held in _held(batches, 2_000_000):
            *keys, _ = _grams(held)
            _, first, n = np.unique(keys[0], return_index=True, return_counts=True)
            yield pd.DataFrame({k: v[first].view(np.int64) for k, v in zip(("three", "context", "two", "middle", "one"), keys)} | {"n": n})

    return spread(documents.select("doc_id", "text")).mapInPandas(count, _GRAMS).groupBy("three").agg(*(F.first(c).alias(c) for c in ("context", "two", "middle", "one")), F.sum("n").alias("n"))


def _discounts(types: DataFrame, n: str) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of types seen once to four times; four numbers reach the driver."""
    row = types.agg(*(F.count(F.when(F.col(n) == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    some = lambda k, a, b: min(k, max(0.0, k - (k + 1) * y * b / a)) if a else 0.5 * k
    return some(1, n1, n2), some(2, n2, n3), some(3, n3, n4)


def _discounted(n: str, d: tuple[float, float, float]):
    return F.col(n) - F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def _context(types: DataFrame, key: str, n: str, d: tuple[float, float, float], total: str, weight: str) -> DataFrame:
    """Per context: the sum of counts, and the mass its discounts leave for the shorter context."""
    left = F.sum(F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2]))
    return types.groupBy(key).agg(F.sum(n).alias(total), left.alias("left")).select(key, total, (F.col("left") / F.col(total)).alias(weight))


def model(trigrams: DataFrame) -> DataFrame:
    """three, logp: the log probability of the last word of every trigram under interpolated modified Kneser-Ney of order 3."""
    three = _discounts(trigrams, "n")
    two = written(trigrams.groupBy("two").agg(F.first("middle").alias("middle"), F.first("one").alias("one"), F.count("*").alias("n2")))
    twos = _discounts(two, "n2")
    one = two.groupBy("one").agg(F.count("*").alias("n1"))
    sizes = one.agg(F.sum("n1").alias("all"), F.count("*").alias("kinds")).first()
    one = one.select("one", (F.col("n1") / float(sizes["all"] or 1)).alias("p1"))
    second = two.join(_context(two, "middle", "n2", twos, "sum2", "weight2"), "middle").join(one, "one")
    second = second.select("two", (_discounted("n2", twos) / F.col("sum2") + F.col("weight2") * F.col("p1")).alias("p2"))
    full = trigrams.join(_context(trigrams, "context", "n", three, "sum3", "weight3"), "context").join(second, "two")
    return full.select("three", F.log(_discounted("n", three) / F.col("sum3") + F.col("weight3") * F.col("p2")).alias("logp"))


def perplexity(documents: DataFrame) -> DataFrame:
    """doc_id, words, perplexity of every document with words under the model of the whole corpus.

    The model is stored as sorted hash arrays, one row per shard of the hash range; each task's trigrams go to the shards
    as arrays too, and binary search finds their log probabilities there. The number of shards follows the model's size,
    so a shard stays within SHARD_ENTRIES or so; nothing is broadcast.
    """
    trigrams = written(counts(documents))
    shards = 1
    size = trigrams.agg(F.count("*").alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    while shards * SHARD_ENTRIES < size["entries"]:
        shards *= 2
    bits = shards.bit_length() - 1
    spread_over = max(SPREAD, size["words"] // (shards * TASK_WORDS))
    shard = F.shiftrightunsigned("three", 64 - bits) if bits else F.lit(0).cast("long")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b for b in batches if len(b)]
        if kept:
            frame = pd.concat(kept, ignore_index=True)
            for key, part in frame.groupby("shard"):
                hashes = part["three"].to_numpy()
                order = np.argsort(hashes)
                yield pd.DataFrame({"shard": [key], "hashes": [hashes[order].tobytes()], "logp": [part["logp"].to_numpy(np.float32)[order].tobytes()]})

    arrays = model(trigrams).withColumn("shard", shard).repartition(shards, "shard").mapInPandas(store, "shard long, hashes binary, logp binary")
    arrays = written(arrays).select("shard", F.lit(-1).alias("part"), F.col("hashes").alias("asked"), F.col("logp").alias("places"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("ids"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, held in _held(batches, 500_000):
            three, *_, owner = _grams(held)
            part = (three >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(three), np.int64)
            names = np.array(ids, dtype=np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for piece in np.split(order, cuts):
                if len(piece):
                    # Each trigram once, its places as small numbers, and the documents as numbers into a list of their ids.
                    hashes, place = np.unique(three[piece].view(np.int64), return_inverse=True)
                    some, doc = np.unique(owner[piece], return_inverse=True)
                    yield pd.DataFrame({"shard": [part[piece[0]]], "part": [int(names[0]) % spread_over], "asked": [hashes.tobytes()], "places": [place.astype(np.int32).tobytes()], "docs": [doc.astype(np.int32).tobytes()], "ids": [names[some].tobytes()]})

    asked = latest(documents.select("doc_id", "text"), "doc_id", "text").mapInPandas(ask, "shard long, part int, asked binary, places binary, docs binary, ids binary")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, table, value = None, np.empty(0, np.int64), np.empty(0, np.float32)
        for batch in batches:
            for key, part, first, second, docs, ids in zip(*(batch[c] for c in ("shard", "part", "asked", "places", "docs", "ids"))):
                if part < 0:
                    shard, table, value = key, np.frombuffer(first, np.int64), np.frombuffer(second, np.float32)
                    continue
                assert key == shard
                found = value[np.searchsorted(table, np.frombuffer(first, np.int64))].astype(float)
                index = np.frombuffer(docs, np.int32)
                yield pd.DataFrame({"doc_id": np.frombuffer(ids, np.int64), "n": np.bincount(index), "logp": np.bincount(index, found[np.frombuffer(second, np.int32)])})

    # A shard's array comes before its requests and enters Python once in each of the few tasks its requests are spread over.
    placed = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread_over - 1)))).unionByName(asked.withColumn("salt", F.col("part")))
    sums = placed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "part").mapInPandas(answer, "doc_id long, n long, logp double")
    return sums.groupBy("doc_id").agg(F.sum("n").alias("words"), F.exp(-F.sum("logp") / F.sum("n")).alias("perplexity"))


def bands(scored: DataFrame, documents: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Perplexity with the band of the document's language (quantiles low and high) and whether it lies outside; spellings of a language are one."""
    lang = F.coalesce(F.nullif(F.lower(F.substring_index(F.trim("lang"), "-", 1)), F.lit("")), F.lit("und"))
    named = written(scored.join(documents.select("doc_id", lang.alias("lang")).dropDuplicates(["doc_id"]), "doc_id"))
    limit = lambda q, name: nearest_rank(named, ["lang"], "perplexity", q).select("lang", F.col("value").alias(name))
    joined = named.join(limit(low, "lower"), "lang").join(limit(high, "upper"), "lang")
    return joined.select("doc_id", "lang", "words", "perplexity", "lower", "upper", ((F.col("perplexity") < F.col("lower")) | (F.col("perplexity") > F.col("upper"))).alias("rejected"))
