"""Long exact spans shared between token streams, by recompression.

Every token gets a 64-bit name, and a name of a pair or run follows from the names it joins, so all tasks give equal
things equal names without a dictionary. Rounds then rename the streams everywhere in the same way: first runs of one
name, then pairs chosen by a coin that depends on the names alone; the longer the spans asked for, the more rounds. A
symbol's name depends on the tokens around its place only, and each symbol carries the interval of tokens that settled
it. So a stretch of at least `least` tokens that stands in two streams has the same interior symbols in both.

Spark finds the names only one stream has; a window of `least` tokens that holds such a symbol cannot be shared. The
other windows are written as their settled symbols, from the first to the last, with the few tokens before and after
them: two windows are equal if and only if these are, and that is verified by 128 bits (two names for each symbol).
Names and windows are grouped with partial aggregates (least and greatest stream), never paired; a name or window that a
third of all streams share is one row per task before the shuffle, and adaptive execution may split its windows where
they are joined back.

Streams are cut into blocks of `width` tokens with a halo on either side, so no task holds a whole long stream.

Defined cases: repeated rows count once; of two rows for one place the one with the lesser name counts; a missing place
breaks the stream there; null symbols and identities equal null; rows without stream_id or token_no are left out; streams
shorter than `least` and empty tables give no rows; extra columns do not matter; `least` may be any number from 1 on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written

LEAST, RUN = 40, 3
BLOCK = 16_384
_U = np.uint64
_CHUNK = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _mix(_mix(a + _U(salt)) * _U(0x9E3779B97F4A7C15) + b)


def rounds(least: int) -> tuple[int, int]:
    """Number of rounds and the most tokens of a symbol, so that a symbol and all that settles it fit into `least` tokens.

    After r rounds without a limit a symbol has up to 2 * 2^r tokens and depends on up to twice as many less one on either side.
    """
    free = max(0, int(np.log2(max(1.0, (least + 2) / 6))))
    return (free + 1 if least >= 4 else 0), 2 << free


class Symbols:
    """What the rounds make of a sequence: two names of each symbol, the tokens [start, end) it covers, those [low, high)
    that settle it, and whether it is a long run, which never joins others."""

    def __init__(self, one: np.ndarray, two: np.ndarray, breaks: np.ndarray, least: int):
        """breaks: places that hold no token; what depends on one is never inside a window."""
        n = len(one)
        place = np.arange(n)
        # Runs: one symbol for each; up to RUN - 1 tokens its exact length counts, from RUN on it does not and it never pairs.
        same = np.zeros(n, bool)
        same[1:] = (one[1:] == one[:-1]) & ~breaks[1:] & ~breaks[:-1]
        first = place[~same]
        size = np.diff(np.append(first, n))
        long = size >= RUN
        name = _pair(one[first], np.minimum(size, RUN).astype(_U), 1)
        name[size == 1] = one[first][size == 1]
        other = _pair(two[first], size.astype(_U), 2)
        gone = breaks[first]
        low = np.where(gone | long, first, first - 1)
        high = np.where(gone, first + 1, np.where(long, first + RUN, first + size + 1))
        # What a right neighbour depends on: of a long run only its last tokens.
        tail = np.where(long & ~gone, first + size - RUN, low)
        fixed, start = long | gone, first
        number, longest = rounds(least)
        for k in range(number):
            coin = (_mix(name + _U(1000 + k)) >> _U(17)) & _U(1) == 1
            left, right = coin & ~fixed, ~coin & ~fixed
            joins = np.zeros(len(name), bool)
            joins[:-1] = left[:-1] & right[1:] & (size[:-1] + size[1:] <= longest)
            # A symbol that may join to its right depends on its right neighbour, one that may join to its left on its left one.
            low2 = np.where(right, np.minimum(low, np.append(-1, tail[:-1])), np.where(left, np.minimum(low, np.append(low[1:], n)), low))
            high2 = np.where(left, np.maximum(high, np.append(high[1:], n + 1)), np.where(right, np.maximum(high, np.append(0, high[:-1])), high))
            keep = np.ones(len(name), bool)
            keep[1:] = ~joins[:-1]
            at = np.flatnonzero(joins)
            name2, other2, size2 = name.copy(), other.copy(), size.copy()
            name2[at], other2[at] = _pair(name[at], name[at + 1], 100 + k), _pair(other[at], other[at + 1], 200 + k)
            low2[at], high2[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
            size2[at] += size[at + 1]
            name, other, start, size, low, high, fixed, gone, tail = (x[keep] for x in (name2, other2, start, size2, low2, high2, fixed, gone, np.where(fixed, tail, low2)))
        self.name, self.other, self.start, self.end, self.low, self.high, self.long = (x[~gone] for x in (name, other, start, start + size, low, high, fixed))


#: An odd multiplier and its inverse modulo 2^64: sums of names times its powers tell sequences apart and can be shifted.
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


class _Sums:
    """Hashes of any stretch of a sequence of names in constant time."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        power = np.cumprod(np.append(_U(1), np.full(n, _STEP, _U)))
        self.sums = np.append(_U(0), np.cumsum(_mix(names + _U(0x9E3779B97F4A7C15)) * power[:n]))
        self.back = np.cumprod(np.append(_U(1), np.full(n, _BACK, _U)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def signatures(symbols: Symbols, one: np.ndarray, two: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of `least` tokens at the given places: of the settled symbols and the tokens at the ends.

    Which symbols are settled follows from a window's tokens alone, so equal windows get equal hashes. A long run at an
    end may be cut by the window and stands there as tokens.
    """
    short = np.flatnonzero(~symbols.long)
    first = np.searchsorted(symbols.low[short], at, "left")
    last = np.searchsorted(symbols.high[short], at + least, "right") - 1
    some = first <= last
    first, last = short[np.where(some, first, 0)] if len(short) else np.zeros(len(at), int), short[np.where(some, last, 0)] if len(short) else np.zeros(len(at), int)
    begin, end = (np.where(some, x, at) for x in (symbols.start[first], symbols.end[last])) if len(symbols.start) else (at, at)
    out = []
    for names, raw in ((symbols.name, one), (symbols.other, two)):
        # Names with the exact length of runs, so that runs between the symbols count whole.
        inner = _Sums(_pair(names, (symbols.end - symbols.start).astype(_U), 9))
        tokens = _Sums(raw)
        middle = np.where(some, inner.of(np.where(some, first, 0), np.where(some, last + 1, 0)), _U(0))
        out.append(_pair(_pair(tokens.of(at, begin), middle, 5), _pair(tokens.of(end, at + least), _pair((begin - at).astype(_U), (end - at).astype(_U), 8), 6), 7))
    return out[0], out[1]


class Group:
    """The tokens of one block of one stream: sequence with breaks, and the place of each."""

    def __init__(self, number: np.ndarray, one: np.ndarray, two: np.ndarray):
        order = np.lexsort((one, number))
        number, one, two = number[order], one[order], two[order]
        keep = np.ones(len(number), bool)
        keep[1:] = number[1:] != number[:-1]
        number, one, two = number[keep], one[keep], two[keep]
        jump = np.zeros(len(number), int)
        jump[1:] = np.diff(number) > 1
        place = np.arange(len(number)) + np.cumsum(jump) + 1
        n = len(number) + int(jump.sum()) + 2
        self.breaks = np.ones(n, bool)
        self.breaks[place] = False
        self.number = np.full(n, -1)
        self.one, self.two = np.zeros(n, _U), np.zeros(n, _U)
        self.number[place], self.one[place], self.two[place] = number, one, two


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, Group]]:
    """Chunks of whole (stream, block) groups as one sequence with breaks between them: keys, group of each place, tokens."""
    kept: list[pd.DataFrame] = []
    rows = 0

    def made(frame: pd.DataFrame):
        stream, block = frame["stream_id"].to_numpy(), frame["block"].to_numpy()
        new = np.ones(len(frame), bool)
        new[1:] = (stream[1:] != stream[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(new) - 1
        keys = list(zip(stream[new], block[new]))
        # Far-apart numbers per group keep neighbours of different groups from looking consecutive.
        number = frame["token_no"].to_numpy().astype(np.int64)
        base = np.append(number[new], 0)
        shift = np.cumsum(np.append(0, np.maximum.reduceat(number, np.flatnonzero(new))[:-1] - base[: len(keys)][:-1] + 3)) - base[: len(keys)]
        seq = Group(number + shift[group], frame["one"].to_numpy().view(_U), frame["two"].to_numpy().view(_U))
        owner = np.full(len(seq.number), -1)
        ends = np.cumsum(np.append(0, np.maximum.reduceat(number, np.flatnonzero(new)) - base[: len(keys)] + 3))
        real = ~seq.breaks
        owner[real] = np.searchsorted(ends, seq.number[real], "right") - 1
        seq.number[real] -= shift[owner[real]]
        return keys, owner, seq

    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        rows += len(batch)
        if rows >= _CHUNK:
            frame = pd.concat(kept, ignore_index=True)
            stream, block = frame["stream_id"].to_numpy(), frame["block"].to_numpy()
            cut = np.flatnonzero((stream != stream[-1]) | (block != block[-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield made(frame[:cut])
            kept, rows = [frame[cut:].reset_index(drop=True)], len(frame) - cut
    if rows:
        yield made(pd.concat(kept, ignore_index=True))


_SYMBOLS = "name long, stream_id long, block long"


def _symbols(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for keys, owner, seq in _groups(batches):
        made = Symbols(seq.one, seq.two, seq.breaks, least)
        use = (made.high - made.low <= least) & (made.low >= 0)
        name, group = made.name[use], owner[np.minimum(made.low[use], len(owner) - 1)]
        ok = group >= 0
        pairs = np.unique(np.stack([group[ok].astype(np.int64), name[ok].view(np.int64)]), axis=1)
        stream, block = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
        yield pd.DataFrame({"name": pairs[1], "stream_id": stream[pairs[0]], "block": block[pairs[0]]})


_HASHES = "one long, two long, stream_id long, token_no long"


def _candidates(batches: Iterator[pd.DataFrame], least: int, width: int) -> Iterator[pd.DataFrame]:
    """Hashes of the windows all of whose settled symbols other streams have too. Rows with a null token_no are the group's private names."""

    def tokens() -> Iterator[pd.DataFrame]:
        for batch in batches:
            held.append(batch.loc[batch["private"], ["stream_id", "block", "one"]])
            yield batch[~batch["private"]]

    held: list[pd.DataFrame] = []
    for keys, owner, seq in _groups(tokens()):
        private = pd.concat(held, ignore_index=True)
        index = {k: i for i, k in enumerate(keys)}
        of = np.array([index.get(k, -1) for k in zip(private["stream_id"], private["block"])], dtype=np.int64)
        held[:] = [private[of < 0]]
        known = np.unique(_pair(of[of >= 0].astype(_U), private["one"].to_numpy()[of >= 0].view(_U), 3))
        made = Symbols(seq.one, seq.two, seq.breaks, least)
        n = len(seq.one)
        bad = (made.high - made.low <= least) & (made.low >= 0)
        name, low, high = made.name[bad], made.low[bad], made.high[bad]
        group = owner[low]
        bad = np.isin(_pair(np.maximum(group, 0).astype(_U), name, 3), known) & (group >= 0)
        shut = np.zeros(n + 1, int)
        np.add.at(shut, np.maximum(high[bad] - least, 0), 1)
        np.add.at(shut, low[bad] + 1, -1)
        start = np.arange(max(0, n - least + 1))
        broken = np.append(0, np.cumsum(seq.breaks))
        free = (np.cumsum(shut)[: len(start)] == 0) & (broken[start + least] == broken[start])
        # A window belongs to the block its first token is in.
        block = np.array([k[1] for k in keys])
        own = owner[: len(start)]
        free &= (own >= 0) & (seq.number[: len(start)] // width == block[np.maximum(own, 0)])
        stream = np.array([k[0] for k in keys])
        at = np.flatnonzero(free)
        one, two = signatures(made, seq.one, seq.two, at, least)
        for k in range(0, len(at), 100_000):
            i = at[k : k + 100_000]
            yield pd.DataFrame({"one": one[k : k + 100_000].view(np.int64), "two": two[k : k + 100_000].view(np.int64), "stream_id": stream[own[i]], "token_no": seq.number[i]})


def _blocks(tokens: DataFrame, least: int, width: int) -> DataFrame:
    """Named tokens by stream and block, each also in the neighbouring block whose halo it lies in."""
    named = tokens.where(F.col("stream_id").isNotNull() & F.col("token_no").isNotNull()).select(
        F.col("stream_id").cast("long"), F.col("token_no").cast("long"),
        F.xxhash64("symbol", F.isnull("symbol"), "identity", F.isnull("identity")).alias("one"),
        F.xxhash64(F.lit(7), F.isnull("identity"), "identity", F.isnull("symbol"), "symbol").alias("two"),
    )
    block = F.expr(f"token_no div {width}")
    near = F.array(F.expr(f"(token_no - {least}) div {width}"), block, F.expr(f"(token_no + {least}) div {width}"))
    inner = F.expr(f"token_no % {width}").between(least, width - least - 1)
    return named.withColumn("block", F.explode(F.when(inner, F.array(block)).otherwise(F.array_distinct(near))))


def shared_windows(tokens: DataFrame, least: int = LEAST, width: int = BLOCK) -> DataFrame:
    """stream_id, token_no of the first token of every run of `least` tokens that also stands in another stream."""
    if least < 1:
        raise ValueError("a span has at least one token")
    width = max(width, 2 * least)
    placed = _blocks(tokens, least, width)
    grouped = placed.repartition("stream_id", "block").sortWithinPartitions("stream_id", "block", "token_no")
    symbols = written(grouped.mapInPandas(lambda b: _symbols(b, least), _SYMBOLS))
    private = symbols.groupBy("name").agg(F.min("stream_id").alias("a"), F.max("stream_id").alias("b")).where("a = b").select("name")
    private = symbols.join(private, "name").select("stream_id", "block", F.lit(None).cast("long").alias("token_no"), F.col("name").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(True).alias("private"))
    both = placed.withColumn("private", F.lit(False)).select(private.columns).unionByName(private)
    # Nulls first: a group's private names come before its tokens.
    both = both.repartition("stream_id", "block").sortWithinPartitions("stream_id", "block", F.col("token_no").asc_nulls_first())
    windows = written(both.mapInPandas(lambda b: _candidates(b, least, width), _HASHES))
    shared = windows.groupBy("one", "two").agg(F.min("stream_id").alias("a"), F.max("stream_id").alias("b")).where("a <> b").select("one", "two")
    return windows.join(shared, ["one", "two"], "left_semi").select("stream_id", "token_no")


def shared_tokens(windows: DataFrame, least: int = LEAST, width: int = BLOCK) -> DataFrame:
    """stream_id and the number of its tokens that some shared window covers, counted block by block."""
    width = max(width, 2 * least)
    rows = windows.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"token_no div {width}"), F.expr(f"(token_no + {least - 1}) div {width}")))))
    before = F.lag("token_no").over(Window.partitionBy("stream_id", "block").orderBy("token_no"))
    start = F.greatest(F.col("token_no"), F.coalesce(before + least, F.lit(0)), F.col("block") * width)
    end = F.least(F.col("token_no") + least, (F.col("block") + 1) * width)
    return rows.withColumn("n", F.greatest(end - start, F.lit(0))).groupBy("stream_id").agg(F.sum("n").alias("shared_tokens")).where("shared_tokens > 0")


def shared_spans(windows: DataFrame, tokens: DataFrame, least: int = LEAST, width: int = BLOCK) -> DataFrame:
    """Maximal covered spans of each stream, with their first and last token and line.

    A window begins a span where no other begins within `least` places before it, and ends one where none begins within
    `least` after it; both are seen block by block with a halo. Only a stream's spans are then numbered in order.
    """
    width = max(width, 2 * least)
    near = F.array(F.expr(f"(token_no - {least}) div {width}"), F.expr(f"token_no div {width}"), F.expr(f"(token_no + {least}) div {width}"))
    rows = windows.withColumn("block", F.explode(F.array_distinct(near)))
    order = Window.partitionBy("stream_id", "block").orderBy("token_no")
    gap = lambda other: F.coalesce(F.abs(F.col("token_no") - other) > least, F.lit(True))
    marked = rows.withColumns({"begins": gap(F.lag("token_no").over(order)), "ends": gap(F.lead("token_no").over(order))}).where(F.col("block") == F.expr(f"token_no div {width}"))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("token_no"))
    first = marked.where("begins").select("stream_id", F.col("token_no").alias("first_token"), number.alias("span"))
    last = marked.where("ends").select("stream_id", (F.col("token_no") + least - 1).alias("last_token"), number.alias("span"))
    spans = written(first.join(last, ["stream_id", "span"]).select("stream_id", "first_token", "last_token"))
    # Only the tokens at the spans' ends are looked up.
    ends = spans.select("stream_id", F.explode(F.array("first_token", "last_token")).alias("token_no")).distinct()
    lines = tokens.select("stream_id", "token_no", "line").join(ends, ["stream_id", "token_no"], "left_semi").groupBy("stream_id", "token_no").agg(F.min("line").alias("line"))
    start = lines.select("stream_id", F.col("token_no").alias("first_token"), F.col("line").alias("first_line"))
    end = lines.select("stream_id", F.col("token_no").alias("last_token"), F.col("line").alias("last_line"))
    return spans.join(start, ["stream_id", "first_token"], "left").join(end, ["stream_id", "last_token"], "left").select("stream_id", "first_token", "last_token", "first_line", "last_line")
