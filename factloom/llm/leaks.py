"""Evaluation texts inside a corpus, by suffix arrays of the corpus' shards.

Every task cuts its documents into shards. A shard's texts become one sequence of word numbers; the places of its suffixes
are sorted by their first `least` words, and every suffix of every item is looked up by binary search and extended in
place to its longest match. A word no item has ends a match, so suffixes with one among their first words can be left out
without losing any. Memory goes with a shard's words and the items' words, not with the length of an item. Items go to the
executors in parts of at most ITEMS_BOUND bytes, one pass over the documents for each; the size is checked first. No
document is shuffled.

Words are maximal runs of letters and digits, compared without case. An item that alone is above ITEMS_BOUND is refused. Null texts give no row; an item of fewer than
`least` words cannot be found; equal items are each reported; repeated document rows give one row; extra columns do not
matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import spread, written

LEAST = 12
ITEMS_BOUND = 64 << 20
SHARD_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _WORD.findall(text.lower())
    return "\n".join(_WORD.findall(text)).casefold().split("\n")


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return 0


def _heads(sequence: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """The first `least` words of each suffix as one sortable key: four bytes each, most significant first."""
    if not len(places):
        return np.empty(0, f"S{4 * least}")
    words = np.lib.stride_tricks.sliding_window_view(sequence.astype(">u4"), least)[places]
    return np.ascontiguousarray(words).view(f"S{4 * least}").ravel()


def _whole(sequence: np.ndarray, least: int) -> np.ndarray:
    """Places of the suffixes that begin with `least` known words."""
    known = np.append(0, np.cumsum(sequence > 0))
    return np.flatnonzero(known[least:] - known[:-least] == least) if len(sequence) >= least else np.empty(0, int)


class Items:
    """The items' words as numbers from 1 in one sequence, each item followed by a 0, and their suffixes' keys in order."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.vocabulary, self.least = _Vocabulary(), least
        self.ids = [item for item, _ in rows]
        parts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "") if w] for _, text in rows]
        self.sequence = np.array([0, *(x for p in parts for x in (*p, 0))], np.int64)
        self.starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
        self.places = _whole(self.sequence, least)
        self.heads = _heads(self.sequence, self.places, least)


_PAIRS = 1_000_000


def search(items: Items, documents: list[tuple[int, np.ndarray]]):
    """(document, item, words, place in the document, place in the item) of the longest match of each pair of one shard."""
    least = items.least
    sequence = np.concatenate([np.zeros(1, np.int64), *(x for _, ids in documents for x in (ids, np.zeros(1, np.int64)))])
    starts = np.cumsum([1, *(len(ids) + 1 for _, ids in documents)])
    places = _whole(sequence, least)
    if not len(places) or not len(items.places):
        return []
    heads = _heads(sequence, places, least)
    order = np.argsort(heads, kind="stable")
    array, heads = places[order], heads[order]
    low, high = np.searchsorted(heads, items.heads, "left"), np.searchsorted(heads, items.heads, "right")
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    hits = np.flatnonzero(high > low)
    cuts = np.append(0, np.cumsum(high[hits] - low[hits]))
    first = 0
    while first < len(hits):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + _PAIRS, "right")) - 1)
        part = hits[first:last]
        size = high[part] - low[part]
        mine = np.repeat(items.places[part], size)
        at = np.repeat(low[part] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))
        theirs = array[at]
        # A match that goes on to the left is part of a longer one.
        left = (items.sequence[mine - 1] != sequence[theirs - 1]) | (items.sequence[mine - 1] == 0)
        mine, theirs = mine[left], theirs[left]
        length = np.full(len(mine), least)
        going = np.arange(len(mine))
        while len(going):
            a, b = items.sequence[mine[going] + length[going]], sequence[theirs[going] + length[going]]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        item, document = np.searchsorted(items.starts, mine, "right") - 1, np.searchsorted(starts, theirs, "right") - 1
        for k, d, n, p, q in zip(item.tolist(), document.tolist(), length.tolist(), (theirs - starts[document]).tolist(), (mine - items.starts[item]).tolist()):
            if (d, k) not in best or (n, -p, -q) > best[d, k]:
                best[d, k] = (n, -p, -q)
        first = last
    return [(documents[d][0], items.ids[k], n, -p, -q) for (d, k), (n, p, q) in best.items()]


_FOUND = "doc_id long, item_id long, words long, doc_word long, item_word long"


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The longest verbatim match of each document and item that share at least `least` consecutive words."""
    least = int(least)
    plain = items.select("item_id", "text")
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("most")).first()
    if size["most"] > ITEMS_BOUND:
        raise ValueError(f"an item has {size['most']} bytes; the bound is {ITEMS_BOUND}")
    if size["n"] <= ITEMS_BOUND:
        return _longest(_pass(documents, plain, least, shard_words))
    # Parts of half the bound by hash, cut again where one is still too large.
    found, parts = [], [(plain, 2 * math.ceil(size["n"] / ITEMS_BOUND), 0)]
    while parts:
        frame, pieces, depth = parts.pop()
        for k in range(pieces):
            part = frame.where(F.expr(f"pmod(xxhash64(item_id, text, {depth}), {pieces})") == k)
            n = part.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
            if n > ITEMS_BOUND:
                parts.append((part, 2, depth + 1))
            elif n:
                found.append(written(_pass(documents, part, least, shard_words)))
    return _longest(reduce(DataFrame.unionByName, found))


def _longest(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("words", "doc_word", "item_word"), F.struct("words", -F.col("doc_word"), -F.col("item_word"))).alias("m")).select("doc_id", "item_id", "m.*")


def _pass(documents: DataFrame, items: DataFrame, least: int, shard_words: int) -> DataFrame:
    """Longest matches of the items, which are below the bound, in every shard of the documents."""
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    shared = documents.sparkSession.sparkContext.broadcast(Items(rows, least))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        number = held.vocabulary.__getitem__
        shard, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if text is None:
                    continue
                words = words_of(text)
                shard.append((doc, np.fromiter(map(number, words), np.int64, len(words))))
                size += len(words)
                if size >= shard_words:
                    yield pd.DataFrame(search(held, shard), columns=["doc_id", "item_id", "words", "doc_word", "item_word"])
                    shard, size = [], 0
        if shard:
            yield pd.DataFrame(search(held, shard), columns=["doc_id", "item_id", "words", "doc_word", "item_word"])

    return spread(documents.select("doc_id", "text")).mapInPandas(find, _FOUND)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which no item was found."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
