import math
import random
from collections import Counter

import plain
import pytest
from factloom.llm import repeats
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=5))
def test_shares_and_exact_count(documents):
    want = [plain.repeated_words(" ".join(d))[1] for d in documents]
    assert repeats.shares(documents).tolist() == want
    assert [repeats.exact_share(d) for d in documents] == want


def test_operator(spark):
    loop = "one two three four five six seven eight nine "
    texts = ["", None, "a b c", loop * 3, loop + "x " + loop, "Ä ö " * 8, "a" * 50_000, "w " * 60_000, loop.upper() + loop, "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("share", F.lit("clash")).withColumn("words", F.lit(1))
    got = {r.doc_id: (r.words, r.repeated_words) for r in repeats.repeated(frame).collect()}
    assert got == {k: plain.repeated_words(t) for k, t in enumerate(texts) if t is not None}
    assert repeats.repeated(frame.limit(0)).count() == 0


def kneser_ney(documents):
    """Log probabilities of every trigram by interpolated modified Kneser-Ney of order 3, straight from the definition."""
    three = Counter(tuple(p[k : k + 3]) for d in documents for p in [["<", "<", *d]] for k in range(len(p) - 2))
    two = Counter(t[1:] for t in three)
    one = Counter(b[1] for b in two)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [0.0] + [min(k, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]

    d3, d2 = discounts(three), discounts(two)

    def level(counts, d, key, lower):
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[key(g)] += c
            left[key(g)] += d[min(c, 3)]
        return {g: (c - d[min(c, 3)]) / total[key(g)] + left[key(g)] / total[key(g)] * lower(g) for g, c in counts.items()}

    p2 = level(two, d2, lambda g: g[0], lambda g: one[g[1]] / sum(one.values()))
    return {g: math.log(p) for g, p in level(three, d3, lambda g: g[:2], lambda g: p2[g[1:]]).items()}


@pytest.mark.parametrize("entries", [1_000_000, 20])
def test_perplexity_against_the_definition(spark, monkeypatch, entries):
    monkeypatch.setattr(repeats, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(repeats, "TASK_WORDS", 20 * entries)
    r = random.Random(5)
    documents = [[r.choice("abcdefgh") for _ in range(r.randrange(1, 40))] for _ in range(30)]
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(documents)] + [(90, None), (91, "12 34"), (90, None)], "doc_id long, text string").withColumn("lang", F.lit("en-XX"))
    logp = kneser_ney(documents)
    scored = repeats.perplexity(frame)
    got = {x.doc_id: (x.words, x.perplexity) for x in scored.collect()}
    assert set(got) == set(range(30))
    for k, d in enumerate(documents):
        p = ["<", "<", *d]
        want = math.exp(-sum(logp[tuple(p[j : j + 3])] for j in range(len(d))) / len(d))
        assert got[k] == (len(d), pytest.approx(want, rel=1e-4))
    banded = repeats.bands(scored, frame, 0.1, 0.9).collect()
    assert {b.lang for b in banded} == {"en"} and 0 < sum(b.rejected for b in banded) < 10


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert repeats.perplexity(frame).count() == 0
