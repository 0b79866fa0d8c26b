import random

import pytest
from factloom.llm import mixing
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F


def subset_sums(lengths):
    reach = {0}
    for k, n in lengths.items():
        reach = {a + k * j for a in reach for j in range(n + 1)}
    return reach


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 300))
def test_fill_is_exact_where_the_lengths_allow(lengths, budget):
    taken = mixing.fill(lengths, budget)
    total = sum(k * n for k, n in taken.items())
    assert all(0 <= n <= lengths[k] for k, n in taken.items()) and total <= max(budget, 0)
    # An equal part of every length is fixed first, up to two of the longest documents; what it leaves is filled to the best sum of what is left.
    whole = sum(k * n for k, n in lengths.items())
    if budget < whole:
        fixed = max(0, budget - 2 * max((k for k in lengths if k <= budget), default=0))
        base = {k: n * fixed // whole for k, n in lengths.items()}
        rest = budget - sum(k * n for k, n in base.items())
        assert total == budget - rest + max(x for x in subset_sums({k: lengths[k] - base[k] for k in lengths}) if x <= rest)


@pytest.mark.parametrize("lengths,budget,want", [({100_000: 1, 80_000: 1}, 90_000, 80_000), ({70_000: 3, 90_000: 2, 110_001: 1}, 270_000, 250_001), ({100_000: 5}, 299_999, 200_000), ({90_000: 1, 16_000: 2}, 100_000, 90_000), ({6: 4, 10: 3}, 15, 12)])
def test_long_documents_are_tried(lengths, budget, want):
    assert sum(k * n for k, n in mixing.fill(lengths, budget).items()) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(1, 200))
def test_the_program_finds_the_best_sum(lengths, width):
    taken = mixing._program(lengths, width)
    assert all(n <= lengths[k] for k, n in taken.items()) and sum(k * n for k, n in taken.items()) == max(x for x in subset_sums(lengths) if x <= width)


def test_many_targets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TARGETS_BOUND", 1)
    documents = spark.createDataFrame([(1, "a b", "docs")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(documents, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats long"))


def test_large_budget_leaves_less_than_a_document():
    r = random.Random(1)
    lengths = {r.randrange(50, 5000): r.randrange(1, 3000) for _ in range(800)}
    budget = sum(k * n for k, n in lengths.items()) // 3
    taken = mixing.fill(lengths, budget)
    assert budget - sum(k * n for k, n in taken.items()) <= 1


def test_plan_keeps_caps_and_shares():
    lengths = {"a": {10: 100}, "b": {7: 30, 3: 10}, "c": {1: 5}}
    targets = {"a": (0.6, 1), "b": (0.3, 3), "c": (0.1, 2), "none": (0.0, 1)}
    made = mixing.plan(lengths, targets)
    used = {s: passes * sum(k * n for k, n in lengths.get(s, {}).items()) + sum(k * n for k, n in rest.items()) for s, (passes, rest) in made.items()}
    assert used["c"] == 10 and used["a"] == 60 and abs(used["b"] - 30) <= 1 and used["none"] == 0


def test_tokens_are_those_of_the_tokenizer():
    counter = mixing.Counter(mixing.VOCABULARY)
    for text in ("", "a", "Hello  world\n\n it's 12 o'clock\t!", "ünïcode ß — 字 😀", "x" * 3000, " \x1c\x85 a b \r\n", "'s'll  \n \n"):
        assert counter.tokens(text) == len(counter.encoding.encode_ordinary(text))


def test_mix(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["word"] * r.randrange(1, 40)), r.choice(["Docs", " docs ", "issue", "ISSUE", None, "other", ""])) for k in range(400)]
    rows += [(900, None, "docs"), (901, "", "docs"), (902, "word " * 20_000, "forum"), *rows[:9]]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("repeats", F.lit(1)).withColumn("n", F.lit(1))
    targets = spark.createDataFrame([("docs", 0.5, 2, 1), ("issue", 0.5, 3, 1), ("forum", 0.0, 1, 1), (None, 0.1, 1, 1)], "source string, target_share double, max_repeats long, tokens long")
    mixed = mixing.mix(documents, targets).cache()
    got = {(x.doc_id, x.source, x.tokens, x.repeats) for x in mixed.collect()}
    assert got == {tuple(x) for x in mixing.mix(documents, targets).collect()}
    assert {g[1] for g in got} == {"docs", "issue"} and max(g[3] for g in got if g[1] == "docs") <= 2 and max(g[3] for g in got if g[1] == "issue") <= 3
    assert len({g[0] for g in got}) == len(got)
    shares = {x.source: x.actual_share for x in mixing.reached(mixed, targets.where("source IS NOT NULL")).collect()}
    assert shares["docs"] == pytest.approx(0.5, abs=0.01) and shares["forum"] == 0
    small = mixing.mix(documents, targets, total=500)
    assert sum(x.tokens * x.repeats for x in small.collect()) in range(495, 501)


def test_missing_source_and_empty(spark):
    targets = spark.createDataFrame([("docs", 0.5, 2), ("gone", 0.5, 1)], "source string, target_share double, max_repeats long")
    documents = spark.createDataFrame([(1, "a b", "docs")], "doc_id long, text string, source string")
    assert mixing.mix(documents, targets).count() == 0
    assert mixing.mix(documents.limit(0), targets).count() == 0
    assert mixing.mix(documents, targets.limit(0)).count() == 0
