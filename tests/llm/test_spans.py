import random

import numpy as np
import plain
import pytest
from factloom.llm import spans
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

SCHEMA = "stream_id long, token_no long, symbol long, identity string, line long"


def check(spark, rows, least=40, **width):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("clash")).withColumn("one", F.lit(1)).withColumn("private", F.lit(True))
    got = {r.stream_id: r.shared_tokens for r in spans.shared_tokens(spans.shared_windows(frame, least, **width), least, **width).collect()}
    assert got == plain.shared_tokens([(s, k, (a, b)) for s, k, a, b, _ in rows if s is not None and k is not None], least)
    return frame


def stream(number, tokens):
    return [(number, k, a, b, k // 5) for k, (a, b) in enumerate(tokens)]


def code(r, n, kinds=30):
    return [(r.randrange(kinds), f"i{r.randrange(50)}" if r.random() < 0.3 else None) for _ in range(n)]


def test_planted_runs_of_every_length_about_the_least(spark):
    r = random.Random(1)
    rows, number = [], 0
    for n in (38, 39, 40, 41, 60, 200):
        run = code(r, n)
        for _ in range(2):
            number += 1
            rows += stream(number, code(r, r.randrange(50)) + run + code(r, r.randrange(50)))
    rows += stream(90, code(r, 30)) + stream(91, [])
    r.shuffle(rows)
    check(spark, rows + rows[:50])


def test_runs_of_one_token_and_short_periods(spark):
    a, b, c = (1, None), (2, "x"), (3, "")
    rows = stream(1, [a] * 25 + [b] * 20) + stream(2, [c] + [a] * 22 + [b] * 30) + stream(3, [a] * 39) + stream(4, [a, b] * 30) + stream(5, [b, a] * 21) + stream(6, [c] * 50) + stream(7, [(3, None)] * 50) + stream(8, [c] * 41)
    check(spark, rows)


def test_own_repeats_do_not_count_and_gaps_break(spark):
    r = random.Random(2)
    run = code(r, 50)
    own = stream(1, run + run)
    gap = [(2, k + (k > 25), a, b, None) for k, (a, b) in enumerate(run)]
    check(spark, own + gap)
    check(spark, own + gap + stream(3, run))


def test_nulls_and_ties(spark):
    run = code(random.Random(3), 45)
    rows = stream(1, run) + stream(2, run) + [(None, 1, 1, "a", 1), (1, None, 1, "a", 1), (9, 0, None, None, None)]
    check(spark, rows + [(3, k, None, None, None) for k in range(45)] + [(4, k, None, None, None) for k in range(45)])


def test_blocks_and_spans(spark):
    r = random.Random(4)
    run = code(r, 300)
    rows = stream(1, code(r, 100) + run + code(r, 90)) + stream(2, run + code(r, 10)) + stream(3, code(r, 700) + run[100:190])
    frame = check(spark, rows, width=128)
    check(spark, rows, width=97)
    found = {(x.stream_id, x.first_token, x.last_token) for x in spans.shared_spans(spans.shared_windows(frame, width=128), frame, width=128).collect()}
    assert found == {(x.stream_id, x.first_token, x.last_token) for x in spans.shared_spans(spans.shared_windows(frame), frame).collect()}
    assert found == {(1, 100, 399), (2, 0, 299), (3, 700, 789)}


def test_empty(spark):
    assert spans.shared_tokens(spans.shared_windows(spark.createDataFrame([], SCHEMA))).count() == 0
    with pytest.raises(ValueError):
        spans.shared_windows(spark.createDataFrame([], SCHEMA), 0)


@pytest.mark.parametrize("least", [1, 3, 8, 20, 200])
def test_spans_of_any_length(spark, least):
    r = random.Random(least)
    run = code(r, 260, 4)
    rows = stream(1, code(r, 90) + run + code(r, 40)) + stream(2, run[:210] + code(r, 30, 900)) + stream(3, code(r, 60, 3) + run[100:130]) + stream(4, code(r, 40, 2000)) + stream(5, [(9, None)] * 230) + stream(6, [(9, None)] * 205 + code(r, 20, 4))
    check(spark, rows, least)
    check(spark, rows, least, width=97)


def test_runs_cut_by_a_span(spark):
    """A long run that goes on beyond the shared span, on one side of one stream only."""
    r, rows = random.Random(5), []
    for k in range(12):
        tail = code(r, 30, 900)
        rows += stream(4 * k, [(1000 + k, None)] * 20 + tail) + stream(4 * k + 1, [(1000 + k, None)] * 100 + tail) + stream(4 * k + 2, tail[::-1] + [(1000 + k, "x")] * 15) + stream(4 * k + 3, tail[::-1] + [(1000 + k, "x")] * 90)
    check(spark, rows)


TOKENS = st.lists(st.integers(0, 3), max_size=60)
RUNS = st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9)), max_size=20).map(lambda x: [a for a, n in x for _ in range(n)])


def sequence(tokens):
    names = np.array([0, *(x + 1 for x in tokens), 0], dtype=np.uint64)
    breaks = np.zeros(len(names), bool)
    breaks[[0, -1]] = True
    return names, spans._mix(names), breaks


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 3), min_size=40, max_size=40), RUNS), st.one_of(TOKENS, RUNS), st.one_of(TOKENS, RUNS), st.sampled_from([8, 20, 40, 100]))
def test_symbols_inside_a_shared_run_are_the_same(run, left, right, least):
    """Every symbol that depends only on the run's tokens appears in any other text around the run, settled there too."""

    def symbols(before, after):
        made = spans.Symbols(*sequence([*before, *run, *after]), least)
        start = 1 + len(before)
        inside = (made.low >= start) & (made.high <= start + len(run))
        emitted = made.high - made.low <= least
        return set(made.name[emitted].tolist()), set(made.name[inside & emitted].tolist())

    one, own = symbols(left, right)
    two, other = symbols(right, left)
    assert own <= two and other <= one
    if len(run) >= 40 and least <= 40:
        assert own or len(set(run)) == 1 or any(len(set(run[k : k + 3])) == 1 for k in range(len(run) - 2))


@settings(max_examples=150, deadline=None)
@given(st.one_of(RUNS, st.lists(st.integers(0, 2), max_size=150)), st.one_of(RUNS, TOKENS), st.one_of(RUNS, TOKENS), st.sampled_from([1, 2, 5, 12, 40, 70]))
def test_signatures_are_those_of_the_windows(tokens, left, right, least):
    """Equal windows have equal signatures whatever stands around them, unequal ones have not."""
    found: dict = {}
    for text in (tokens, [*left, *tokens, *right], [*right, *tokens]):
        one, two, breaks = sequence(text)
        made = spans.Symbols(one, two, breaks, least)
        assert (np.diff(made.low[~made.long]) >= 0).all() and (np.diff(made.high[~made.long]) >= 0).all()
        at = np.arange(1, len(text) - least + 2)
        a, b = spans.signatures(made, one, two, at, least)
        for k, pair in zip(at.tolist(), zip(a.tolist(), b.tolist())):
            found.setdefault(tuple(text[k - 1 : k - 1 + least]), set()).add(pair)
    assert all(len(v) == 1 for v in found.values()) and len({p for v in found.values() for p in v}) == len(found)


def test_rounds_follow_the_length():
    assert [spans.rounds(n) for n in (1, 3, 8, 20, 40, 64, 200)] == [(0, 2), (0, 2), (1, 2), (2, 4), (3, 8), (4, 16), (6, 64)]
