import random

import pytest
from factloom.operators import graphs, history


def reachable(edges):
    out = {}
    nodes = {x for e in edges for x in e}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    break
            else:
                todo.pop()
                continue
            seen.add(b)
            todo.append(b)
        out[n] = seen
    return out


def frame(spark, edges):
    return spark.createDataFrame([*edges, *edges[:3], (None, "x")], "source string, target string")


@pytest.mark.parametrize("one_task", [graphs.ONE_TASK, 0])
def test_components_and_layers(spark, monkeypatch, one_task):
    monkeypatch.setattr(graphs, "ONE_TASK", one_task)
    for seed in range(2):
        r = random.Random(seed)
        edges = list({(f"v{r.randrange(14)}", f"v{r.randrange(14)}") for _ in range(20)})
        reach = reachable(edges)
        want = {n: min(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}
        assert {x.node: x.component for x in graphs.components(frame(spark, edges)).collect()} == want

        def layer(n, seen=()):
            group = {m for m in reach if m == n or m in reach[n] and n in reach[m]}
            below = {b for a, b in edges if a in group and b not in group}
            return max((layer(b) + 1 for b in below), default=0)

        assert {x.node: x.layer for x in graphs.layers(frame(spark, edges)).collect()} == {n: layer(n) for n in reach}


def test_reach_impact_and_trial(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    f = frame(spark, edges)
    start = spark.createDataFrame([("a",), (None,)], "node string")
    assert {(x.node, x.distance) for x in graphs.reach(start, f, 2).collect()} == {("b", 1), ("d", 1), ("c", 2)}
    assert {(x.node, x.distance) for x in graphs.impact(spark.createDataFrame([("d",)], "node string"), f).collect()} == {("d", 0), ("c", 1), ("a", 1), ("b", 2)}
    trial = graphs.simulated(f, added=spark.createDataFrame([("d", "a")], "source string, target string"), removed=spark.createDataFrame([("a", "d")], "source string, target string"))
    assert trial["cycles_before"].count() == 0
    assert [(x.members, x.source, x.target) for x in trial["cycles_after"].collect()] == [(4, "a", "b")]


def test_cochange(spark):
    rows = [("r", k, f) for k in range(5) for f in ("a.py", "b/c.py", "t.py")] + [("r", 9, "a.py"), ("r", 0, "a.py"), ("r", 0, None)] + [("r", 50, f"f{k}") for k in range(40)]
    pairs = history.coupled(history.cochange(spark.createDataFrame(rows, "repository string, commit long, file string")))
    assert {(p.left, p.right, p.shared, p.left_commits, p.right_commits) for p in pairs.collect()} == {("a.py", "b/c.py", 5, 6, 5), ("a.py", "t.py", 5, 6, 5), ("b/c.py", "t.py", 5, 5, 5)}
    files = spark.createDataFrame([("r", "a.py", ["import b.d"], False), ("r", "b/c.py", ["from x import a", None], False), ("r", "t.py", None, True)], "repository string, path string, imports array<string>, is_test boolean")
    named = history.references(pairs, files)
    assert [(p.left, p.right, p.import_references) for p in named.collect()] == [("a.py", "b/c.py", 1)]
    assert history.hidden(named).count() == 0


def test_quantiles(spark):
    from factloom.operators import quantiles

    r = random.Random(3)
    rows = [("a", float(r.randrange(50))) for _ in range(300)] + [("b", 7.0)] * 40 + [("c", 1.0), ("c", 2.0), ("d", None)] + [("e", 5.0)] * 30 + [("e", 1e9)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {x.k: (x["count"], x.value) for x in quantiles.nearest_rank(frame, ["k"], "v", q, buckets=4).collect()}
        want = {}
        for k in "abce":
            values = sorted(v for n, v in rows if n == k)
            want[k] = (len(values), values[round((len(values) - 1) * q)])
        assert got == want
