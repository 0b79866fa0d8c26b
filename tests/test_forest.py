import random

import pytest
from factloom.operators import forest
from pyspark.sql import functions as F


def brute(links):
    parent = {}
    for kind, node, up in links:
        if node is not None and (parent.get((kind, node)) is None or up is not None and up > parent[kind, node]):
            parent[kind, node] = up
    out = {}
    for kind, node in parent:
        at, path = node, [node]
        while (kind, at) in parent and parent[kind, at] is not None:
            at = parent[kind, at]
            if at in path:
                path = None
                break
            path.append(at)
        out[kind, node] = ("", -1, None) if path is None else (at, len(path) - 1, path[::-1])
    return out, parent


def made(seed):
    r = random.Random(seed)
    nodes = [f"n{k}" for k in range(120)]
    links = [("a", n, r.choice(nodes[: k // 2 + 1])) for k, n in enumerate(nodes) if k and r.random() < 0.9]
    links += [("a", f"c{k}", f"c{k + 1}") for k in range(60)] + [("b", f"z{k}", f"z{(k + 1) % 7}") for k in range(7)] + [("b", "y", "z3"), ("b", "x", "y")]
    links += [("a", None, "n1"), ("a", "solo", None), ("b", "self", "self"), *links[:20]]
    r.shuffle(links)
    return links


@pytest.mark.parametrize("rows", [10_000, 25, 3])
def test_roots_and_paths(spark, rows):
    links = made(rows)
    frame = spark.createDataFrame(links, "kind string, node string, parent string").withColumn("depth", F.lit(9)).withColumn("via", F.lit("clash"))
    want, parent = brute(links)
    paths = forest.roots(frame, paths=True, rows=rows).cache()
    got = {(r.kind, r.node): (r.root_id, r.depth, list(r.path) if r.path is not None else None) for r in paths.collect()}
    assert got == want
    below = {(r.kind, r.node, r.descendant, r.distance) for r in forest.descendants(paths).collect()}
    assert below == {(k, p, n, len(path) - 1 - i) for (k, n), (_, _, path) in want.items() if path for i, p in enumerate(path[:-1])}
    on = {(r.kind, r.node) for r in forest.circles(frame, paths).collect()}
    assert on == {("b", f"z{k}") for k in range(7)} | {("b", "self")}


def test_empty(spark):
    empty = spark.createDataFrame([], "kind string, node string, parent string")
    assert forest.roots(empty).count() == 0
    assert forest.circles(empty, forest.roots(empty)).count() == 0


def test_stated_by_either_side(spark):
    edges = spark.createDataFrame([], "child_id string, parent_id string")
    classes = spark.createDataFrame([("a", ["b"], None), ("b", [], ["a", "c"]), ("c", None, []), ("d", ["std:E"], None), ("d", ["std:E"], None), (None, ["b"], None)], "class_id string, bases array<string>, subclasses array<string>")
    got = {r.node: (r.root_id, r.depth) for r in forest.roots(forest.fact_links(edges, classes)).join(forest.fact_nodes(edges, classes), ["kind", "node"], "left_semi").collect()}
    assert got == {"a": ("b", 1), "b": ("b", 0), "c": ("b", 1), "d": ("std:E", 1)}
