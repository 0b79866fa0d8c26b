"""Parent-child links as full hierarchies: root, depth, path, descendants and circles.

Weighted disjoint-set forests: the links are range-partitioned by their ids, so that most of a tree lies in one task and
a very large tree or repository is split by size. Each task unites its links and gives every node the topmost id it can
reach there and the offset to it. Only nodes that are the top of another task's trees go on to the next merge. Before it,
their paths are compressed: a coin for each id takes about a quarter of the nodes out, whose children then point past
them, so that every merge has fewer links than the one before, however the ids lie and however long the chains are. A
merge's roots and offsets are then added below it. No task ever holds more than about ROWS links. Nothing is collected.

Defined cases: a null child is no node; a null or absent parent makes a root of depth 0; repeated links count once; of
several parents the greatest id counts; a chain that never ends has root '' and depth -1 and no path; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import written

ROWS = 100_000
_LINK = ["kind", "node", "parent", "weight", "via"]
_OUT = "kind string, node string, top string, depth long, via array<string>"


def _unite(paths: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Topmost reachable id, offset and (if asked) the ids on the way, for every node of one task; -1: a circle."""
    parent: dict[tuple[str, str], tuple[str | None, int, list[str]]] = {}
    for batch in batches:
        for kind, node, up, weight, via in zip(batch["kind"], batch["node"], batch["parent"], batch["weight"], batch["via"]):
            parent[kind, node] = (up, weight, list(via) if via is not None else [])
    done: dict[tuple[str, str], tuple[str, int, list[str]]] = {}
    for start in parent:
        trail, at, seen = [], start, set()
        while at in parent and at not in done and at not in seen and parent[at][0] is not None:
            seen.add(at)
            trail.append(at)
            at = (at[0], parent[at][0])
        if at in done:
            top, depth, way = done[at]
        elif at in seen:
            top, depth, way = "", -1, []
        else:
            top, depth, way = at[1], 0, []
            if at in parent:
                done[at] = (top, 0, way)
        for key in reversed(trail):
            _, weight, via = parent[key]
            depth = depth if depth < 0 else depth + weight
            way = way + via if paths and depth >= 0 else way
            done[key] = (top, depth, way)
    rows = [(k, n, t, d, w) for (k, n), (t, d, w) in done.items()]
    for at in range(0, max(1, len(rows)), 50_000):
        yield pd.DataFrame(rows[at : at + 50_000], columns=["kind", "node", "top", "depth", "via"])


def _local(links: DataFrame, parts: int, paths: bool) -> DataFrame:
    spread = links.coalesce(1) if parts == 1 else links.repartitionByRange(parts, "kind", "node")
    return spread.mapInPandas(lambda batches: _unite(paths, batches), _OUT)


def _onto(low: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with a top and the offset to it, carried on to the top's own top where it has one."""
    up = above.select("kind", F.col("node").alias("top"), F.col("top").alias("root"), F.col("depth").alias("more"), F.col("via").alias("before"))
    loop, met = F.col("more") < 0, F.col("more").isNotNull() & (F.col("depth") > 0)
    return low.join(up, ["kind", "top"], "left").select(
        "kind", "node", F.when(met, F.when(loop, "").otherwise(F.col("root"))).otherwise(F.col("top")).alias("top"),
        F.when(met, F.when(loop, F.lit(-1)).otherwise(F.col("depth") + F.col("more"))).otherwise(F.col("depth")).cast("long").alias("depth"),
        F.when(met & ~loop, F.concat("before", "via")).otherwise(F.when(met, F.array().cast("array<string>")).otherwise(F.col("via"))).alias("via"),
    )


def _compressed(links: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The links without the nodes a coin takes out, whose children point past them, and those taken out.

    A node leaves where its own coin shows tails and its parent's heads, so the node it is passed on to stays.
    """
    coin = lambda c: F.expr(f"pmod(xxhash64(kind, {c}, {level}), 2)") == 1
    out = ~coin("node") & coin("parent")
    gone = links.where(out)
    past = gone.select("kind", F.col("node").alias("parent"), F.col("parent").alias("beyond"), F.col("weight").alias("further"), F.col("via").alias("before"))
    kept = links.where(~out).join(past, ["kind", "parent"], "left").select(
        "kind", "node", F.coalesce("beyond", "parent").alias("parent"), (F.col("weight") + F.coalesce("further", F.lit(0))).alias("weight"),
        F.when(F.col("beyond").isNull(), F.col("via")).otherwise(F.concat("before", "via")).alias("via"),
    )
    return kept, gone


def _resolve(links: DataFrame, count: int, rows: int, paths: bool, level: int = 0) -> DataFrame:
    parts = max(1, math.ceil(count / rows))
    local = _local(links, parts, paths)
    if parts == 1:
        return local
    local = written(local)
    tops = local.where("depth > 0").groupBy("kind", "top").agg(F.lit(1).alias("one"))
    # A node that is the top of another task's trees and has a parent here: a link of the next merge.
    on = written(local.where("depth <> 0").join(tops.select("kind", F.col("top").alias("node")), ["kind", "node"], "left_semi").select("kind", "node", F.when(F.col("depth") > 0, F.col("top")).otherwise(F.col("node")).alias("parent"), F.abs("depth").alias("weight"), "via"))
    left = on.count()
    if not left:
        return local
    if left <= rows:
        return _onto(local, _local(on, 1, paths))
    kept, gone = _compressed(on, level)
    kept, gone = written(kept), written(gone)
    above = written(_resolve(kept, kept.count(), rows, paths, level + 1))
    out = _onto(gone.select("kind", "node", F.col("parent").alias("top"), F.col("weight").alias("depth"), "via"), above)
    return _onto(local, written(above.unionByName(out)))


def roots(links: DataFrame, paths: bool = False, rows: int = ROWS) -> DataFrame:
    """kind, node, root_id, depth (and path: the ids from the root to the node) of every node of links(kind, node, parent)."""
    one = links.where(F.col("node").isNotNull()).groupBy("kind", "node").agg(F.max("parent").alias("parent"))
    via = F.array("node") if paths else F.array().cast("array<string>")
    one = written(one.select("kind", "node", "parent", F.lit(1).cast("long").alias("weight"), via.alias("via")))
    out = _resolve(one, one.count(), rows, paths)
    out = out.select("kind", "node", F.col("top").alias("root_id"), "depth", "via")
    if not paths:
        return out.drop("via")
    # A root's way starts with itself; an outside root is put before the way of its nodes.
    path = F.when(F.col("depth") < 0, F.lit(None).cast("array<string>")).when(F.col("depth") == 0, F.array("node")).otherwise(F.concat(F.array("root_id"), F.col("via")))
    return out.withColumn("path", path).drop("via")


def descendants(paths: DataFrame) -> DataFrame:
    """kind, node, descendant, distance for every pair of a node and one below it, from the nodes' paths."""
    return paths.where(F.size("path") > 1).select("kind", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node")).where("at < depth").select("kind", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def circles(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """kind, node of every node that stands on a circle itself: where chains of at least as many steps as there are such nodes end."""
    loops = resolved.where("depth < 0").select("kind", "node")
    hop = written(links.where(F.col("node").isNotNull()).groupBy("kind", "node").agg(F.max("parent").alias("to")).join(loops, ["kind", "node"], "left_semi"))
    count = hop.count()
    for _ in range(math.ceil(math.log2(count + 1)) + 1 if count else 0):
        hop = written(hop.join(hop.select("kind", F.col("node").alias("to"), F.col("to").alias("next")), ["kind", "to"]).select("kind", "node", F.col("next").alias("to")))
    return hop.select("kind", F.col("to").alias("node")).distinct()


def fact_links(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """The links of expression edges and of class indexes (stated by the child, the parent or both) as kind, node, parent."""
    expression = edges.select(F.lit("expression").alias("kind"), F.col("child_id").alias("node"), F.col("parent_id").alias("parent"))
    kind = F.lit("class").alias("kind")
    own = classes.select(kind, F.col("class_id").alias("node"), F.lit(None).cast("string").alias("parent"))
    up = classes.select(kind, F.col("class_id").alias("node"), F.explode("bases").alias("parent"))
    down = classes.select(kind, F.explode("subclasses").alias("node"), F.col("class_id").alias("parent"))
    return expression.unionByName(own).unionByName(up).unionByName(down)


def fact_nodes(edges: DataFrame, classes: DataFrame) -> DataFrame:
    return edges.select(F.lit("expression").alias("kind"), F.col("child_id").alias("node")).unionByName(classes.select(F.lit("class").alias("kind"), F.col("class_id").alias("node"))).where(F.col("node").isNotNull()).distinct()
