"""Dependency graphs: coupling, instability, cycles, layers, bounded reach, impact, and changes on trial.

Edges are (source, target) rows. Every loop runs over DataFrames that are written to the shared folder each round; no
graph is collected. Nulls are no nodes; repeated edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import written


def clean(edges: DataFrame) -> DataFrame:
    return edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()


def package_edges(edges: DataFrame, depth: int = 1, separator: str = "\\.") -> DataFrame:
    """Edges between packages (the first parts of module names), each once, with the least module edge as its witness."""
    package = lambda c: F.array_join(F.slice(F.split(c, separator), 1, depth), ".")
    named = clean(edges).select(package("source").alias("a"), package("target").alias("b"), F.struct("source", "target").alias("w")).where("a <> b")
    return named.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.min("w").alias("w")).select("source", "target", F.col("w.source").alias("witness_source"), F.col("w.target").alias("witness_target"))


def coupling(edges: DataFrame) -> DataFrame:
    """node, afferent, efferent, instability (efferent / both; null where there is neither)."""
    edges = clean(edges).where("source <> target")
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("efferent"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("afferent"))
    both = out.join(into, "node", "full").select("node", F.coalesce("afferent", F.lit(0)).alias("afferent"), F.coalesce("efferent", F.lit(0)).alias("efferent"))
    return both.withColumn("instability", F.col("efferent") / F.nullif(F.col("afferent") + F.col("efferent"), F.lit(0)))


def unstable_edges(edges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Edges to a target that is less stable than their source."""
    measure = coupling(edges).select("node", "instability")
    return clean(edges).where("source <> target").join(measure.toDF("source", "source_instability"), "source").join(measure.toDF("target", "target_instability"), "target").where(F.col("target_instability") > F.col("source_instability") + tolerance)


#: Edges one task may hold.
ONE_TASK = 500_000


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of the edges of one task by one depth-first walk with low links, without recursion."""
    after: dict[str, list[str]] = {}
    for batch in batches:
        for a, b in zip(batch["source"], batch["target"]):
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    rows = []
    for root in after:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        walk = [(root, iter(after[root]))]
        while walk:
            node, rest = walk[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    held.append(other)
                    on.add(other)
                    walk.append((other, iter(after[other])))
                    break
                if other in on:
                    low[node] = min(low[node], number[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    members = [held.pop()]
                    while members[-1] != node:
                        members.append(held.pop())
                    on.difference_update(members)
                    if len(members) > 1 or node in after[node]:
                        rows += [(m, min(members)) for m in members]
    yield pd.DataFrame(rows, columns=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least member) of every strongly connected component of two or more nodes, or of a node that points to itself.

    Up to ONE_TASK edges are walked in one task. Of more, nodes that cannot lie on a cycle are peeled off first. Then each
    round colours every node with the least node that reaches it; whoever reaches its colour's root back within the colour
    forms a component and leaves.
    """
    edges = written(clean(edges))
    if edges.count() <= ONE_TASK:
        kind = edges.schema["source"].dataType.simpleString()
        return edges.coalesce(1).mapInPandas(_walked, f"node {kind}, component {kind}")
    loops = edges.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    left = written(edges.where("source <> target"))
    found = [loops]
    while True:
        left = _peeled(left)
        if left.isEmpty():
            break
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colour = _spread(nodes.select("node", F.col("node").alias("colour")), left.select("source", "target"))
        within = left.join(colour.toDF("source", "a"), "source").join(colour.toDF("target", "b"), "target").where("a = b")
        within = written(within.select("source", "target", "a"))
        back = _reach(within.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), within.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("a").alias("root")))
        done = written(back.select("node", F.col("root").alias("component")))
        found.append(done)
        gone = done.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    # A node in a larger component may also point to itself; the larger component names it.
    return out.groupBy("node").agg(F.min("component").alias("component"))


def _peeled(edges: DataFrame) -> DataFrame:
    size = edges.count()
    while size:
        kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = written(kept.join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        now = kept.count()
        edges = kept
        if now == size:
            break
        size = now
    return edges


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with the least colour that reaches it along the edges."""
    colours = written(colours)
    while True:
        came = edges.join(colours.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("came"))
        now = written(colours.join(came, "node", "left").select("node", F.least("colour", F.coalesce("came", "colour")).alias("colour"), (F.col("came") < F.col("colour")).alias("less")))
        colours = now.select("node", "colour")
        if now.where("less").isEmpty():
            return colours


def _reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """All (node, root) reachable from the start along edges of the same root."""
    seen = front = written(start)
    while not front.isEmpty():
        following = front.withColumnRenamed("node", "source").join(edges, ["source", "root"]).select(F.col("target").alias("node"), "root").distinct()
        front = written(following.join(seen, ["node", "root"], "left_anti"))
        seen = written(seen.unionByName(front))
    return seen


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges within a component, with the component."""
    where = components(edges)
    return clean(edges).join(where.toDF("source", "component"), "source").join(where.toDF("target", "other"), "target").where("component = other").drop("other")


def cycles(edges: DataFrame) -> DataFrame:
    """component, its number of members, and its least closing edge."""
    inside = cycle_edges(edges)
    members = F.count_distinct("member")
    return inside.withColumn("w", F.struct("source", "target")).select("component", "w", F.explode(F.array("source", "target")).alias("member")).groupBy("component").agg(members.alias("members"), F.min("w").alias("w")).select("component", "members", F.col("w.source").alias("source"), F.col("w.target").alias("target"))


def layers(edges: DataFrame) -> DataFrame:
    """node, component, layer: nodes that depend on nothing have layer 0, others one more than the highest they depend on; a cycle is one node."""
    edges = clean(edges)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    named = written(nodes.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    flat = written(edges.join(named.toDF("source", "a"), "source").join(named.toDF("target", "b"), "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct())
    done = written(named.select("component").distinct().join(flat.select(F.col("source").alias("component")), "component", "left_anti").withColumn("layer", F.lit(0)))
    left, level = flat, 0
    while not left.isEmpty():
        # What only depends on settled nodes is settled in the next layer.
        level += 1
        open_ = left.join(done.select(F.col("component").alias("target")), "target", "left_anti").select("source").distinct()
        ready = left.select("source").distinct().join(open_, "source", "left_anti")
        done = written(done.unionByName(ready.select(F.col("source").alias("component"), F.lit(level).alias("layer"))))
        left = written(left.join(ready, "source", "left_semi").limit(0).unionByName(left.join(ready, "source", "left_anti")))
    return named.join(done, "component").select("node", "component", "layer")


def reach(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, node, distance of everything within so many steps of each start node (itself left out); each pair once, at its least distance."""
    edges = clean(edges)
    front = written(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("distance")).where("node IS NOT NULL").distinct())
    seen = front
    for k in range(1, depth + 1):
        following = front.select("root", F.col("node").alias("source")).join(edges, "source").select("root", F.col("target").alias("node")).distinct()
        front = written(following.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front))
    return seen.where("distance > 0")


def impact(changed: DataFrame, edges: DataFrame, depth: int = 1_000_000) -> DataFrame:
    """node, distance: what depends on a changed node, directly or through others, and the changed nodes themselves at 0."""
    back = clean(edges).select(F.col("target").alias("source"), F.col("source").alias("target"))
    front = seen = written(changed.select("node", F.lit(0).alias("distance")).where("node IS NOT NULL").distinct())
    for k in range(1, depth + 1):
        following = front.select(F.col("node").alias("source")).join(back, "source").select(F.col("target").alias("node")).distinct()
        front = written(following.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front))
    return seen


def simulated(edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Coupling and cycles as they would be after adding and removing edges, beside those as they are."""
    after = clean(edges)
    if removed is not None:
        after = after.join(clean(removed), ["source", "target"], "left_anti")
    if added is not None:
        after = after.unionByName(clean(added)).distinct()
    return {"coupling_before": coupling(edges), "coupling_after": coupling(after), "cycles_before": cycles(edges), "cycles_after": cycles(after)}
