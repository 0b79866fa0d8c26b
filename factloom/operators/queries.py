"""Queries of the core's data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table, written
from . import forest, json_sql, nested

_FOUND = ["fact_id", "entry_kind", "parent_id", "container_id", "container_ordinal", "map_key", "entry_id"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.entries(table(spark, d, "raw_fact")).select(*_FOUND)


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """The flat value table: each scalar with its relation, place and text."""
    return nested.entries(table(spark, d, "raw_fact")).where("entry_kind = 'value'").select("fact_id", "relation", "parent_id", "container_id", "ordinal", "map_key", "entry_id", "value")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The flat record table: each record with its relation, parent and place."""
    return nested.entries(table(spark, d, "raw_fact")).where("entry_kind = 'record'").select("fact_id", "relation", "parent_id", F.col("entry_id").alias("record_id"), "ordinal")


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "expression_edge"), table(spark, d, "class_index")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = _trees(spark, d)
    return forest.roots(forest.fact_links(*t)).join(forest.fact_nodes(*t), ["kind", "node"], "left_semi").select(F.col("kind").alias("tree_kind"), F.col("node").alias("node_id"), "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node."""
    t = _trees(spark, d)
    paths = written(forest.roots(forest.fact_links(*t), paths=True))
    below = forest.descendants(paths).groupBy("kind", "node").agg(F.count("*").alias("descendants"))
    return paths.join(below, ["kind", "node"], "left").select(F.col("kind").alias("tree_kind"), F.col("node").alias("node_id"), "root_id", "depth", F.array_join("path", " > ").alias("path"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a node and one of its descendants."""
    paths = forest.roots(forest.fact_links(*_trees(spark, d)), paths=True)
    return forest.descendants(paths).select(F.col("kind").alias("tree_kind"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p4_circles(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that stand on a circle."""
    links = forest.fact_links(*_trees(spark, d))
    return forest.circles(links, forest.roots(links)).select(F.col("kind").alias("tree_kind"), F.col("node").alias("node_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


CHAINS = """
WITH RECURSIVE stated AS (
  SELECT 'expression' AS kind, child_id AS node, parent_id AS parent FROM expression_edge
  UNION ALL SELECT 'class', class_id, NULL FROM class_index
  UNION ALL SELECT 'class', class_id, unnest(bases) FROM class_index
  UNION ALL SELECT 'class', unnest(subclasses), class_id FROM class_index),
link AS (SELECT kind, node, max(parent) AS parent FROM stated WHERE node IS NOT NULL GROUP BY ALL),
up AS (
  SELECT kind, node, node AS at, 0 AS depth, [node] AS seen FROM link
  UNION ALL
  SELECT u.kind, u.node, l.parent, u.depth + 1, list_prepend(l.parent, u.seen) FROM up u JOIN link l ON l.kind = u.kind AND l.node = u.at
  WHERE l.parent IS NOT NULL AND NOT list_contains(u.seen, l.parent)),
ends AS (
  SELECT u.kind, u.node, arg_max(u.at, u.depth) AS at, max(u.depth) AS depth, arg_max(u.seen, u.depth) AS seen FROM up u GROUP BY ALL),
done AS (
  SELECT e.kind, e.node, CASE WHEN l.parent IS NULL THEN e.at ELSE '' END AS root_id, CASE WHEN l.parent IS NULL THEN e.depth ELSE -1 END AS depth,
         CASE WHEN l.parent IS NULL THEN e.seen END AS path, l.parent = e.node AS on_circle
  FROM ends e LEFT JOIN link l ON l.kind = e.kind AND l.node = e.at)
"""


def _nested_sql(select: str) -> str:
    """Entries of all families: one common table per list, map or object, and a recursive one for the tree."""
    d, f = json_sql.decoded, json_sql.field
    ctes = [
        "j0 AS (SELECT DISTINCT fact_id, family, CASE WHEN json_valid(payload) THEN TRY_CAST(payload AS JSON) END AS a FROM raw_fact WHERE payload IS NOT NULL)",
        f"j1 AS (SELECT *, {d('a')} AS b FROM j0)", f"j2 AS (SELECT *, {d('b')} AS c FROM j1)", f"j3 AS (SELECT *, {d(f('c', 'fact'))} AS f FROM j2)",
        "fact AS (SELECT fact_id, family, CASE WHEN json_type(f) = 'OBJECT' THEN f ELSE c END AS j FROM j3 WHERE json_type(c) = 'OBJECT')",
    ]
    parts: list[str] = []

    def table_of(sql: str) -> str:
        ctes.append(f"t{len(ctes)} AS ({sql})")
        return f"t{len(ctes) - 1}"

    def places(source: str) -> None:
        """Rows of entries(fact_id, id, path, x, k, key)."""
        kind = "CASE json_type(x) WHEN 'ARRAY' THEN 'container' WHEN 'OBJECT' THEN 'record' ELSE 'value' END"
        entry = "id || '/' || path || ':' || k"
        parts.append(f"SELECT fact_id, {kind} AS entry_kind, id AS parent_id, CASE json_type(x) WHEN 'ARRAY' THEN {entry} ELSE id || '/' || path END AS container_id, CASE json_type(x) WHEN 'ARRAY' THEN k ELSE -1 END AS container_ordinal, key AS map_key, {entry} AS entry_id, path AS relation, k AS ordinal FROM {source}")
        inner = table_of(f"SELECT fact_id, {entry} AS entry, path, k, key, unnest(json_extract(x, '$[*]')) AS y, generate_subscripts(json_extract(x, '$[*]'), 1) - 1 AS j FROM {source} WHERE json_type(x) = 'ARRAY'")
        parts.append(f"SELECT fact_id, 'value', entry, entry, k, key, entry || ':' || j, path, j FROM {inner}")

    def walk(source: str, shape: dict, path: str) -> None:
        """source: rows (fact_id, id, j) of objects."""
        for name, kind in shape.items():
            at = f"{path}.{name}" if path else name
            value = f("j", name)
            if isinstance(kind, dict):
                walk(table_of(f"SELECT fact_id, id, {d(value)} AS j FROM {source}"), kind, at)
            elif kind is map:
                listed = table_of(f"SELECT fact_id, id, list_sort(list_filter({json_sql.pairs(value)}, lambda e: e.key IS NOT NULL)) AS m FROM {source}")
                places(table_of(f"SELECT fact_id, id, '{at}' AS path, e.value AS x, k, e.key AS key FROM (SELECT fact_id, id, unnest(m) AS e, generate_subscripts(m, 1) - 1 AS k FROM {listed})"))
            else:
                listed = table_of(f"SELECT fact_id, id, {json_sql.items(value)} AS m FROM {source}")
                own = table_of(f"SELECT fact_id, id, '{at}' AS path, unnest(m) AS x, generate_subscripts(m, 1) - 1 AS k, '' AS key FROM {listed}")
                places(own)
                if kind is not list:
                    walk(table_of(f"SELECT fact_id, id || '/' || path || ':' || k AS id, x AS j FROM {own} WHERE json_type(x) = 'OBJECT'"), kind[0], at)

    for family, shape in nested.SHAPES.items():
        root = table_of(f"SELECT fact_id, fact_id AS id, j FROM fact WHERE family = '{family}'")
        if family != "SyntaxFact":
            walk(root, shape, "")
            continue
        children = json_sql.items(f("j", "children"))
        ctes.append(
            f"tree AS (SELECT fact_id, id, 'tree' AS path, {d(f('j', 'tree'))} AS j FROM {root} UNION ALL "
            f"SELECT fact_id, id || '/' || path || '.children:' || k, path || '.children', x FROM (SELECT fact_id, id, path, unnest({children}) AS x, generate_subscripts({children}, 1) - 1 AS k FROM tree) WHERE json_type(x) = 'OBJECT')"
        )
        for name in ("modifiers", "children"):
            m = json_sql.items(f("j", name))
            places(table_of(f"SELECT fact_id, id, path || '.{name}' AS path, unnest({m}) AS x, generate_subscripts({m}, 1) - 1 AS k, '' AS key FROM tree"))
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT DISTINCT {select} FROM ({' UNION ALL '.join(parts)})"


def oracle_sql() -> dict[str, str]:
    pairs = "SELECT kind, node AS descendant, depth, unnest(path[:-2]) AS node, generate_subscripts(path[:-2], 1) AS pos FROM done WHERE depth > 0"
    return {
        "p1_found": _nested_sql("fact_id, entry_kind, parent_id, container_id, CAST(container_ordinal AS BIGINT) AS container_ordinal, map_key, entry_id"),
        "p1_records": _nested_sql("CASE WHEN entry_kind = 'record' THEN fact_id END AS fact_id, relation, parent_id, entry_id AS record_id, CAST(ordinal AS BIGINT) AS ordinal").replace("SELECT DISTINCT CASE", "SELECT * FROM (SELECT DISTINCT CASE") + ") WHERE fact_id IS NOT NULL",
        "p4_found": CHAINS + """SELECT kind AS tree_kind, node AS node_id, root_id, CAST(depth AS BIGINT) AS depth FROM done
WHERE (kind, node) IN (SELECT 'expression', child_id FROM expression_edge UNION SELECT 'class', class_id FROM class_index)""",
        "p4_paths": CHAINS + f""", pairs AS ({pairs}), below AS (SELECT kind, node, count(*) AS n FROM pairs GROUP BY ALL)
SELECT d.kind AS tree_kind, d.node AS node_id, root_id, CAST(depth AS BIGINT) AS depth, array_to_string(path, ' > ') AS path, coalesce(n, 0) AS descendants
FROM done d LEFT JOIN below b ON b.kind = d.kind AND b.node = d.node""",
        "p4_descendants": CHAINS + f""", pairs AS ({pairs})
SELECT kind AS tree_kind, node AS node_id, descendant AS descendant_id, CAST(depth - pos + 1 AS BIGINT) AS distance FROM pairs""",
        "p4_circles": CHAINS + "SELECT kind AS tree_kind, node AS node_id FROM done WHERE depth = -1 AND on_circle",
    }
