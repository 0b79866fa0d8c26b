"""Queries of the reference's own operators on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..session import table
from . import clones, forest, graphs, history, prose, quantiles, text
from .queries import CHAINS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- history ----------------------------------------------------------------------------------------------------------

_FILES = """
WITH files AS (
  SELECT *, coalesce(author_count, 0) + coalesce(additional_commit_count, 0) AS commit_count FROM file_history
  QUALIFY row_number() OVER (PARTITION BY repository, path ORDER BY recorded_at DESC NULLS LAST, line_count DESC NULLS LAST) = 1)
"""


@query(_FILES + """, b AS (SELECT *, max(commit_count) OVER (PARTITION BY repository) AS busiest FROM files)
SELECT repository, path, line_count, commit_count, busiest FROM b
WHERE line_count >= 200 AND commit_count >= 2 AND commit_count >= busiest * 0.5 AND days_since_last_change <= 180""")  # fmt: skip
def hist_busy_files(spark: SparkSession, d: str) -> DataFrame:
    return history.busy(history.files(table(spark, d, "file_history")), minimum_lines=200).select("repository", "path", "line_count", "commit_count", "busiest")


@query(_FILES + "SELECT repository, path, author_count, commit_count FROM files WHERE author_count >= 4 AND commit_count >= 5")
def hist_many_hands(spark: SparkSession, d: str) -> DataFrame:
    return history.many_hands(history.files(table(spark, d, "file_history"))).select("repository", "path", "author_count", "commit_count")


_PAIRS = """
WITH c AS (SELECT DISTINCT n_name AS repository, o_orderkey AS "commit", CAST(l_partkey AS VARCHAR) AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
w AS (SELECT repository, "commit" FROM c GROUP BY ALL HAVING count(*) <= 30),
f AS (SELECT c.* FROM c JOIN w USING (repository, "commit")),
a AS (SELECT repository, file, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT l.repository, l.file AS "left", r.file AS "right", count(*) AS shared FROM f l JOIN f r ON l.repository = r.repository AND l."commit" = r."commit" AND l.file < r.file GROUP BY ALL)
SELECT p.*, x.n AS left_commits, y.n AS right_commits FROM p JOIN a x ON x.repository = p.repository AND x.file = p."left" JOIN a y ON y.repository = p.repository AND y.file = p."right"
WHERE shared >= 1 AND shared >= least(x.n, y.n) * 0.5
"""


@query(_PAIRS)
def hist_cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts ordered together, as files changed together; the nation of the customer stands for the repository."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    owner = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    changes = lines.join(orders, "o_orderkey").join(owner, "c_custkey").select(F.col("n_name").alias("repository"), F.col("o_orderkey").alias("commit"), F.col("l_partkey").cast("string").alias("file"))
    return history.coupled(history.cochange(changes), minimum_shared=1).select("repository", "left", "right", "shared", "left_commits", "right_commits")


# --- graphs -----------------------------------------------------------------------------------------------------------

_EDGES = "WITH e AS (SELECT DISTINCT source, target FROM (SELECT repository || '/' || module AS target, repository || '/' || unnest(importers) AS source FROM class_index) WHERE source IS NOT NULL AND target IS NOT NULL)"
_COUPLING = """, x AS (SELECT * FROM e WHERE source <> target),
o AS (SELECT source AS node, count(*) AS efferent FROM x GROUP BY ALL), i AS (SELECT target AS node, count(*) AS afferent FROM x GROUP BY ALL),
m AS (SELECT coalesce(o.node, i.node) AS node, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent, coalesce(efferent, 0) / (coalesce(afferent, 0) + coalesce(efferent, 0)) AS instability FROM o FULL JOIN i ON o.node = i.node)
"""


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Module import edges: an importer depends on the module."""
    classes = table(spark, d, "class_index")
    return classes.select(F.concat_ws("/", "repository", "module").alias("target"), F.explode("importers").alias("i"), "repository").select(F.concat_ws("/", "repository", "i").alias("source"), "target")


@query(_EDGES + _COUPLING + "SELECT * FROM m")
def arch_coupling(spark: SparkSession, d: str) -> DataFrame:
    return graphs.coupling(_imports(spark, d))


@query(_EDGES + _COUPLING + "SELECT source, target, a.instability AS source_instability, b.instability AS target_instability FROM x JOIN m a ON a.node = source JOIN m b ON b.node = target WHERE b.instability > a.instability")
def arch_unstable_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graphs.unstable_edges(_imports(spark, d)).select("source", "target", "source_instability", "target_instability")


@query("""WITH e AS (SELECT repository, split_part(module, '.', 1) AS b, split_part(unnest(importers), '.', 1) AS a, module, unnest(importers) AS i FROM class_index)
SELECT repository || '.' || a AS source, repository || '.' || b AS target, count(DISTINCT (i, module)) AS edges FROM e WHERE a <> b GROUP BY ALL""")
def arch_package_edges(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "class_index").select("repository", "module", F.explode("importers").alias("i"))
    package = lambda c: F.concat_ws(".", "repository", F.substring_index(c, ".", 1))
    return classes.distinct().withColumns({"source": package("i"), "target": package("module")}).where("source <> target").groupBy("source", "target").agg(F.count_distinct("i", "module").alias("edges"))


_TRADE = """WITH RECURSIVE e AS (SELECT DISTINCT c.c_nationkey AS source, s.s_nationkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c.c_custkey = o_custkey JOIN supplier s ON s.s_suppkey = l_suppkey),
r AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b)"""


def _trade(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(buyers, "l_orderkey").join(sellers, "l_suppkey").select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"))


@query(_TRADE + """, c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, component FROM c""")
def arch_components(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of the trade between nations."""
    return graphs.components(_trade(spark, d))


@query(_TRADE + """, c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
i AS (SELECT e.source, e.target, a.component FROM e JOIN c a ON a.node = e.source JOIN c b ON b.node = e.target WHERE a.component = b.component)
SELECT component, (SELECT count(*) FROM c k WHERE k.component = i.component) AS members, arg_min(source, (source, target)) AS source, arg_min(target, (source, target)) AS target FROM i GROUP BY component""")
def arch_import_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles with their members and first closing edge."""
    return graphs.cycles(_trade(spark, d))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p.p_brand AS source, q.p_brand AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey WHERE p.p_brand > q.p_brand),
n AS (SELECT source AS node FROM e UNION SELECT target FROM e),
w AS (SELECT node, 0 AS layer FROM n UNION SELECT e.source, w.layer + 1 FROM w JOIN e ON e.target = w.node)
SELECT node, node AS component, CAST(max(layer) AS INTEGER) AS layer FROM w GROUP BY node""")
def arch_layers(spark: SparkSession, d: str) -> DataFrame:
    """Topological layers of brands ordered together (an edge leads from the greater to the lesser name)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("b"))
    pair = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", 1, i), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return graphs.layers(lines.select(F.explode(pair).alias("p")).select("p.*").distinct())


_FLOW = """WITH e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    made = lambda t, s, sc, k, tc: table(spark, d, t).select(F.concat(F.lit(s), sc).alias("source"), F.concat(F.lit(k), tc).alias("target"))
    return made("nation", "r", "n_regionkey", "n", "n_nationkey").union(made("customer", "n", "c_nationkey", "c", "c_custkey")).union(made("supplier", "n", "s_nationkey", "s", "s_suppkey")).union(made("orders", "c", "o_custkey", "o", "o_orderkey"))


@query(_FLOW + """, a AS (SELECT source AS root, target AS node, 1 AS distance FROM e WHERE source LIKE 'r%' OR source LIKE 'n%'),
b AS (SELECT root, e.target AS node, 2 AS distance FROM a JOIN e ON e.source = a.node), c AS (SELECT root, e.target AS node, 3 AS distance FROM b JOIN e ON e.source = b.node),
u AS (SELECT root, node, min(distance) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL)
SELECT root, count(*) AS downstream, max(distance) AS farthest FROM u GROUP BY ALL HAVING count(*) >= 3""")
def data_lineage_reach(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with at least 3 distinct ones downstream within 3 steps."""
    edges = _flow(spark, d)
    start = edges.select(F.col("source").alias("node")).where("node LIKE 'r%' OR node LIKE 'n%'").distinct()
    return graphs.reach(start, edges, 3).groupBy("root").agg(F.count("*").alias("downstream"), F.max("distance").alias("farthest")).where("downstream >= 3")


@query(_FLOW.replace("WITH e", "WITH RECURSIVE e") + """, w AS (SELECT 'o' || o_orderkey AS node, 0 AS distance FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.source, w.distance + 1 FROM w JOIN e ON e.target = w.node)
SELECT node, min(distance) AS distance FROM w GROUP BY node""")
def arch_change_impact(spark: SparkSession, d: str) -> DataFrame:
    """What urgent orders reach upwards, with the least distance."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graphs.impact(urgent, _flow(spark, d))


# --- prose ------------------------------------------------------------------------------------------------------------

_SENTENCES = r"""list_filter(string_split_regex(regexp_replace(text, '`[^`]*`', ' ', 'g'), '[.!?]+'), lambda s: length(trim(regexp_replace(s, '\s+', ' ', 'g'))) > 0)"""
_WORDS = r"""list_filter(string_split(trim(regexp_replace({}, '\s+', ' ', 'g')), ' '), lambda w: length(w) > 0)"""
_UNIFORM = """
SELECT doc_id AS fact_id, CASE WHEN n >= {least} THEN greatest(0, 1 - list_sum(list_transform(k, lambda x: abs(x - m))) / n / m) * 100 ELSE 0.0 END AS uniformity FROM
 (SELECT doc_id, k, len(k) AS n, list_sum(k) / len(k) AS m FROM (SELECT doc_id, list_filter(c, lambda x: x >= {words}) AS k FROM (SELECT doc_id, {counts} AS c FROM documents)))
"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.lit(0).alias("ordinal"), "text")


@query(_UNIFORM.format(least=5, words=3, counts=f"list_transform({_SENTENCES}, lambda s: len({_WORDS.format('s')}))"))
def writ_sentence_uniformity(spark: SparkSession, d: str) -> DataFrame:
    return prose.sentence_uniformity(_sections(spark, d))


@query(_UNIFORM.format(least=3, words=10, counts=r"list_transform(list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda p: length(trim(regexp_replace(p, '\s+', ' ', 'g'))) > 0), lambda p: len(" + _WORDS.format("p") + "))"))
def writ_paragraph_uniformity(spark: SparkSession, d: str) -> DataFrame:
    return prose.paragraph_uniformity(_sections(spark, d), minimum_paragraphs=3, minimum_words=10)


@query(f"""WITH o AS (SELECT doc_id, unnest(list_transform({_SENTENCES}, lambda s: lower({_WORDS.format('s')}[1]))) AS opener FROM documents),
c AS (SELECT doc_id, opener, count(*) AS n FROM o WHERE opener NOT IN ('a', 'i') GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS a, arg_min(opener, (-n, opener)) AS opener, max(n) AS n FROM c GROUP BY ALL HAVING sum(n) >= 6)
SELECT d.doc_id AS fact_id, opener, coalesce(n * 100.0 / a, 0.0) AS share FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""")
def writ_opener_concentration(spark: SparkSession, d: str) -> DataFrame:
    return prose.opener_concentration(_sections(spark, d))


# --- comments, literals and lines -------------------------------------------------------------------------------------

_GROUPS = "WITH g AS (SELECT * FROM comment_group WHERE {} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_LITERAL = r"""regexp_extract(expression, '(?s)^\s*[A-Za-z]{{0,2}}(?:"""+'"""(.*)"""'+r"""|''''''(.*)''''''|"(.*)"|''(.*)''|`(.*)`)\s*$', {})"""
_TEXT = "coalesce(" + ", ".join(f"nullif({_LITERAL.format(k)}, '')" for k in range(1, 6)) + ")"


@query(_GROUPS.format("body") + """, o AS (SELECT *, coalesce(token_count, 0) AS size FROM g WHERE coalesce(kind, '') <> 'documentation' AND NOT regexp_matches(lower(body), 'spdx-license-identifier|copyright|licensed under|all rights reserved'))
SELECT repository, path, group_id, size, least(100.0, size * 100.0 / 200) AS share FROM o QUALIFY row_number() OVER (PARTITION BY repository, path ORDER BY size DESC, start_line NULLS FIRST, group_id) = 1""")
def comm_length(spark: SparkSession, d: str) -> DataFrame:
    return text.comment_length(table(spark, d, "comment_group"))


@query(_GROUPS.format("body") + r""", l AS (SELECT repository, path, group_id, unnest(string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS k FROM g),
m AS (SELECT *, lower(regexp_extract(line, '^\s*(?:#+|/{2,}|/?\*+|--|;+)?\s*(\p{L}+)', 1)) AS marker FROM l)
SELECT repository, path, group_id, CAST(k AS INTEGER) AS line_in_group, marker FROM m WHERE marker IN ('todo', 'fixme', 'xxx', 'hack')""")
def comm_work_markers(spark: SparkSession, d: str) -> DataFrame:
    return text.work_markers(table(spark, d, "comment_group"))


@query(_GROUPS.format("expression") + r"""SELECT repository, path, group_id, regexp_extract(expression, '^\s*["'']([-=_*#~.+])', 1) AS sign, CAST(regexp_extract(expression, '\*\s*(\d{1,6})\s*$', 1) AS BIGINT) AS repetitions FROM g
WHERE regexp_matches(expression, '^\s*["''](-+|=+|_+|\*+|#+|~+|\.+|\++)["'']\s*\*\s*\d{1,6}\s*$') AND CAST(regexp_extract(expression, '\*\s*(\d{1,6})\s*$', 1) AS BIGINT) >= 3""")
def stri_separators(spark: SparkSession, d: str) -> DataFrame:
    return text.separators(table(spark, d, "comment_group"))


@query(_GROUPS.format("expression") + f""", l AS (SELECT {_TEXT} AS literal, repository, path FROM g)
SELECT literal, count(*) AS occurrences, count(DISTINCT (repository, path)) AS files FROM l WHERE length(literal) >= 4 GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT (repository, path)) >= 2""")
def dupl_repeated_literals(spark: SparkSession, d: str) -> DataFrame:
    return text.repeated_literals(table(spark, d, "comment_group"), minimum_occurrences=2, minimum_length=4)


_ROUTES = _GROUPS.format("expression") + f""", l AS (SELECT repository, path, group_id, nullif(regexp_extract({_TEXT}, '^https?://[^/?#]+(/[^?#]*)', 1), '') AS route FROM g), r AS (SELECT * FROM l WHERE route IS NOT NULL)
"""


@query(_ROUTES + "SELECT * FROM r")
def rout_routes(spark: SparkSession, d: str) -> DataFrame:
    return text.routes(table(spark, d, "comment_group"))


@query(_ROUTES + "SELECT repository, route, count(*) AS places FROM r GROUP BY ALL HAVING count(*) > 1")
def rout_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return text.duplicate_routes(text.routes(table(spark, d, "comment_group")))


@query(r"""WITH f AS (SELECT repository, unnest(string_split(path, '/')) AS segment FROM source_file WHERE path IS NOT NULL AND repository IS NOT NULL),
c AS (SELECT repository, sum(CAST(contains(segment, '-') AS INTEGER)) AS h, sum(CAST(contains(segment, '_') AS INTEGER)) AS u FROM f WHERE segment <> '' AND NOT contains(segment, '{') GROUP BY ALL)
SELECT repository, CASE WHEN h > u THEN '-' ELSE '_' END AS convention, CAST(least(h, u) AS BIGINT) AS segments FROM c WHERE h > 0 AND u > 0 AND h <> u""")
def rout_minority_style(spark: SparkSession, d: str) -> DataFrame:
    return text.minority_segments(table(spark, d, "source_file").where("repository IS NOT NULL").select("repository", F.col("path").alias("route")))


@query()
def secu_credentials(spark: SparkSession, d: str) -> DataFrame:
    return text.credentials(table(spark, d, "source_file"))


# --- clones -----------------------------------------------------------------------------------------------------------

_CLONE = """
WITH token AS (SELECT stream_id, token_no, min({'s': symbol, 'i': identity}) AS t FROM clone_token WHERE stream_id IS NOT NULL AND token_no IS NOT NULL GROUP BY ALL),
run AS (SELECT stream_id, token_no, list(t) OVER w AS g, max(token_no) OVER w AS last FROM token WINDOW w AS (PARTITION BY stream_id ORDER BY token_no ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
whole AS (SELECT stream_id, token_no, md5(CAST(g AS VARCHAR)) AS g FROM run WHERE len(g) = 40 AND last = token_no + 39),
many AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM whole QUALIFY n > 1),
nxt AS (SELECT a.*, b.g AS next, b.n AS next_n FROM many a LEFT JOIN many b ON b.stream_id = a.stream_id AND b.token_no = a.token_no + 1),
link AS (SELECT g, count(DISTINCT next) = 1 AND count(next) = max(n) AND max(next_n) = max(n) AS linked FROM nxt GROUP BY g),
mark AS (SELECT m.stream_id, m.token_no, m.g, l.linked, coalesce(lag(l.linked) OVER w AND lag(m.token_no) OVER w = m.token_no - 1, false) AS goes FROM many m JOIN link l ON l.g = m.g WINDOW w AS (PARTITION BY m.stream_id ORDER BY m.token_no)),
r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY token_no) AS k FROM mark),
place AS (SELECT stream_id, k, min(token_no) AS first_token, count(*) + 39 AS length, arg_min(g, token_no) AS clone FROM r GROUP BY stream_id, k)
"""


@query(_CLONE + "SELECT stream_id, first_token, length FROM place")
def dupl_clone_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of maximal clones."""
    return clones.groups(table(spark, d, "clone_token")).select("stream_id", "first_token", "length")


@query(_CLONE + "SELECT length, copies, streams, count(*) AS clones FROM (SELECT clone, max(length) AS length, count(*) AS copies, count(DISTINCT stream_id) AS streams FROM place GROUP BY clone) GROUP BY ALL")
def dupl_clone_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Clone groups by length and copies."""
    return clones.summary(clones.groups(table(spark, d, "clone_token"))).groupBy("length", "copies", "streams").agg(F.count("*").alias("clones"))


# --- classes, calls and scans -----------------------------------------------------------------------------------------


@query(CHAINS.replace("'expression' AS kind, child_id AS node, parent_id AS parent FROM expression_edge", "'class' AS kind, NULL AS node, NULL AS parent") + "SELECT node AS class_id, CAST(depth AS BIGINT) AS ancestors FROM done WHERE node IN (SELECT class_id FROM class_index)")
def clas_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Number of ancestors of each class; -1 where its chain never ends."""
    edges, classes = table(spark, d, "expression_edge"), table(spark, d, "class_index")
    links = forest.fact_links(edges.limit(0), classes)
    return forest.roots(links).join(classes.select(F.col("class_id").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("class_id"), F.col("depth").alias("ancestors"))


@query("""WITH c AS (SELECT DISTINCT key, nullif(lower(split_part(replace(trim(language), '_', '-'), '-', 1)), '') AS language, is_test, len(module_bindings) AS bindings FROM call_record)
SELECT language, count(*) AS calls, sum(CAST(is_test AS INTEGER)) AS in_tests, coalesce(sum(bindings), 0) AS bindings, count(bindings) AS with_bindings FROM c GROUP BY ALL""")
def call_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "call_record").select("key", C.plain_language(F.col("language")).alias("language"), "is_test", F.when(F.col("module_bindings").isNotNull(), F.size("module_bindings")).alias("bindings")).distinct()
    return rows.groupBy("language").agg(F.count("*").alias("calls"), F.sum(F.col("is_test").cast("int")).alias("in_tests"), C.total("bindings").alias("bindings"), F.count("bindings").alias("with_bindings"))


@query("""WITH s AS (SELECT * FROM scan_stats QUALIFY row_number() OVER (PARTITION BY repository ORDER BY finished_at DESC NULLS LAST, scan_id DESC) = 1)
SELECT repository, file_count, parse_failure_count, CASE WHEN parse_failure_count IS NULL OR file_count = 0 THEN NULL ELSE parse_failure_count / file_count END AS failure_rate,
CASE WHEN parse_failure_count IS NULL THEN 'unknown' WHEN parse_failure_count = 0 THEN 'clean' WHEN parse_failure_count * 20 <= file_count THEN 'minor' ELSE 'major' END AS state FROM s""")
def scan_states(spark: SparkSession, d: str) -> DataFrame:
    """The latest scan of each repository with a category of its failures."""
    from .facts import first_per

    last = first_per(table(spark, d, "scan_stats"), ["repository"], F.col("finished_at").desc_nulls_last(), F.col("scan_id").desc())
    failures = F.col("parse_failure_count")
    state = F.when(failures.isNull(), "unknown").when(failures == 0, "clean").when(failures * 20 <= F.col("file_count"), "minor").otherwise("major")
    return last.select("repository", "file_count", "parse_failure_count", C.ratio(failures, F.nullif(F.col("file_count"), F.lit(0)), None).alias("failure_rate"), state.alias("state"))


# --- windows, joins and aggregates with the reference's null behaviour -------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, next_order FROM (SELECT o_custkey, o_orderkey, o_orderpriority, lead(o_orderpriority) OVER w AS p, lead(o_orderkey) OVER w AS next_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE o_orderpriority = p""")
def para_adjacent_equal(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring rows of equal kind."""
    return text.adjacent_equal(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderkey", "o_orderpriority").select("o_custkey", "o_orderkey", "next_order")


@query("""SELECT o_custkey, o_orderkey, actual_rank, expected_rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS actual_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS expected_rank FROM orders) WHERE actual_rank <> expected_rank""")
def clas_canonical_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stand out of the canonical order."""
    return text.out_of_order(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderkey"], ["o_orderdate"]).select("o_custkey", "o_orderkey", "actual_rank", "expected_rank")


@query("""SELECT l_orderkey // 1000 AS bucket, count(DISTINCT nullif(l_linestatus, 'F')) + max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS kinds, bool_or(l_returnflag = 'R') AS some, bool_and(l_quantity > 1) AS every_one,
 coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS returned, list(l_linenumber ORDER BY l_shipdate, l_orderkey, l_linenumber)[1] AS first_line FROM lineitem GROUP BY ALL""")
def ops_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Null-aware distinct counts, filtered sums, quantifiers, and the first value in an order."""
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey div 1000").alias("bucket"), "l_linestatus", "l_returnflag", "l_quantity", "l_linenumber", "l_shipdate", "l_orderkey")
    return rows.groupBy("bucket").agg(
        C.n_unique(F.nullif(F.col("l_linestatus"), F.lit("F"))).alias("kinds"), C.any_true(F.col("l_returnflag") == "R").alias("some"), C.all_true(F.col("l_quantity") > 1).alias("every_one"),
        C.total(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.min_by("l_linenumber", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_line"),
    )


@query("""SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) s ON c.c_nationkey = s.s_nationkey""")
def ops_full_join(spark: SparkSession, d: str) -> DataFrame:
    """A full join with one key column."""
    c = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)")
def ops_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a partner in one table and with one in another."""
    c = table(spark, d, "customer")
    return c.join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("""WITH t AS (SELECT l_orderkey AS test, md5(string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag || l_linestatus)) AS body, list(DISTINCT l_suppkey % 10 ORDER BY l_suppkey % 10) AS reach FROM lineitem GROUP BY ALL)
SELECT array_to_string(reach, ',') AS reach, count(*) AS tests, count(DISTINCT body) AS intents FROM t GROUP BY ALL HAVING count(*) >= 4 AND count(DISTINCT body) > 1 AND 2 * count(DISTINCT body) <= count(*)""")
def test_reach_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tests that reach the same suppliers with few distinct bodies."""
    from .facts import ordered

    tests = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("test")).agg(F.md5(F.array_join(ordered(F.concat("l_returnflag", "l_linestatus"), "l_linenumber"), ",")).alias("body"), F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey") % 10)), ",").alias("reach"))
    return tests.groupBy("reach").agg(F.count("*").alias("tests"), F.count_distinct("body").alias("intents")).where("tests >= 4 AND intents > 1 AND 2 * intents <= tests")


@query("""SELECT o_orderpriority, count(*) AS orders, list(o_totalprice ORDER BY o_totalprice)[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1] AS p90 FROM orders GROUP BY ALL""")
def ops_quantile(spark: SparkSession, d: str) -> DataFrame:
    """A quantile at the nearest rank."""
    return quantiles.nearest_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 0.9).select("o_orderpriority", F.col("count").alias("orders"), F.col("value").alias("p90"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS fact, l_linenumber AS s, l_linenumber + CAST(l_quantity AS INTEGER) % 4 AS e FROM lineitem),
d AS (SELECT t.fact, t.s, count(*) AS depth FROM (SELECT DISTINCT fact, s FROM b) t JOIN b a ON a.fact = t.fact AND a.s <= t.s AND t.s <= a.e GROUP BY ALL)
SELECT fact, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY ALL HAVING max(depth) > 3""")
def cont_nesting_depth(spark: SparkSession, d: str) -> DataFrame:
    """Greatest number of intervals that enclose one start, counted by a sweep over starts and ends instead of a range join."""
    from pyspark.sql import Window

    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").cast("long").alias("s"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).cast("long").alias("e")).distinct()
    events = b.select("fact", F.col("s").alias("at"), F.lit(1).alias("n")).unionByName(b.select("fact", (F.col("e") + 1).alias("at"), F.lit(-1).alias("n")))
    sums = events.groupBy("fact", "at").agg(F.sum("n").alias("n"))
    depth = F.sum("n").over(Window.partitionBy("fact").orderBy("at"))
    return sums.withColumn("depth", depth).groupBy("fact").agg(F.max("depth").alias("depth")).where("depth > 3")


@query("""SELECT p_partkey, upper(p_brand) AS brand, ltrim(p_name, 'abc') AS from_start, rtrim(p_name, 'xyz ') AS from_end, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
 CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS no_prefix, CASE WHEN suffix(p_type, 'e') THEN left(p_type, length(p_type) - 1) ELSE p_type END AS no_suffix,
 CAST(substring(p_name, 2, 3) AS VARCHAR) AS bytes, CAST(len(list_distinct(string_split(p_name, ' '))) AS BIGINT) AS kinds, len(list_filter(string_split(p_name, ' '), lambda w: length(w) < 3)) = 0 AS all_long,
 CAST(p_size AS UINTEGER)::BIGINT AS unsigned, round(ln(p_retailprice), 6) AS log_price, p_size BETWEEN 10 AND 20 AS middle, coalesce(p_size, 0) + coalesce(nullif(p_size, 7), 0) AS summed FROM part""")
def ops_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Text, list, binary and number expressions over one row."""
    parts = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.upper("p_brand").alias("brand"), C.strip_start(F.col("p_name"), "abc").alias("from_start"), C.strip_end(F.col("p_name"), "xyz ").alias("from_end"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        C.without_prefix(F.col("p_brand"), "Brand#").alias("no_prefix"), C.without_suffix(F.col("p_type"), "e").alias("no_suffix"), F.substring(F.col("p_name").cast("binary"), 2, 3).cast("string").alias("bytes"),
        F.size(F.array_distinct(parts)).cast("long").alias("kinds"), F.forall(parts, lambda w: F.length(w) >= 3).alias("all_long"), C.unsigned(F.col("p_size")).alias("unsigned"), F.round(F.log("p_retailprice"), 6).alias("log_price"),
        F.col("p_size").between(10, 20).alias("middle"), C.sum_across(F.col("p_size"), F.nullif(F.col("p_size"), F.lit(7))).alias("summed"),
    )


@query("""WITH r AS (SELECT * FROM region), n AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS customers, avg(c_acctbal) AS mean FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT r_name, n_nationkey, r_regionkey AS left_key, n_regionkey AS right_key, customers, round(mean, 6) AS mean, first_nation, last_nation FROM r FULL JOIN n ON r_regionkey = n_regionkey AND customers > 3
LEFT JOIN (SELECT n_regionkey AS k, arg_min(n_name, n_nationkey) AS first_nation, arg_max(n_name, n_nationkey) AS last_nation FROM nation GROUP BY ALL) ON k = r_regionkey""")
def ops_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    """First, last and mean of groups; a full join that keeps both keys; and a join whose right side is checked to have one row for each key."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.mean("c_acctbal").alias("mean"))
    nation = table(spark, d, "nation")
    n = nation.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.col("n_regionkey").alias("right_key"), F.coalesce("customers", F.lit(0)).alias("customers"), F.round("mean", 6).alias("mean"))
    r = table(spark, d, "region").select("r_name", F.col("r_regionkey").alias("left_key"))
    both = r.join(n, (F.col("left_key") == F.col("right_key")) & (F.col("customers") > 3), "full")
    ends = nation.groupBy(F.col("n_regionkey").alias("left_key")).agg(F.min_by("n_name", "n_nationkey").alias("first_nation"), F.max_by("n_name", "n_nationkey").alias("last_nation"))
    return C.join_many_to_one(both, ends, ["left_key"], "left").select("r_name", "n_nationkey", "left_key", "right_key", "customers", "mean", "first_nation", "last_nation")


@query("SELECT r_name, n_name, n_regionkey = r_regionkey AS inside FROM region CROSS JOIN nation")
def ops_pairs_of_small_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of two tables of a checked, small size."""
    return C.small_pairs(table(spark, d, "region"), table(spark, d, "nation")).select("r_name", "n_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("inside"))
