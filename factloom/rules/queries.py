"""Queries that run the rule catalog, and the SQL of the rules over archived facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.facts import FactTable
from ..operators.json_sql import as_bool as _bool, decoded as _decoded, field as _field, items as _items, pairs as _pairs
from ..plans import engine
from ..session import table, written
from ..sources import domain as tables_of, payloads, python_source, surfaces
from . import calls, classes, data, devices, domain, functions, judgments, modules, records, shapes, statements, suites  # noqa: F401  registers the rules

DATA_RULES = ["ALL-DATA0001", "ALL-DATA0004", "ALL-DATA0006", "ALL-DATA0007", "ALL-DATA0009", "ALL-DATA0012", "ALL-DATA0013", "ALL-REVI0001", "ALL-WAIV0001", "ALL-DUPL0003", "PY-TEST0004", "PY-TEST0005"]


def _archived(spark: SparkSession, d: str) -> dict[str, FactTable]:
    raw = table(spark, d, "raw_fact")
    return {family: payloads.table(raw, family) for family in payloads.FIELDS}


def _judged(tables: dict[str, FactTable], rules: list[str]) -> DataFrame:
    compiled = [engine.compile_rule(engine.CATALOG[id], k, tables, engine.Options()) for k, id in enumerate(rules)]
    out = compiled[0].judged
    for c in compiled[1:]:
        out = out.unionByName(c.judged)
    return out


def rules_data_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the rules over archived facts, with its verdict."""
    return _judged(_archived(spark, d), DATA_RULES).select("rule", "fact_id", F.coalesce("float_value", F.col("integer_value").cast("double")).alias("number"), "category_value", "failed", "unassessed")


def rules_data_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of each rule over archived facts."""
    return engine.run(spark, _archived(spark, d), engine.Options(select=DATA_RULES)).summaries.select("rule", "observation_count", "unassessed_count", "failure_count", "finding_count")


def rules_data_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first failures in the order of facts and rules: a bounded report."""
    return engine.run(spark, _archived(spark, d), engine.Options(select=DATA_RULES, limit=100)).failures.select("fact_order", "rule", "fact_id")


def rules_data_findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the rules over archived facts."""
    report = engine.run(spark, _archived(spark, d), engine.Options(select=DATA_RULES, limit=None))
    return report.findings.groupBy("rule", "fact_id").agg(F.count("*").alias("findings"))


def _python(spark: SparkSession, d: str, *relations: str) -> dict[str, FactTable]:
    return python_source.tables(table(spark, d, "source_file"), list(relations) or None)


def rules_python_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Every rule over the facts of the Python sources."""
    tables = _python(spark, d)
    ids = [id for id, r in engine.CATALOG.items() if set(r.families) <= set(tables)]
    # A few rules at a time, each part written at once, so that the driver never holds the plan of the whole catalog.
    views: dict = {}
    results = {id: engine.evaluate(engine.CATALOG[id], tables, None, views) for id in ids}
    parts = [written(engine.run(spark, tables, engine.Options(select=chosen), results=results).summaries) for chosen in engine.portions(results)]
    return reduce(DataFrame.unionByName, parts).select("rule", "observation_count", "unassessed_count", "failure_count", "finding_count")


DOMAIN_RULES = ["ALL-HIST0001", "ALL-HIST0002", "ALL-COMM0001", "ALL-COMM0003", "ALL-WRIT0003", "ALL-WRIT0004", "ALL-WRIT0005"]


def rules_domain_values(spark: SparkSession, d: str) -> DataFrame:
    """Values and verdicts of the rules over history, comments and prose."""
    tables = {"RepositoryHistoryFact": tables_of.history_table(table(spark, d, "file_history")), "CommentFact": tables_of.comment_table(table(spark, d, "comment_group")), "ProseSegmentFact": tables_of.prose_table(table(spark, d, "documents"))}
    return _judged(tables, DOMAIN_RULES).select("rule", "fact_id", F.coalesce("float_value", F.col("integer_value").cast("double")).alias("number"), "failed")


def rules_coupling_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the rules over module coupling and ancestors."""
    classes_ = table(spark, d, "class_index")
    tables = {"ModuleCouplingFact": tables_of.coupling_table(classes_), "OverrideFact": tables_of.override_table(classes_)}
    return _judged(tables, ["ALL-ARCH0002", "ALL-ARCH0003", "ALL-CLAS0005"]).select("rule", "fact_id", "integer_value", "failed", "unassessed")


JUDGED = ["ALL-ARCH1002", "ALL-ARCH1003", "ALL-ARCH1005", "ALL-ARCH1006", "ALL-ARCH1007", "ALL-CLAS1001", "ALL-CLAS1002", "ALL-COMM1001", "ALL-COMM1002", "ALL-DUPL1001", "ALL-REVI1001", "ALL-WRIT1001", "ALL-WRIT1002"]


def rules_judged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the judged rules ask about in the archived facts and the flat tables: every candidate, unassessed without a backend."""
    classes_ = table(spark, d, "class_index")
    raw = table(spark, d, "raw_fact")
    tables = {
        "ModuleCouplingFact": tables_of.coupling_table(classes_), "OverrideFact": tables_of.override_table(classes_), "CommentFact": tables_of.comment_table(table(spark, d, "comment_group")),
        "ProseSegmentFact": tables_of.prose_table(table(spark, d, "documents")), "RepositoryHistoryFact": tables_of.history_table(table(spark, d, "file_history")),
        "ChangeFact": payloads.table(raw, "ChangeFact"), "CloneGroupFact": payloads.table(raw, "CloneGroupFact"),
    }
    return _judged(tables, JUDGED).select("rule", "fact_id", "unassessed")


def rules_route_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the rules over routes: the addresses literals name, by repository."""
    facts = tables_of.route_table(table(spark, d, "comment_group"))
    return _judged({"RouteFact": facts}, ["ALL-ROUT0001", "ALL-ROUT0002", "ALL-ROUT0003"]).select("rule", "fact_id", "integer_value", "failed")


def rules_literal_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the rules over literals whose files were not kept."""
    return _judged({"StringExpressionFact": tables_of.literal_table(table(spark, d, "comment_group"))}, ["ALL-STRI0002"]).select("rule", "fact_id", "integer_value", "failed")


def rules_surface_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the rules over Rust and TypeScript files."""
    tables = surfaces.tables(table(spark, d, "source_file"))
    ids = sorted(id for id, r in engine.CATALOG.items() if set(r.families) <= set(tables))
    return _judged(tables, ids).select("rule", "fact_id", F.coalesce("float_value", F.col("integer_value").cast("double")).alias("number"), "failed")


def facts_functions(spark: SparkSession, d: str) -> DataFrame:
    """The callables of the Python sources with their measures."""
    return _python(spark, d, "function")["FunctionFact"].facts().select("fact_id", "path", "qualname", "statements", "conditionals", "nesting", "lines", "references")


def facts_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the Python sources by callee."""
    return _python(spark, d, "call")["ModuleFact"].relation("call").groupBy("callee").agg(F.count("*").alias("calls"), F.count_distinct("path").alias("files"))


def facts_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of the Python sources."""
    return _python(spark, d, "class")["ClassFact"].facts().select("fact_id", "path", "name", F.array_join("bases", ",").alias("bases"), "methods", "fields")


def facts_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports of the Python sources and whether they are used."""
    return _python(spark, d, "import")["ModuleFact"].relation("import").select("path", "ordinal", "module", "name", "level", "is_used")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rules_judged_candidates, rules_route_values, rules_literal_values, rules_domain_values, rules_coupling_values, rules_surface_values, rules_data_values, rules_data_summaries, rules_data_failures, rules_data_findings, rules_python_summaries, facts_functions, facts_calls, facts_classes, facts_imports)}


# --- SQL --------------------------------------------------------------------------------------------------------------


_T = lambda x: f"json_extract_string({x}, '$')"
_OWNED = "coalesce(len(list_filter(owners, lambda x: json_type(x) <> 'NULL' AND length(trim(json_extract_string(x, '$'))) > 0)), 0) > 0"
_PREPARED = f"""
WITH j0 AS (SELECT *, CASE WHEN json_valid(payload) THEN TRY_CAST(payload AS JSON) END AS a FROM raw_fact WHERE payload IS NOT NULL),
j1 AS (SELECT *, {_decoded('a')} AS b FROM j0), j2 AS (SELECT *, {_decoded('b')} AS c FROM j1), j3 AS (SELECT *, {_decoded(_field('c', 'fact'))} AS f FROM j2),
fact AS MATERIALIZED (SELECT delivery_id AS fact_order, fact_id, family, language, CASE WHEN json_type(f) = 'OBJECT' THEN f ELSE c END AS j FROM j3 WHERE json_type(c) = 'OBJECT'
  QUALIFY row_number() OVER (PARTITION BY family, fact_id ORDER BY observed_at DESC NULLS LAST, ingested_at DESC NULLS LAST, delivery_id DESC) = 1),
asset0 AS (SELECT fact_id, unnest({_items(_field('j', 'assets'))}) AS r FROM fact WHERE family = 'DataAssetFact'),
asset AS MATERIALIZED (SELECT fact_id, {_T(_field('r', 'identifier'))} AS identifier, {_T(_field('r', 'domain'))} AS domain, {_T(_field('r', 'lifecycle'))} AS lifecycle, {_bool(_field('r', 'is_changed'))} AS is_changed, {_items(_field('r', 'owners'))} AS owners, {_items(_field('r', 'fields'))} AS fields FROM asset0),
field0 AS (SELECT fact_id, {_OWNED} AS owned, unnest(fields) AS r FROM asset),
field AS MATERIALIZED (SELECT fact_id, owned, {_T(_field('r', 'description'))} AS description, {_items(_field('r', 'tags'))} AS tags, {_items(_field('r', 'glossary_terms'))} AS terms FROM field0),
ref0 AS (SELECT fact_id, unnest({_items(_field('j', 'references'))}) AS r, generate_subscripts({_items(_field('j', 'references'))}, 1) AS k FROM fact WHERE family = 'DataAssetReferenceFact'),
ref AS MATERIALIZED (SELECT fact_id, k, {_T(_field('r', 'asset_identifier'))} AS identifier, {_bool(_field('r', 'asset_exists'))} AS there, {_pairs(_field('r', 'upstream_health'))} AS health FROM ref0),
up AS (SELECT DISTINCT fact_id, k, u.key AS key FROM (SELECT fact_id, k, unnest(health) AS u FROM ref) WHERE json_extract_string(u.value, '$') = 'unhealthy'),
known AS (SELECT identifier, bool_or({_OWNED}) AS owned, bool_or(lifecycle IN ('deprecated', 'removed')) AS gone FROM asset GROUP BY ALL),
change0 AS (SELECT fact_id, unnest({_items(_field('j', 'changes'))}) AS r FROM fact WHERE family = 'ChangeFact'),
change1 AS (SELECT fact_id, r, {_decoded(_field('r', 'review'))} AS review, {_T(_field('r', 'author'))} AS author FROM change0),
change AS MATERIALIZED (SELECT fact_id, len(list_filter({_items(_field('review', 'approvals'))}, lambda a: coalesce({_bool("json_extract(a, '$.approved')")} AND {_bool("json_extract(a, '$.eligible')")} AND json_extract_string(a, '$.reviewer') <> author, false))) > 0 AS met FROM change1 WHERE {_bool(_field('review', 'required'))}),
waiver0 AS (SELECT fact_id, unnest({_items(_field('j', 'waivers'))}) AS r FROM fact WHERE family = 'WaiverFact'),
waiver AS (SELECT fact_id, TRY_CAST({_T(_field('r', 'age_days'))} AS BIGINT) AS age, {_bool(_field('r', 'is_overly_broad'))} AS broad, len(list_filter({_pairs(_field('r', 'metadata'))}, lambda m: m.key = 'reason' AND coalesce(length(trim(json_extract_string(m.value, '$'))) > 0, false))) > 0 AS reason FROM waiver0),
clone AS (SELECT fact_id, TRY_CAST({_T(_field('j', 'token_length'))} AS BIGINT) AS tokens, {_items(_field('j', 'fragments'))} AS fragments FROM fact WHERE family = 'CloneGroupFact'),
copy AS (SELECT fact_id, tokens, len(fragments) AS n, list_max(list_transform(fragments, lambda f: len({_items(_field('f', 'lines'))}))) AS lines FROM clone),
suite AS (SELECT fact_id, len(p) AS n, len(list_filter(p, lambda c: coalesce(TRY_CAST(json_extract_string(c.value, '$') AS BOOLEAN), false))) AS n_on, import_mode FROM (SELECT fact_id, {_pairs(_field('j', 'strict_controls'))} AS p, {_T(_field('j', 'import_mode'))} AS import_mode FROM fact WHERE family = 'TestSuiteFact' AND language = 'python')),
n AS MATERIALIZED (
  SELECT 'ALL-DATA0001' AS rule, fact_id, count(*) AS v FROM ref WHERE NOT there GROUP BY ALL
  UNION ALL SELECT 'ALL-DATA0004', fact_id, count(*) FROM ref JOIN known USING (identifier) WHERE gone GROUP BY ALL
  UNION ALL SELECT 'ALL-DATA0006', fact_id, count(*) FROM up GROUP BY ALL
  UNION ALL SELECT 'ALL-DATA0007', fact_id, count(*) FROM asset WHERE is_changed AND (NOT {_OWNED} OR coalesce(length(trim(domain)), 0) = 0) GROUP BY ALL
  UNION ALL SELECT 'ALL-DATA0009', fact_id, count(*) FILTER (WHERE coalesce(length(trim(description)), 0) = 0) * 100.0 / count(*) FROM field GROUP BY ALL
  UNION ALL SELECT 'ALL-DATA0012', fact_id, count(*) FROM field WHERE len(list_filter(tags, lambda t: coalesce(lower(json_extract_string(t, '$')) IN ('pii', 'sensitive', 'confidential', 'personal', 'secret'), false))) > 0 AND (NOT owned OR len(terms) = 0) GROUP BY ALL
  UNION ALL SELECT 'ALL-DATA0013', fact_id, count(*) FROM ref JOIN known USING (identifier) WHERE NOT owned GROUP BY ALL
  UNION ALL SELECT 'ALL-REVI0001', fact_id, count(*) FILTER (WHERE met) * 100.0 / count(*) FROM change GROUP BY ALL
  UNION ALL SELECT 'ALL-WAIV0001', fact_id, count(*) FROM waiver WHERE age IS NULL OR age > 90 OR coalesce(broad, false) OR NOT reason GROUP BY ALL),
rules AS (SELECT * FROM (VALUES ('ALL-DATA0001', 'DataAssetReferenceFact'), ('ALL-DATA0004', 'DataAssetReferenceFact'), ('ALL-DATA0006', 'DataAssetReferenceFact'), ('ALL-DATA0007', 'DataAssetFact'), ('ALL-DATA0009', 'DataAssetFact'), ('ALL-DATA0012', 'DataAssetFact'), ('ALL-DATA0013', 'DataAssetReferenceFact'), ('ALL-REVI0001', 'ChangeFact'), ('ALL-WAIV0001', 'WaiverFact')) AS t(rule, family)),
numbers AS (SELECT r.rule, f.fact_id, CAST(coalesce(n.v, 0) AS DOUBLE) AS number FROM rules r JOIN fact f USING (family) LEFT JOIN n ON n.rule = r.rule AND n.fact_id = f.fact_id),
judged AS MATERIALIZED (
  SELECT rule, fact_id, number, CAST(NULL AS VARCHAR) AS category_value, CASE rule WHEN 'ALL-DATA0009' THEN number > 5 WHEN 'ALL-REVI0001' THEN number < 95 ELSE number > 0 END AS failed, false AS unassessed FROM numbers
  UNION ALL SELECT 'ALL-DUPL0003', fact_id, CAST(CASE WHEN tokens >= 60 AND lines >= 4 THEN n - 1 ELSE 0 END AS DOUBLE), NULL, false, true FROM copy
  UNION ALL SELECT 'PY-TEST0004', fact_id, NULL, CASE WHEN n = 0 OR n_on = 0 THEN 'permissive' WHEN n = n_on THEN 'strict' ELSE 'partial' END, NOT (n > 0 AND n = n_on), false FROM suite
  UNION ALL SELECT 'PY-TEST0005', fact_id, NULL, CASE import_mode WHEN 'importlib' THEN 'isolated' WHEN 'append' THEN 'appended' WHEN 'prepend' THEN 'prepended' END, coalesce(import_mode IN ('append', 'prepend'), false), coalesce(import_mode NOT IN ('importlib', 'append', 'prepend'), true) FROM suite)
"""


def oracle_sql() -> dict[str, str]:
    from ..operators.analytics import SQL

    found = """, found AS (SELECT rule, fact_id, v AS m FROM n WHERE rule NOT IN ('ALL-DATA0009', 'ALL-REVI0001')
UNION ALL SELECT 'ALL-DATA0009', fact_id, count(*) FROM field WHERE coalesce(length(trim(description)), 0) = 0 GROUP BY ALL UNION ALL SELECT 'ALL-REVI0001', fact_id, count(*) FROM change WHERE NOT met GROUP BY ALL) """
    prose = {"ALL-WRIT0003": ("writ_sentence_uniformity", "uniformity", 90), "ALL-WRIT0005": ("writ_opener_concentration", "share", 30)}
    written_ = " UNION ALL ".join(f"SELECT '{r}' AS rule, 'document:' || fact_id AS fact_id, {v} AS number, {v} > {most} AS failed FROM ({SQL[q]})" for r, (q, v, most) in prose.items())
    paragraphs = SQL["writ_paragraph_uniformity"].replace("n >= 3", "n >= 4").replace("x >= 10", "x >= 30")
    files = "(SELECT *, coalesce(author_count, 0) + coalesce(additional_commit_count, 0) AS c FROM file_history QUALIFY row_number() OVER (PARTITION BY repository, path ORDER BY recorded_at DESC NULLS LAST, line_count DESC NULLS LAST) = 1)"
    groups = "(SELECT * FROM comment_group WHERE body IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
    domain_ = f"""{written_} UNION ALL SELECT 'ALL-WRIT0004', 'document:' || fact_id, uniformity, uniformity > 90 FROM ({paragraphs})
UNION ALL SELECT 'ALL-HIST0001', 'history:' || repository, CAST(count(*) FILTER (WHERE line_count >= 400 AND c >= 2 AND c >= b * 0.5 AND days_since_last_change <= 180) AS DOUBLE), count(*) FILTER (WHERE line_count >= 400 AND c >= 2 AND c >= b * 0.5 AND days_since_last_change <= 180) > 0 FROM (SELECT *, max(c) OVER (PARTITION BY repository) AS b FROM {files}) GROUP BY repository
UNION ALL SELECT 'ALL-HIST0002', 'history:' || repository, CAST(count(*) FILTER (WHERE author_count >= 4 AND c >= 5) AS DOUBLE), count(*) FILTER (WHERE author_count >= 4 AND c >= 5) > 0 FROM {files} GROUP BY repository
UNION ALL SELECT 'ALL-COMM0001', 'comments:' || f.repository || ':' || f.path, coalesce(share, 0.0), coalesce(share, 0.0) > 20 FROM (SELECT DISTINCT repository, path FROM {groups}) f LEFT JOIN ({SQL['comm_length']}) s ON s.repository = f.repository AND s.path = f.path
UNION ALL SELECT 'ALL-COMM0003', 'comments:' || f.repository || ':' || f.path, CAST(count(m.marker) AS DOUBLE), count(m.marker) > 0 FROM (SELECT DISTINCT repository, path FROM {groups}) f LEFT JOIN ({SQL['comm_work_markers']}) m ON m.repository = f.repository AND m.path = f.path GROUP BY f.repository, f.path"""
    judged_ = f"""
SELECT rule, 'coupling:' || repository AS fact_id, true AS unassessed FROM (SELECT DISTINCT repository FROM class_index, unnest(importers) AS u(i) WHERE i IS NOT NULL AND module IS NOT NULL), (VALUES ('ALL-ARCH1002'), ('ALL-ARCH1003'), ('ALL-ARCH1007')) AS r(rule)
UNION ALL SELECT rule, 'class:' || class_id, true FROM ({SQL['clas_ancestors']}), (VALUES ('ALL-CLAS1001'), ('ALL-CLAS1002')) AS r(rule) WHERE ancestors > 0
UNION ALL SELECT rule, 'comments:' || repository || ':' || path, true FROM (SELECT DISTINCT repository, path FROM {groups} WHERE token_count >= 3), (VALUES ('ALL-COMM1001'), ('ALL-COMM1002')) AS r(rule)
UNION ALL SELECT 'ALL-WRIT1001', 'comments:' || repository || ':' || path, true FROM (SELECT DISTINCT repository, path FROM {groups} WHERE character_count >= 24)
UNION ALL SELECT 'ALL-WRIT1002', 'document:' || doc_id, true FROM documents WHERE length(text) >= 24
UNION ALL SELECT 'ALL-ARCH1006', 'history:' || repository, true FROM (SELECT DISTINCT repository FROM file_history)
UNION ALL SELECT 'ALL-DUPL1001', fact_id, true FROM copy WHERE tokens >= 80 AND n > 0
UNION ALL SELECT rule, fact_id, true FROM (SELECT DISTINCT fact_id FROM change0), (VALUES ('ALL-ARCH1005'), ('ALL-REVI1001')) AS r(rule)"""
    coupling_ = f"""WITH RECURSIVE e0 AS (SELECT DISTINCT repository, source, target FROM (SELECT repository, module AS target, unnest(importers) AS source FROM class_index) WHERE source IS NOT NULL AND target IS NOT NULL),
r AS (SELECT repository, source AS a, target AS b FROM e0 UNION SELECT r.repository, r.a, e0.target FROM r JOIN e0 ON e0.repository = r.repository AND e0.source = r.b),
c AS (SELECT x.repository, x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.repository = y.repository AND x.a = y.b AND x.b = y.a GROUP BY x.repository, x.a),
p AS (SELECT DISTINCT repository, string_split(source, '.')[1] AS source, string_split(target, '.')[1] AS target FROM e0), x AS (SELECT * FROM p WHERE source <> target),
o AS (SELECT repository, source AS node, count(*) AS n FROM x GROUP BY ALL), i AS (SELECT repository, target AS node, count(*) AS n FROM x GROUP BY ALL),
m AS (SELECT repository, node, coalesce(o.n, 0) / (coalesce(o.n, 0) + coalesce(i.n, 0)) AS s FROM o FULL JOIN i USING (repository, node)),
v AS (SELECT 'ALL-ARCH0002' AS rule, repository, count(DISTINCT component) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'ALL-ARCH0003', repository, count(*) FROM (SELECT x.* FROM x JOIN m a ON a.repository = x.repository AND a.node = x.source JOIN m b ON b.repository = x.repository AND b.node = x.target WHERE b.s > a.s) GROUP BY ALL)
SELECT rule, 'coupling:' || repository AS fact_id, CAST(coalesce(n, 0) AS BIGINT) AS integer_value, coalesce(n, 0) > 0 AS failed, false AS unassessed FROM (SELECT DISTINCT repository FROM class_index) CROSS JOIN (VALUES ('ALL-ARCH0002'), ('ALL-ARCH0003')) AS t(rule) LEFT JOIN v USING (rule, repository)
UNION ALL SELECT 'ALL-CLAS0005', 'class:' || class_id, CASE WHEN ancestors >= 0 THEN ancestors END, ancestors > 5, ancestors < 0 FROM ({SQL['clas_ancestors']})"""
    latest_ = "(SELECT * FROM comment_group WHERE expression IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
    routes_ = f"""WITH route AS ({SQL['rout_routes']}), fact AS (SELECT DISTINCT repository FROM {latest_}),
part AS (SELECT repository, unnest(string_split(route, '/')) AS segment FROM route),
styled AS (SELECT repository, CASE WHEN contains(segment, '-') AND NOT contains(segment, '_') THEN '-' WHEN contains(segment, '_') AND NOT contains(segment, '-') THEN '_' END AS style FROM part WHERE segment <> '' AND NOT regexp_matches(segment, '[{{<:]')),
vote AS (SELECT repository, count(*) FILTER (WHERE style = '-') AS a, count(*) FILTER (WHERE style = '_') AS b FROM styled GROUP BY ALL),
v AS (SELECT 'ALL-ROUT0001' AS rule, repository, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY repository, route) AS k FROM route) WHERE k > 1 GROUP BY ALL
UNION ALL SELECT 'ALL-ROUT0002', repository, count(*) FROM (SELECT r.* FROM route r JOIN (SELECT repository, route, count(DISTINCT path) AS k FROM route GROUP BY ALL) USING (repository, route) WHERE k = 1) GROUP BY ALL
UNION ALL SELECT 'ALL-ROUT0003', repository, least(a, b) FROM vote WHERE a <> b)
SELECT rule, 'routes:' || repository AS fact_id, CAST(coalesce(n, 0) AS BIGINT) AS integer_value, coalesce(n, 0) > 0 AS failed FROM fact CROSS JOIN (VALUES ('ALL-ROUT0001'), ('ALL-ROUT0002'), ('ALL-ROUT0003')) AS t(rule) LEFT JOIN v USING (rule, repository)"""
    order = ", ".join(f"('{r}', {k})" for k, r in enumerate(sorted(DATA_RULES)))
    return {
        "rules_domain_values": domain_,
        "rules_coupling_values": coupling_,
        "rules_judged_candidates": _PREPARED + judged_,
        "rules_route_values": routes_,
        "rules_literal_values": f"SELECT 'ALL-STRI0002' AS rule, 'literals:' || repository || ':' || path AS fact_id, CAST(count(s.group_id) AS BIGINT) AS integer_value, count(s.group_id) > 0 AS failed FROM (SELECT DISTINCT repository, path FROM {latest_}) f LEFT JOIN ({SQL['stri_separators']}) s USING (repository, path) GROUP BY repository, path",
        "rules_data_values": _PREPARED + "SELECT rule, fact_id, number, category_value, failed, unassessed FROM judged",
        "rules_data_summaries": _PREPARED + found + """SELECT rule, count(*) AS observation_count, CAST(sum(CAST(unassessed AS INTEGER)) AS BIGINT) AS unassessed_count, CAST(sum(CAST(failed AS INTEGER)) AS BIGINT) AS failure_count, CAST(sum(CASE WHEN failed THEN coalesce(m, 0) ELSE 0 END) AS BIGINT) AS finding_count
FROM judged LEFT JOIN found USING (rule, fact_id) GROUP BY rule""",
        "rules_data_findings": _PREPARED + found + "SELECT rule, fact_id, CAST(m AS BIGINT) AS findings FROM judged JOIN found USING (rule, fact_id) WHERE failed AND m > 0",
        "rules_data_failures": _PREPARED + f""", listed AS (SELECT * FROM (VALUES {order}) AS t(rule, k))
SELECT fact_order, rule, j.fact_id FROM judged j JOIN listed USING (rule) JOIN fact f ON f.fact_id = j.fact_id WHERE failed ORDER BY fact_order, k, j.fact_id LIMIT 100""",
    }
