"""Judging rules: one job for all summaries, one for the retained failures, and their details by join.

Each rule is compiled to DataFrames with the same schemas, so all rules of a run are one union. Summaries are exact
aggregates. Failures are kept up to a limit in the order (fact_order, rule_order), and only for kept failures are
findings and fixes read, joined on (rule, fact_id).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.facts import FactTable
from .contracts import FINDINGS, IMPORTS, NODES, REWRITES, SUMMARY, VALUES, Boolean, Category, Numeric, Policy, Result, Rule, conform, default_policy, schema
from .shaping import Counting, Measure, located

CATALOG: dict[str, Rule] = {}


def rule(id: str, *families: str, output: str = "integer", policy: Policy | None | str = "default", language: str | None = None, safety: str | None = None, **settings):
    """Register a rule function; it takes the families' tables in order and its settings as keywords."""

    def register(build):
        if id in CATALOG:
            raise ValueError(f"{id} is registered twice")
        CATALOG[id] = Rule(id, build, families, output, default_policy(output) if policy == "default" else policy, language, safety, (build.__doc__ or "").strip(), settings)
        return build

    return register


@dataclass
class Options:
    """What a run includes: rule ids, policies and settings by rule, accepted paths (None: all), and how many failures it keeps (None: all)."""

    select: list[str] | None = None
    policies: dict[str, Policy | None] = field(default_factory=dict)
    settings: dict[str, dict] = field(default_factory=dict)
    paths: DataFrame | None = None
    limit: int | None = 1000


@dataclass
class Compiled:
    rule: Rule
    order: int
    judged: DataFrame
    result: Result


@dataclass
class Report:
    summaries: DataFrame
    failures: DataFrame
    findings: DataFrame
    rewrites: DataFrame
    nodes: DataFrame
    imports: DataFrame


def evaluate(one: Rule, tables: dict[str, FactTable], settings: dict | None = None, views: dict | None = None) -> Result:
    """The rule's own result, in its language's view of the tables. views keeps a language's tables for rules that share them."""
    views = {} if views is None else views

    def seen(family: str) -> FactTable:
        if not one.language:
            return tables[family]
        if (family, one.language) not in views:
            views[family, one.language] = tables[family].restricted(one.language)
        return views[family, one.language]

    return one.build(*map(seen, one.families), **(one.settings | (settings or {})))


def compile_rule(one: Rule, order: int, tables: dict[str, FactTable], options: Options, result: Result | None = None) -> Compiled:
    result = evaluate(one, tables, options.settings.get(one.id)) if result is None else result
    if (result.fix is None) != (one.safety is None):
        raise TypeError(f"{one.id} must state its repair safety exactly when it returns a fix")
    values, findings = result.values, result.findings
    if options.paths is not None:
        values = values.join(options.paths.select("path").distinct(), "path", "left_semi")
    if findings is not None:
        counts = findings.groupBy("fact_id").agg(F.count("*").alias("_n"))
        values = values.join(counts, "fact_id", "left").withColumn("finding_count", F.coalesce("_n", F.lit(0)))
    failed, unassessed = _verdict(options.policies.get(one.id, one.policy))
    judged = conform(values, VALUES).withColumns({"failed": failed, "unassessed": unassessed, "rule_order": F.lit(order).cast("long"), "rule": F.lit(one.id)})
    return Compiled(one, order, judged, result)


def _verdict(policy: Policy | None) -> tuple[Column, Column]:
    return policy.verdict() if isinstance(policy, (Boolean, Numeric, Category)) else (F.lit(False), F.lit(True))


def _union(frames: list[DataFrame], spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], schema(columns))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@dataclass
class Part:
    """What some rules of a run contribute: counts of every rule, failing values, and findings by rule."""

    summaries: DataFrame
    failures: DataFrame
    findings: list[DataFrame]
    compiled: list[Compiled] = field(default_factory=list)


_KEY = [("rule_order", "long"), ("rule", "string")]
_COUNTS = [(n, t) for n, t in SUMMARY if n != "rule"]


def _facts(table: FactTable, options: Options) -> DataFrame:
    facts = table.relation("facts")
    return facts if options.paths is None else facts.join(options.paths.select("path").distinct(), "path", "left_semi")


def _names(spark: SparkSession, rules: list[tuple[int, str]]) -> Column:
    """rule_order to rule id, as an expression."""
    return F.create_map(*(F.lit(x) for pair in rules for x in (int(pair[0]), pair[1])))[F.col("rule_order")]


def _counting(spark: SparkSession, chosen: list[tuple[int, Rule, Counting, Policy | None]], options: Options) -> Part:
    """Rules over one relation of one table: the relation is scanned once, each row tagged with the rules it meets."""
    table, relation = chosen[0][2].table, chosen[0][2].relation
    rows, facts = located(table.relation(relation)), _facts(table, options)
    names = _names(spark, [(k, r.id) for k, r, _, _ in chosen])
    tag = F.filter(F.array(*(F.when(c.condition, F.lit(k).cast("long")) for k, _, c, _ in chosen)), lambda x: x.isNotNull())
    counts = rows.select("fact_id", F.explode(tag).alias("rule_order")).groupBy("rule_order", "fact_id").agg(F.count("*").alias("n")).join(facts.select("fact_id"), "fact_id", "left_semi")
    most = F.create_map(*(F.lit(x) for k, _, _, p in chosen for x in (k, float(p.maximum) if p is not None else float("inf"))))[F.col("rule_order").cast("int")]
    counts = counts.withColumn("failed", F.col("n") > most)
    judged = counts.groupBy("rule_order").agg(F.sum(F.col("failed").cast("long")).alias("failure_count"), F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("finding_count"))
    listed = spark.createDataFrame([(k, p is None) for k, _, _, p in chosen], "rule_order long, open boolean")
    total = facts.agg(F.count("*").alias("observation_count"))
    summaries = listed.join(judged, "rule_order", "left").fillna(0, ["failure_count", "finding_count"]).join(F.broadcast(total), F.lit(True)).withColumn("unassessed_count", F.when(F.col("open"), F.col("observation_count")).otherwise(0))
    failing = counts.where("failed").select("rule_order", "fact_id", F.col("n").alias("integer_value"), F.col("n").alias("finding_count")).join(facts, "fact_id").withColumn("rule", names)
    said = F.filter(F.array(*(F.when(c.condition, F.struct(F.lit(k).cast("long").alias("rule_order"), c.message.alias("message"))) for k, _, c, _ in chosen)), lambda x: x.isNotNull())
    found = rows.select("*", F.explode(said).alias("_said")).withColumns({"rule_order": F.col("_said.rule_order"), "message": F.col("_said.message")})
    place = F.row_number().over(Window.partitionBy("rule_order", "fact_id").orderBy("ordinal", "message")) - 1
    details = conform(found.withColumns({"finding_order": place, "measurement_names": F.array().cast("array<string>"), "measurement_values": F.array().cast("array<double>"), "measurement_units": F.array().cast("array<string>"), "evidence": F.array().cast("array<string>"), "choice_options": F.array().cast("array<string>"), "rule": names}), [*FINDINGS, *_KEY])
    return Part(conform(summaries, _COUNTS), conform(failing, [*VALUES, *_KEY]), [details])


def _measures(spark: SparkSession, chosen: list[tuple[int, Rule, Measure, Policy | None]], options: Options) -> Part:
    """Rules over the fact relation of one table: every fact is read once, with a row for each rule."""
    table = chosen[0][2].table
    facts = table.facts() if options.paths is None else table.facts().join(options.paths.select("path").distinct(), "path", "left_semi")
    names = _names(spark, [(k, r.id) for k, r, _, _ in chosen])

    def one(k: int, m: Measure) -> Column:
        flag = m.output == "boolean"
        return F.struct(F.lit(k).cast("long").alias("rule_order"), (F.lit(None) if flag else m.typed).cast("long").alias("integer_value"), (m.typed if flag else F.lit(None)).cast("boolean").alias("boolean_value"), m.shown.alias("shown"), m.message.alias("message"))

    rows = facts.select("*", F.explode(F.array(*(one(k, m) for k, _, m, _ in chosen))).alias("_m")).select("*", "_m.*").withColumns({"float_value": F.lit(None).cast("double"), "category_value": F.lit(None).cast("string")})
    failed, unassessed = F.lit(False), F.lit(True)
    for k, _, _, policy in chosen:
        f, u = _verdict(policy)
        failed, unassessed = F.when(F.col("rule_order") == k, f).otherwise(failed), F.when(F.col("rule_order") == k, u).otherwise(unassessed)
    judged = rows.withColumns({"failed": failed, "unassessed": unassessed, "finding_count": F.col("shown").cast("long"), "rule": names})
    counts = judged.groupBy("rule_order").agg(F.count("*").alias("observation_count"), F.sum(F.col("unassessed").cast("long")).alias("unassessed_count"), F.sum(F.col("failed").cast("long")).alias("failure_count"), F.sum(F.when(F.col("failed"), F.col("finding_count")).otherwise(0)).alias("finding_count"))
    listed = spark.createDataFrame([(k,) for k, _, _, _ in chosen], "rule_order long")
    value = F.col("integer_value").cast("double")
    unit = F.create_map(*(F.lit(x) for k, _, m, _ in chosen for x in (k, m.unit)))[F.col("rule_order").cast("int")]
    some = lambda c, t: F.when(F.col("boolean_value").isNull(), F.array(c)).otherwise(F.array()).cast(f"array<{t}>")
    details = judged.where("shown").withColumns({"finding_order": F.lit(0).cast("long"), "measurement_names": some(unit, "string"), "measurement_values": some(value, "double"), "measurement_units": some(unit, "string"), "choice_options": F.array().cast("array<string>")})
    return Part(conform(listed.join(counts, "rule_order", "left").fillna(0), _COUNTS), conform(judged.where("failed"), [*VALUES, *_KEY]), [conform(details, [*FINDINGS, *_KEY])])


def _others(spark: SparkSession, compiled: list[Compiled]) -> Part:
    """Rules with results of their own: one union of all."""
    judged = _union([c.judged for c in compiled], spark, [*VALUES, ("failed", "boolean"), ("unassessed", "boolean"), *_KEY])
    # Left join on the rule list: a rule without a single fact still has a summary.
    listed = spark.createDataFrame([(c.order,) for c in compiled], "rule_order long")
    counted = judged.groupBy("rule_order").agg(
        F.count("*").alias("observation_count"), F.sum(F.col("unassessed").cast("long")).alias("unassessed_count"), F.sum(F.col("failed").cast("long")).alias("failure_count"),
        F.sum(F.when(F.col("failed"), F.col("finding_count")).otherwise(0)).alias("finding_count"),
    )
    found = [conform(c.result.findings, FINDINGS).withColumns({"rule_order": F.lit(c.order).cast("long"), "rule": F.lit(c.rule.id)}) for c in compiled if c.result.findings is not None]
    return Part(conform(listed.join(counted, "rule_order", "left").fillna(0), _COUNTS), judged.where("failed").drop("failed", "unassessed"), found, compiled)


def run(spark: SparkSession, tables: dict[str, FactTable], options: Options | None = None, catalog: dict[str, Rule] | None = None, fuse: bool = True, results: dict | None = None) -> Report:
    """Evaluate every selected rule whose families are there; a rule without its families is skipped, not passed.

    fuse: rules that count rows of one relation, or measure facts of one table, share one scan. The results are the same.
    results: what rules have been evaluated to already, by id.
    """
    options = options or Options()
    catalog = CATALOG if catalog is None else catalog
    chosen = [r for id, r in sorted(catalog.items()) if (options.select is None or id in options.select) and all(f in tables for f in r.families)]
    views: dict = {}
    shared: dict[tuple, list] = {}
    alone: list[Compiled] = []
    for k, r in enumerate(chosen):
        result = results[r.id] if results and r.id in results else evaluate(r, tables, options.settings.get(r.id), views)
        policy = options.policies.get(r.id, r.policy)
        if fuse and r.safety is None and isinstance(result, Counting) and (policy is None or isinstance(policy, Numeric) and policy.minimum is None and policy.maximum is not None and policy.maximum >= 0):
            shared.setdefault(("counting", id(result.table), result.relation), []).append((k, r, result, policy))
        elif fuse and r.safety is None and isinstance(result, Measure):
            shared.setdefault(("measure", id(result.table)), []).append((k, r, result, policy))
        else:
            alone.append(compile_rule(r, k, tables, options, result))
    parts = [(_counting if key[0] == "counting" else _measures)(spark, group, options) for key, group in shared.items()]
    if alone or not parts:
        parts.append(_others(spark, alone))
    listed = spark.createDataFrame([(k, r.id) for k, r in enumerate(chosen)], "rule_order long, rule string")
    summaries = conform(_union([p.summaries for p in parts], spark, _COUNTS).join(listed, "rule_order"), SUMMARY)
    failures = conform(_union([p.failures for p in parts], spark, [*VALUES, *_KEY]), [*VALUES, *_KEY])
    if options.limit is not None:
        failures = failures.orderBy("fact_order", "rule_order", "fact_id").limit(options.limit)
    kept = failures.select("rule", "fact_id", "fact_order")
    fixes = [c for p in parts for c in p.compiled if c.result.fix]

    def details(frames: list[DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
        return _union(frames, spark, [*columns, *_KEY]).join(kept, ["rule", "fact_id"])

    def of(relation: str, columns: list[tuple[str, str]]) -> DataFrame:
        rows = [(c, getattr(c.result.fix, relation)) for c in fixes]
        return details([f.withColumns({"rule_order": F.lit(c.order).cast("long"), "rule": F.lit(c.rule.id)}) for c, f in rows if f is not None], columns)

    return Report(summaries, failures, details([f for p in parts for f in p.findings], FINDINGS), of("rewrites", REWRITES), of("nodes", NODES), of("imports", IMPORTS))


def portions(results: dict[str, Result | Counting | Measure], size: int = 16) -> list[list[str]]:
    """Evaluated rules in portions whose plans stay small: about `size` scans each, rules that share a scan together."""
    scans: dict[object, list[str]] = {}
    for name, result in results.items():
        shared = (id(result.table), result.relation) if isinstance(result, Counting) else (id(result.table), "") if isinstance(result, Measure) else name
        scans.setdefault(shared, []).append(name)
    groups = list(scans.values())
    return [[name for group in groups[k : k + size] for name in group] for k in range(0, len(groups), size)]


def with_settings(one: Rule, **settings) -> Rule:
    return replace(one, settings=one.settings | settings)


def save(report: Report, folder: str, form: str = "json") -> None:
    """Write a report's relations below a folder, each as a table of its own."""
    for name in ("summaries", "failures", "findings", "rewrites", "nodes", "imports"):
        getattr(report, name).write.mode("overwrite").format(form).save(f"{folder}/{name}")
