"""Rules over catalogued data assets, references, waivers, changes, clones and suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.facts import FactTable, any_of, filled
from ..plans import shaping
from ..plans.contracts import Category, Numeric, Result
from ..plans.engine import rule
from .shape import counted, covered, text

# Tags of fields that need care, names of strict test settings.
SENSITIVE = ("pii", "sensitive", "confidential", "personal", "secret")


def _owned(assets: DataFrame) -> F.Column:
    return F.exists(F.coalesce("owners", F.array().cast("array<string>")), lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False)))


def _in(table: FactTable, rows: DataFrame) -> DataFrame:
    """Rows with the place of their fact."""
    return rows.join(table.identity().select("fact_id", "path", "start_line", "start_column", "end_line", "end_column"), "fact_id")


@rule("ALL-DATA0001", "DataAssetReferenceFact")
def missing_data_asset_reference(references: FactTable) -> Result:
    """References to assets the catalog does not have."""
    return counted(references, _in(references, references.relation("references").where("NOT asset_exists")), text("`", F.col("asset_identifier"), "` is not in the catalog"))


@rule("ALL-DATA0004", "DataAssetReferenceFact", "DataAssetFact")
def nonactive_data_asset_reference(references: FactTable, assets: FactTable) -> Result:
    """References to assets that are deprecated or removed."""
    gone = assets.relation("assets").where("lifecycle IN ('deprecated', 'removed')").groupBy(F.col("identifier").alias("asset_identifier")).agg(F.max("lifecycle").alias("lifecycle"))
    return counted(references, _in(references, references.relation("references").join(gone, "asset_identifier")), text("`", F.col("asset_identifier"), "` is ", F.col("lifecycle")))


@rule("ALL-DATA0006", "DataAssetReferenceFact")
def unhealthy_data_dependency(references: FactTable) -> Result:
    """Distinct pairs of a reference and an unhealthy upstream."""
    rows = references.relation("references").select("fact_id", "ordinal", "asset_identifier", F.explode("upstream_health").alias("u")).where("u.value = 'unhealthy'").select("fact_id", "ordinal", "asset_identifier", F.col("u.key").alias("upstream")).distinct()
    return counted(references, _in(references, rows), text("`", F.col("upstream"), "` above `", F.col("asset_identifier"), "` is unhealthy"))


@rule("ALL-DATA0007", "DataAssetFact")
def data_asset_governance_gap(assets: FactTable, scope: str = "changed", domain: str = "required") -> Result:
    """Assets without an owner, or without a domain where one is required."""
    rows = assets.relation("assets")
    gap = ~_owned(rows) | (~filled(F.col("domain")) if domain == "required" else F.lit(False))
    return counted(assets, _in(assets, rows.where((F.col("is_changed") if scope == "changed" else F.lit(True)) & gap)), text("`", F.col("identifier"), "` lacks an owner or domain"))


@rule("ALL-DATA0009", "DataAssetFact", output="float", policy=Numeric(maximum=5))
def data_definition_gap(assets: FactTable) -> Result:
    """Percentage of fields without a description."""
    fields = assets.relation("assets").select("fact_id", "ordinal", F.explode("fields").alias("f")).select("fact_id", "ordinal", "f.*")
    blank = ~filled(F.col("description"))
    return shaping.floating(assets.coverage(fields, blank, "gap"), "gap", shaping.findings(_in(assets, fields.where(blank)), text("`", F.col("name"), "` has no description")))


@rule("ALL-DATA0012", "DataAssetFact")
def ungoverned_sensitive_field(assets: FactTable, sensitive_tags: tuple[str, ...] = SENSITIVE) -> Result:
    """Sensitive fields whose asset has no owner or that have no glossary term."""
    rows = assets.relation("assets").withColumn("owned", _owned(assets.relation("assets"))).select("fact_id", "ordinal", "owned", F.explode("fields").alias("f")).select("fact_id", "ordinal", "owned", "f.*")
    sensitive = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.coalesce(F.lower(x).isin(*sensitive_tags), F.lit(False)))
    bare = ~F.col("owned") | (F.coalesce(F.size("glossary_terms"), F.lit(0)) <= 0)
    return counted(assets, _in(assets, rows.where(sensitive & bare)), text("`", F.col("name"), "` is sensitive and ungoverned"))


@rule("ALL-DATA0013", "DataAssetReferenceFact", "DataAssetFact")
def ungoverned_data_reference(references: FactTable, assets: FactTable) -> Result:
    """References to catalogued assets without an owner."""
    bare = assets.relation("assets").groupBy(F.col("identifier").alias("asset_identifier")).agg(F.bool_or(_owned(assets.relation("assets"))).alias("owned")).where("NOT owned")
    return counted(references, _in(references, references.relation("references").join(bare, "asset_identifier")), text("`", F.col("asset_identifier"), "` has no owner"))


@rule("ALL-REVI0001", "ChangeFact", output="float", policy=Numeric(minimum=95))
def review_coverage(changes: FactTable) -> Result:
    """Percentage of changes that require review and have an eligible approval by someone else."""
    rows = changes.relation("changes").where("review.required")
    met = F.exists(F.coalesce(F.col("review.approvals"), F.array()), lambda a: F.coalesce(a["approved"] & a["eligible"] & (a["reviewer"] != F.col("author")), F.lit(False)))
    return covered(changes, _in(changes, rows), met, text("`", F.col("identifier"), "` was not reviewed"))


@rule("ALL-WAIV0001", "WaiverFact")
def waiver_debt(waivers: FactTable, required_metadata: tuple[str, ...] = ("reason",), maximum_age_days: int = 90) -> Result:
    """Waivers that are old or of unknown age, too broad, or without their metadata."""
    metadata = F.coalesce("metadata", F.expr("cast(array() AS array<struct<key:string,value:variant>>)"))

    def states(key: str) -> F.Column:
        return F.exists(metadata, lambda m: (m["key"] == key) & F.coalesce(F.length(F.trim(F.try_variant_get(m["value"], "$", "string"))) > 0, F.lit(False)))

    lacks = any_of(*(~states(key) for key in required_metadata))
    bad = F.col("age_days").isNull() | (F.col("age_days") > maximum_age_days) | F.coalesce("is_overly_broad", F.lit(False)) | lacks
    return counted(waivers, _in(waivers, waivers.relation("waivers").where(bad)), text("the waiver at ", F.col("location"), " needs attention"))


def _clone_places(clones: FactTable) -> DataFrame:
    return clones.relation("fragments").withColumn("line_count", F.coalesce(F.size("lines"), F.lit(0)).cast("long"))


@rule("ALL-DUPL0003", "CloneGroupFact", policy=None)
def pasted_block_copy_count(clones: FactTable, minimum_token_length: int = 60, minimum_line_count: int = 4) -> Result:
    """Copies beyond the first of groups that reach the floors; one finding for each copy."""
    fragments = _clone_places(clones)
    sizes = fragments.groupBy("fact_id").agg(F.count("*").alias("_n"), F.max("line_count").alias("_lines"), F.min_by("path", "ordinal").alias("_first"))
    facts = clones.facts().join(sizes, "fact_id", "left").withColumn("_ok", (F.col("token_length") >= minimum_token_length) & (F.col("_lines") >= minimum_line_count))
    copies = F.when(F.col("_ok"), F.col("_n") - 1).otherwise(0)
    rows = fragments.where("ordinal > 0").select("fact_id", "ordinal", F.col("path").alias("copy"), "start_line").join(facts.where("_ok").select("fact_id", "path", "_first", "end_line", "start_column", "end_column"), "fact_id")
    return shaping.integer(facts, copies, shaping.findings(rows, text(F.col("copy"), " copies ", F.col("_first"))))


@rule("PY-TEST0004", "TestSuiteFact", output="category", policy=Category(good=frozenset({"strict"}), bad=frozenset({"partial", "permissive"})), language="python")
def suite_strictness(suites: FactTable) -> Result:
    """strict, partial or permissive, by how many of the suite's controls are on; without controls permissive."""
    n, on = F.coalesce(F.size("strict_controls"), F.lit(0)), F.size(F.filter(F.coalesce("strict_controls", F.expr("cast(array() AS array<struct<key:string,value:boolean>>)")), lambda c: F.coalesce(c["value"], F.lit(False))))
    return shaping.category(suites.facts(), F.when((n <= 0) | (on == 0), "permissive").when(on == n, "strict").otherwise("partial"))


@rule("PY-TEST0005", "TestSuiteFact", output="category", policy=Category(good=frozenset({"isolated"}), bad=frozenset({"appended", "prepended"})), language="python")
def suite_import_isolation(suites: FactTable) -> Result:
    """How a suite's modules are imported."""
    return shaping.category(suites.facts(), F.when(F.col("import_mode") == "importlib", "isolated").when(F.col("import_mode") == "append", "appended").when(F.col("import_mode") == "prepend", "prepended"))
