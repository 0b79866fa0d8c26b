"""Rules over tests, enums, exports and the reach of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.facts import FactTable
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import counted, counted_where, highest, text


def _tests(modules: FactTable) -> DataFrame:
    return modules.relation("test").withColumns({"reached": F.array_join("reach", ","), "given": F.array_join("fixtures", ","), "vector": F.to_json("literals")})


def _clusters(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups of tests with the place of their first one."""
    first = F.min(F.struct("path", "line", "fact_id"))
    return rows.groupBy(*keys).agg(F.count("*").alias("tests"), F.count_distinct("shape").alias("intents"), F.count_distinct("vector").alias("vectors"), first.alias("at"))


def _at(groups: DataFrame) -> DataFrame:
    return groups.select("*", "at.path", "at.line", "at.fact_id", F.lit(0).alias("ordinal"))


@rule("PY-TEST0002", "ModuleFact", language="python")
def legacy_tmpdir_fixture(modules: FactTable) -> Result:
    """Tests that ask for a legacy temporary-directory fixture."""
    return counted_where(modules, "test", F.arrays_overlap("fixtures", F.array(F.lit("tmpdir"), F.lit("tmpdir_factory"))), text("`", F.col("name"), "` asks for tmpdir"))


@rule("PY-TEST0003", "ModuleFact", language="python")
def parametrization_candidate(modules: FactTable, minimum_cases: int = 3, maximum_cases: int = 9) -> Result:
    """Sibling tests of one shape that differ in literals."""
    groups = _clusters(_tests(modules), "path", "shape", "given").drop("path")
    return counted(modules, _at(groups.where((F.col("tests") >= minimum_cases) & (F.col("tests") <= maximum_cases) & (F.col("vectors") > 1))), text(F.col("tests"), " tests differ in literals only"))


@rule("PY-TEST0008", "ModuleFact", language="python")
def shared_test_state_mutation(modules: FactTable) -> Result:
    """Tests that rebind module state."""
    return counted_where(modules, "test", F.expr("mutates"), text("`", F.col("name"), "` changes module state"))


@rule("PY-TEST0011", "ModuleFact", policy=Numeric(maximum=2), language="python")
def conditional_test_branches(modules: FactTable) -> Result:
    """Most conditionals in one test."""
    return highest(modules, modules.relation("test"), "conditionals", text("`", F.col("name"), "` decides ", F.col("conditionals"), " times"))


@rule("PY-TEST0012", "ModuleFact", policy=Numeric(maximum=10), language="python")
def owned_test_statements(modules: FactTable) -> Result:
    """Most statements in one test."""
    return highest(modules, modules.relation("test"), "statements", text("`", F.col("name"), "` has ", F.col("statements"), " statements"))


@rule("PY-TEST0013", "ModuleFact", language="python")
def manual_literal_case_loop(modules: FactTable, minimum_cases: int = 3) -> Result:
    """A loop over literals that asserts."""
    return counted_where(modules, "test", F.col("literal_loop") >= minimum_cases, text("`", F.col("name"), "` loops over ", F.col("literal_loop"), " cases"))


@rule("PY-TEST0014", "ModuleFact", language="python")
def finite_range_candidate(modules: FactTable, minimum_cases: int = 10) -> Result:
    """Parametrization over a long fixed range."""
    return counted_where(modules, "test", F.col("range_cases") >= minimum_cases, text("`", F.col("name"), "` runs ", F.col("range_cases"), " cases"))


@rule("PY-TEST0015", "ModuleFact", language="python")
def duplicate_test_intent(modules: FactTable, minimum_tests: int = 2) -> Result:
    """Tests equal in body, literals, fixtures and reach."""
    return counted(modules, _at(_clusters(_tests(modules), "shape", "vector", "given", "reached").where(F.col("tests") >= minimum_tests)), text(F.col("tests"), " tests state the same"))


@rule("PY-TEST0016", "ModuleFact", language="python")
def concentrated_test_reach(modules: FactTable, minimum_tests: int = 4) -> Result:
    """Tests of one reach with few distinct bodies."""
    return counted(modules, _at(_clusters(_tests(modules), "given", "reached").where((F.col("tests") >= minimum_tests) & (F.col("intents") > 1) & (2 * F.col("intents") <= F.col("tests")))), text(F.col("tests"), " tests reach the same with ", F.col("intents"), " bodies"))


@rule("PY-TEST0017", "ModuleFact", language="python")
def broad_example_property(modules: FactTable, minimum_cases: int = 10) -> Result:
    """Many literal vectors for one shape."""
    return counted(modules, _at(_clusters(_tests(modules), "shape").where(F.col("vectors") >= minimum_cases)), text(F.col("vectors"), " examples of one property"))


@rule("PY-TEST0019", "ModuleFact", language="python")
def production_reach_hotspot(modules: FactTable, minimum_tests: int = 8) -> Result:
    """Targets that many tests of few bodies reach."""
    rows = _tests(modules).select("*", F.explode("reach").alias("target"))
    return counted(modules, _at(_clusters(rows, "target").where((F.col("tests") >= minimum_tests) & (2 * F.col("intents") <= F.col("tests")))), text("`", F.col("target"), "` is reached by ", F.col("tests"), " tests"))


@rule("PY-ENUM0001", "ModuleFact", language="python")
def redundant_enum_value(modules: FactTable) -> Result:
    """String members whose value is their name in lower case."""
    return counted_where(modules, "enum", (F.col("base") == "StrEnum") & (F.regexp_replace("value", "^['\"]|['\"]$", "") == F.lower("member")), text("`", F.col("member"), "` could be auto()"))


@rule("PY-ENUM0004", "ModuleFact", language="python")
def shared_enum_file_shape(modules: FactTable) -> Result:
    """A file in an enums package that owns other than one enum."""
    own = modules.relation("enum").groupBy("fact_id").agg(F.count_distinct("name").alias("_enums"))
    table = FactTable("ModuleFact", {"facts": modules.facts().join(own, "fact_id", "left")})
    bad = F.array_contains(F.split("path", "/"), "enums") & ~F.col("is_init") & (F.coalesce("_enums", F.lit(0)) != 1)
    return counted(modules, table.facts().where(bad).withColumn("ordinal", F.lit(0)), text(F.col("path"), " owns ", F.coalesce("_enums", F.lit(0)), " enums"))


def _named_elsewhere(modules: FactTable) -> DataFrame:
    """Declarations with the number of other files and other top directories that name them."""
    declared = modules.relation("declaration").where("is_public")
    mentioned = modules.relation("reference").select("name", F.col("path").alias("user"))
    imported = modules.relation("import").where("name IS NOT NULL").select("name", F.col("path").alias("user"))
    users = mentioned.unionByName(imported).distinct()
    joined = declared.join(users, "name", "left").withColumn("other", F.col("user") != F.col("path"))
    package = F.regexp_extract("user", r"^(.*?)(?:/[^/]*)?$", 1)
    return joined.groupBy("fact_id", "path", "ordinal", "name", "line").agg(F.count(F.when(F.col("other"), 1)).alias("files"), F.count(F.when(~F.col("other"), 1)).alias("own"), F.count_distinct(F.when(F.col("other"), package)).alias("packages"))


@rule("ALL-REAC0001", "ModuleFact")
def unreferenced_public_declaration(modules: FactTable) -> Result:
    """Public declarations nothing names."""
    return counted(modules, _named_elsewhere(modules).where("files = 0 AND own = 0"), text("nothing names `", F.col("name"), "`"))


@rule("ALL-REAC0002", "ModuleFact")
def file_local_public_declaration(modules: FactTable) -> Result:
    """Public declarations only their own file names."""
    return counted(modules, _named_elsewhere(modules).where("files = 0 AND own > 0"), text("only its file names `", F.col("name"), "`"))


@rule("ALL-REAC0003", "ModuleFact")
def repository_wide_declaration(modules: FactTable, maximum_packages: int = 3) -> Result:
    """Declarations named from more packages than allowed."""
    return counted(modules, _named_elsewhere(modules).where(F.col("packages") > maximum_packages), text("`", F.col("name"), "` is named from ", F.col("packages"), " packages"))


@rule("PY-MODU0005", "ModuleFact", language="python")
def unused_explicit_export(modules: FactTable) -> Result:
    """Exported names no other file imports."""
    imported = modules.relation("import").where("name IS NOT NULL").select("name").distinct()
    return counted(modules, modules.relation("export").join(imported, "name", "left_anti"), text("`", F.col("name"), "` is exported for nobody"))


@rule("PY-EXCE0003", "ModuleFact", language="python")
def shared_exception_placement(modules: FactTable, minimum_importing_modules: int = 2, preferred_module: str = "exceptions") -> Result:
    """Exceptions several modules import that stand outside the shared module."""
    used = modules.relation("import").where(F.col("name").rlike(r"(?:Error|Exception)$")).groupBy("name").agg(F.count_distinct("path").alias("modules")).where(F.col("modules") >= minimum_importing_modules)
    rows = modules.relation("declaration").where("kind = 'class'").join(used, "name").where(~F.col("path").rlike(rf"(?:^|/){preferred_module}(?:\.py|/)"))
    return counted(modules, rows, text("`", F.col("name"), "` is shared by ", F.col("modules"), " modules"))


@rule("PY-IMPO0001", "ModuleFact", language="python")
def internal_absolute_import(modules: FactTable) -> Result:
    """Absolute imports of the file's own top package."""
    own = F.split("path", "/")[0]
    return counted_where(modules, "import", (F.col("level") == 0) & F.col("path").contains("/") & (F.substring_index("module", ".", 1) == own), text("`", F.col("module"), "` is the file's own package"))
