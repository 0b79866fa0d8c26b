"""Rules over classes, their methods, and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.facts import FactTable
from ..operators.text import out_of_order
from ..plans import shaping
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import counted, flag, located, measured, text

# Bases and decorators that make a class a model, a protocol or an enum.
MODEL_BASES = ("BaseModel", "pydantic.BaseModel", "SQLModel", "Struct", "msgspec.Struct")
DATACLASSES = ("dataclass", "dataclasses.dataclass")


@rule("ALL-CLAS0001", "ClassFact")
def class_method_order(classes: FactTable) -> Result:
    """Members that stand out of the canonical order: lifecycle, protocol, visibility, kind, name."""
    key = [F.col("lifecycle"), (~F.col("protocol")).cast("int"), F.col("visibility"), F.col("kind"), F.col("name")]
    return counted(classes, located(out_of_order(classes.relation("methods"), ["fact_id"], ["ordinal"], key)), text("`", F.col("name"), "` belongs at place ", F.col("expected_rank")))


@rule("ALL-CLAS0003", "ClassFact", policy=Numeric(maximum=10))
def public_method_count(classes: FactTable) -> Result:
    """Public methods of a class."""
    return measured(classes, F.col("public_methods"), text("`", F.col("name"), "` has ", F.col("public_methods"), " public methods"))


@rule("ALL-CLAS0004", "ClassFact", policy=Numeric(maximum=7))
def declared_field_count(classes: FactTable) -> Result:
    """Fields a class declares."""
    return measured(classes, F.col("fields"), text("`", F.col("name"), "` declares ", F.col("fields"), " fields"))


@rule("PY-CLAS0003", "ClassFact", output="boolean", language="python")
def utility_namespace_class(classes: FactTable) -> Result:
    """A class without bases or fields whose methods use no state."""
    stateful = classes.relation("methods").groupBy("fact_id").agg(F.count(F.when(F.col("reads_state") & ~F.col("is_class"), 1)).alias("_stateful"))
    table = FactTable("ClassFact", {"facts": classes.facts().join(stateful, "fact_id", "left")})
    return flag(table, (F.col("methods") > 0) & (F.col("_stateful") == 0) & (F.col("fields") == 0) & (F.size("bases") == 0), text("`", F.col("name"), "` is only a namespace"))


@rule("PY-CLAS0006", "ClassFact", output="boolean", language="python")
def pass_through_class(classes: FactTable, contract_suffixes: tuple[str, ...] = ("Backend", "Error", "Exception", "Protocol")) -> Result:
    """A subclass that adds nothing, unless its name states a contract."""
    contract = F.lit(False)
    for s in contract_suffixes:
        contract = contract | F.col("name").endswith(s)
    return flag(classes, F.col("is_empty") & (F.size("bases") == 1) & ~contract, text("`", F.col("name"), "` adds nothing to its base"))


@rule("PY-MODE0005", "ClassFact", output="boolean", language="python")
def standard_dataclass_model(classes: FactTable) -> Result:
    """A dataclass with fields and no behaviour."""
    return flag(classes, F.arrays_overlap("decorators", F.array(*map(F.lit, DATACLASSES))) & (F.col("fields") > 0) & (F.col("public_methods") == 0), text("`", F.col("name"), "` only holds data"))


@rule("PY-MODE0006", "ClassFact", output="boolean", language="python")
def empty_declarative_model(classes: FactTable) -> Result:
    """A model class without fields."""
    return flag(classes, F.arrays_overlap("bases", F.array(*map(F.lit, MODEL_BASES))) & (F.col("fields") == 0) & (F.col("methods") == 0), text("`", F.col("name"), "` is a model without fields"))


@rule("ALL-DUPL0001", "ClassFact")
def repeated_class_method(classes: FactTable) -> Result:
    """A method whose body a sibling of the same base repeats."""
    methods = classes.relation("methods").where("body <> '' AND NOT protocol").select("fact_id", "path", "ordinal", "name", "body", "line")
    based = methods.join(classes.facts().select("fact_id", F.explode("bases").alias("base")), "fact_id")
    twice = based.groupBy("base", "name", "body").agg(F.count_distinct("fact_id").alias("copies")).where("copies > 1")
    rows = based.join(twice, ["base", "name", "body"]).select("fact_id", "path", "ordinal", "name", "base", "line", "copies").dropDuplicates(["fact_id", "ordinal"])
    return counted(classes, located(rows), text("`", F.col("name"), "` stands in ", F.col("copies"), " children of `", F.col("base"), "`"), (("copies", F.col("copies"), "count"),))


def overrides(classes: FactTable) -> DataFrame:
    """Each method with the one of the same name in a base of its class (bases by name within the same table; the least path counts)."""
    methods = classes.relation("methods")
    own = classes.facts().select("fact_id", F.explode("bases").alias("b"))
    base = classes.facts().groupBy(F.col("name").alias("base")).agg(F.min("fact_id").alias("base_id"))
    links = own.select("fact_id", F.substring_index("b", ".", -1).alias("base")).join(base, "base")
    theirs = methods.select(F.col("fact_id").alias("base_id"), "name", *(F.col(c).alias(f"base_{c}") for c in ("positional", "defaults", "required_keywords", "has_args", "has_kwargs", "is_async", "is_property", "is_static", "is_class", "is_final", "is_abstract")))
    return methods.join(links, "fact_id").join(theirs, ["base_id", "name"])


def _override(classes: FactTable, condition: Column, message: Column) -> Result:
    return counted(classes, located(overrides(classes).where(condition)), message)




@rule("ALL-OVER0001", "ClassFact")
def overriding_method_accepts_different_arguments(classes: FactTable) -> Result:
    """An override that takes fewer positional arguments or misses keywords callers rely on."""
    fewer = (F.size("positional") < F.size("base_positional")) & ~F.col("has_args")
    more = (F.size("positional") - F.col("defaults") > F.size("base_positional")) & ~F.col("base_has_args")
    missing = (F.size(F.array_except("required_keywords", "base_required_keywords")) > 0) & ~F.col("base_has_kwargs")
    return _override(classes, (F.col("name") != "__init__") & (fewer | more | missing), text("`", F.col("name"), "` cannot be called as in `", F.col("base"), "`"))


@rule("ALL-OVER0002", "ClassFact")
def overriding_method_renames_a_parameter(classes: FactTable) -> Result:
    """An override that names a positional parameter differently at the same place."""
    differs = F.exists(F.arrays_zip(F.slice("positional", 1, F.greatest(F.least(F.size("positional"), F.size("base_positional")), F.lit(0))).alias("a"), F.slice("base_positional", 1, F.greatest(F.least(F.size("positional"), F.size("base_positional")), F.lit(0))).alias("b")), lambda x: x["a"] != x["b"])
    return _override(classes, (F.col("name") != "__init__") & differs, text("`", F.col("name"), "` renames a parameter of `", F.col("base"), "`"))


@rule("ALL-OVER0003", "ClassFact")
def overriding_method_withdraws_a_default(classes: FactTable) -> Result:
    """An override with fewer defaults than the base for the same parameters."""
    return _override(classes, (F.col("name") != "__init__") & (F.col("defaults") < F.col("base_defaults")) & (F.size("positional") >= F.size("base_positional")), text("`", F.col("name"), "` demands what `", F.col("base"), "` defaulted"))


@rule("ALL-OVER0004", "ClassFact")
def overriding_method_changes_its_protocol(classes: FactTable) -> Result:
    """An override that turns a method into a property, a coroutine or a class method, or back."""
    changed = F.lit(False)
    for c in ("is_async", "is_property", "is_static", "is_class"):
        changed = changed | (F.col(c) != F.col(f"base_{c}"))
    return _override(classes, changed, text("`", F.col("name"), "` is called differently in `", F.col("base"), "`"))


@rule("ALL-OVER0005", "ClassFact")
def abstract_member_left_unimplemented(classes: FactTable) -> Result:
    """A concrete subclass that leaves an abstract member of its base open."""
    methods = classes.relation("methods")
    abstract = methods.where("is_abstract").select(F.col("fact_id").alias("base_id"), "name", "ordinal")
    own = classes.facts().select("fact_id", "path", "start_line", "start_column", "end_line", "end_column", F.col("name").alias("class_name"), F.explode("bases").alias("b"))
    base = classes.facts().groupBy(F.col("name").alias("base")).agg(F.min("fact_id").alias("base_id"))
    open_ = own.withColumn("base", F.substring_index("b", ".", -1)).join(base, "base").join(abstract, "base_id").join(methods.select("fact_id", "name"), ["fact_id", "name"], "left_anti")
    concrete = open_.join(methods.where("is_abstract").select("fact_id").distinct(), "fact_id", "left_anti")
    return counted(classes, concrete, text("`", F.col("class_name"), "` leaves `", F.col("name"), "` of `", F.col("base"), "` open"))


@rule("ALL-OVER0008", "ClassFact")
def final_method_overridden(classes: FactTable) -> Result:
    """An override of a final member."""
    return _override(classes, F.col("base_is_final"), text("`", F.col("name"), "` is final in `", F.col("base"), "`"))


@rule("ALL-OVER0009", "ClassFact", output="boolean")
def final_class_subclassed(classes: FactTable) -> Result:
    """A subclass of a final class."""
    final = classes.facts().where(F.exists("decorators", lambda x: x.isin("final", "typing.final"))).select(F.col("name").alias("_base")).distinct()
    hit = classes.facts().select("fact_id", F.explode("bases").alias("b")).select("fact_id", F.substring_index("b", ".", -1).alias("_base")).join(final, "_base").groupBy("fact_id").agg(F.min("_base").alias("_base"))
    return flag(FactTable("ClassFact", {"facts": classes.facts().join(hit, "fact_id", "left")}), F.col("_base").isNotNull(), text("`", F.col("name"), "` extends the final class `", F.col("_base"), "`"))


@rule("PY-CLAS0005", "ClassFact", output="boolean", language="python")
def single_subclass_base(classes: FactTable) -> Result:
    """A base with exactly one subclass and no abstract member."""
    children = classes.facts().select("fact_id", F.explode("bases").alias("b")).select("fact_id", F.substring_index("b", ".", -1).alias("name")).groupBy("name").agg(F.count_distinct("fact_id").alias("_children"))
    abstract = classes.relation("methods").groupBy("fact_id").agg(F.bool_or("is_abstract").alias("_abstract"))
    table = FactTable("ClassFact", {"facts": classes.facts().join(children, "name", "left").join(abstract, "fact_id", "left")})
    return flag(table, (F.col("_children") == 1) & ~F.coalesce(F.col("_abstract"), F.lit(False)), text("`", F.col("name"), "` has a single subclass"))


@rule("PY-INTE0002", "ClassFact", output="boolean", language="python")
def single_implementation_abstract_base(classes: FactTable) -> Result:
    """An abstract base with exactly one implementation."""
    children = classes.facts().select("fact_id", F.explode("bases").alias("b")).select("fact_id", F.substring_index("b", ".", -1).alias("name")).groupBy("name").agg(F.count_distinct("fact_id").alias("_children"))
    abstract = classes.relation("methods").groupBy("fact_id").agg(F.bool_or("is_abstract").alias("_abstract"))
    table = FactTable("ClassFact", {"facts": classes.facts().join(children, "name", "left").join(abstract, "fact_id", "left")})
    return flag(table, (F.col("_children") == 1) & F.col("_abstract"), text("`", F.col("name"), "` has a single implementation"))


@rule("PY-CLAS0007", "ClassFact", language="python")
def colliding_direct_bases(classes: FactTable) -> Result:
    """Direct bases that declare the same ordinary method."""
    base = classes.facts().groupBy(F.col("name").alias("base")).agg(F.min("fact_id").alias("base_id"))
    own = classes.facts().where(F.size("bases") > 1).select("fact_id", "path", "start_line", "start_column", "end_line", "end_column", F.posexplode("bases").alias("k", "b")).withColumn("base", F.substring_index("b", ".", -1)).join(base, "base")
    named = own.join(classes.relation("methods").where("NOT protocol").select(F.col("fact_id").alias("base_id"), "name"), "base_id")
    rows = named.groupBy("fact_id", "path", "start_line", "start_column", "end_line", "end_column", "name").agg(F.count_distinct("base").alias("n")).where("n > 1").withColumn("ordinal", F.lit(0))
    return counted(classes, rows, text("several bases declare `", F.col("name"), "`"))


def ancestors(values: DataFrame) -> Result:
    """Number of ancestors, from rows with the identity columns and `ancestors` (see the hierarchy operator)."""
    return shaping.integer(values, F.col("ancestors"))
