"""Rules over statements, handlers, literals and bindings of a module."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.facts import FactTable
from ..operators.text import placeholder, secret_name
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import counted, counted_where, flag, highest, text

# Base errors of the language, generators that are no secret source.
BASE_ERRORS = ("Exception", "BaseException", "Error")
RANDOM = r"^(?:random|np\.random|numpy\.random)\.|\brandom\."


@rule("ALL-BRAN0001", "ModuleFact")
def value_dispatch_candidate(modules: FactTable, minimum_arms: int = 3) -> Result:
    """A chain that compares one subject with distinct literals."""
    return counted_where(modules, "branch", (F.col("arms") >= minimum_arms) & (F.col("literals") == F.col("arms")), text("`", F.col("subject"), "` is looked up by ", F.col("arms"), " comparisons"))


@rule("ALL-CONT0001", "ModuleFact")
def superfluous_else_after_jump(modules: FactTable) -> Result:
    """An else after a branch that always leaves."""
    return counted_where(modules, "block", F.expr("else_after_jump"), text("the else is not needed"))


@rule("ALL-CONT0002", "ModuleFact")
def statement_without_effect(modules: FactTable) -> Result:
    """An expression statement without effect."""
    return counted(modules, modules.relation("effect"), text("a ", F.col("kind"), " stands for itself"))


@rule("ALL-CONT0004", "ModuleFact", output="boolean")
def deeply_nested_body(modules: FactTable, maximum_depth: int = 3) -> Result:
    """A body nested deeper than the maximum: the greatest number of pre-order intervals that enclose one body.

    A sweep over the pre-order adds one where an interval opens and takes one where it closes, so no range join is needed.
    """
    b = modules.relation("block").select("fact_id", "ordinal", "subtree_end")
    events = b.select("fact_id", F.col("ordinal").alias("at"), F.lit(1).alias("n")).unionByName(b.select("fact_id", F.col("subtree_end").alias("at"), F.lit(-1).alias("n"))).groupBy("fact_id", "at").agg(F.sum("n").alias("n"))
    depth = events.withColumn("d", F.sum("n").over(Window.partitionBy("fact_id").orderBy("at"))).groupBy("fact_id").agg(F.max("d").alias("_depth"))
    return flag(FactTable("ModuleFact", {"facts": modules.facts().join(depth, "fact_id", "left")}), F.col("_depth") > maximum_depth, text(F.col("path"), " nests ", F.col("_depth"), " bodies"))


@rule("ALL-ENCA0001", "ModuleFact")
def external_nonpublic_attribute_access(modules: FactTable, allowed: tuple[str, ...] = ()) -> Result:
    """Access to a nonpublic attribute from outside."""
    rows = modules.relation("attribute")
    return counted(modules, rows.where(~F.col("name").isin(*allowed)) if allowed else rows, text("`", F.col("receiver"), ".", F.col("name"), "` is not public"))


@rule("ALL-ERRO0001", "ModuleFact")
def swallowed_error(modules: FactTable) -> Result:
    """A handler that does nothing."""
    return counted_where(modules, "handler", F.expr("is_inert"), text("the error is swallowed"))


@rule("ALL-ERRO0002", "ModuleFact")
def raise_without_cause(modules: FactTable) -> Result:
    """A raise in a handler that names neither the caught error nor a cause."""
    return counted_where(modules, "raise", F.expr("in_handler AND NOT has_cause AND NOT names_alias"), text("`", F.col("type"), "` loses its cause"))


@rule("ALL-ERRO0003", "ModuleFact")
def vanilla_error_type(modules: FactTable, base_errors: tuple[str, ...] = BASE_ERRORS) -> Result:
    """A raise of the language's base error."""
    return counted_where(modules, "raise", F.col("type").isin(*base_errors), text("`", F.col("type"), "` says nothing"))


@rule("ALL-ERRO0004", "ModuleFact")
def raise_inside_guarded_region(modules: FactTable) -> Result:
    """A handler that catches what its own region raises."""
    return counted_where(modules, "handler", F.expr("catches_own"), text("the region catches its own error"))


@rule("PY-EXCE0001", "ModuleFact", language="python")
def broad_try_literal_setup(modules: FactTable) -> Result:
    """Literal assignments inside a try before the statement that may raise."""
    return counted_where(modules, "try", F.expr("literal_setup > 0"), text(F.col("literal_setup"), " assignments cannot raise"))


@rule("PY-EXCE0002", "ModuleFact", policy=Numeric(maximum=1), language="python")
def bounded_exception_region(modules: FactTable) -> Result:
    """Most statements in a clause of a try."""
    return highest(modules, modules.relation("try"), "longest", text("a clause holds ", F.col("longest"), " statements"))


@rule("PY-EXCE0004", "ModuleFact", language="python")
def nullable_exception_return(modules: FactTable) -> Result:
    """A handler that only returns None."""
    return counted_where(modules, "handler", F.expr("returns_none AND guarded = 1"), text("the error becomes None"))


@rule("PY-COMP0001", "ModuleFact", policy=Numeric(maximum=2), language="python")
def comprehension_loop_count(modules: FactTable) -> Result:
    """Most loops of one comprehension."""
    return highest(modules, modules.relation("comprehension"), "loops", text("a ", F.col("kind"), " has ", F.col("loops"), " loops"))


@rule("ALL-NAMI0001", "ModuleFact")
def uninformative_local_name(modules: FactTable, minimum_length: int = 3, indexes: tuple[str, ...] = ("i", "j", "k", "x", "y", "z", "_")) -> Result:
    """Bound names that are shorter than a minimum and no conventional index."""
    return counted_where(modules, "binding", (F.length("name") < minimum_length) & ~F.col("name").isin(*indexes), text("`", F.col("name"), "` says nothing"))


@rule("ALL-SECU0003", "ModuleFact")
def unseeded_randomness_for_secrets(modules: FactTable) -> Result:
    """A secret-looking name fed by a predictable generator."""
    return counted_where(modules, "binding", secret_name(F.col("name")) & F.col("value_text").rlike(RANDOM), text("`", F.col("name"), "` is predictable"))


@rule("ALL-SECU0004", "ModuleFact")
def credential_written_into_source(modules: FactTable) -> Result:
    """A literal bound to a secret-looking name. The literal is never shown."""
    rows = modules.relation("binding").where(secret_name(F.col("name")) & (F.col("value_kind") == "constant") & F.col("value_text").rlike("^['\"]") & ~placeholder(F.regexp_replace("value_text", "^['\"]|['\"]$", "")))
    return counted(modules, rows, text("`", F.col("name"), "` is written into the source"))


@rule("ALL-STRI0001", "ModuleFact")
def fragmented_multiline_literal(modules: FactTable, minimum_fragments: int = 2) -> Result:
    """A literal of several pieces on several lines."""
    return counted_where(modules, "literal", F.col("fragments") >= minimum_fragments, text("a literal of ", F.col("fragments"), " pieces"))


@rule("ALL-DUPL0002", "ModuleFact")
def repeated_semantic_string_literal(modules: FactTable, minimum_occurrences: int = 3, minimum_files: int = 2, minimum_length: int = 12) -> Result:
    """The same long literal in the same role in several files."""
    rows = modules.relation("literal").where(F.length("text") >= minimum_length)
    many = rows.groupBy("text", "role").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).where((F.col("n") >= minimum_occurrences) & (F.col("files") >= minimum_files))
    return counted(modules, rows.join(many, ["text", "role"]), text("a literal stands in ", F.col("files"), " files"), (("occurrences", F.col("n"), "count"),))
