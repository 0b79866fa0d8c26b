"""Common result shapes of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.facts import FactTable
from ..plans import shaping
from ..plans.contracts import Result
from ..plans.shaping import Counting, Measure, located


def counted(table: FactTable, rows: DataFrame, message: Column, measurements: tuple = ()) -> Result:
    """The number of rows of each fact, with a finding for each."""
    return shaping.integer(table.counted(rows), "count", shaping.findings(located(rows), message, measurements))


def counted_where(table: FactTable, relation: str, condition: Column, message: Column) -> Counting:
    """The number of a relation's rows that meet a condition, with a finding for each."""
    return Counting(table, relation, condition, message)


def flag(table: FactTable, condition: Column, message: Column) -> Measure:
    """Whether a condition holds for a fact, with a finding where it does; null conditions are false."""
    return Measure(table, condition, message, "boolean")


def measured(table: FactTable, value: Column, message: Column, unit: str = "count") -> Measure:
    """An integer of each fact, with one finding that states it."""
    return Measure(table, value, message, "integer", unit)


def highest(table: FactTable, rows: DataFrame, value: str, message: Column) -> Result:
    """The greatest value among a fact's rows (0 without rows), with a finding for every row that has it."""
    top = rows.groupBy("fact_id").agg(F.max(value).alias("_top"))
    facts = table.facts().join(top, "fact_id", "left").withColumn("_top", F.coalesce("_top", F.lit(0)))
    at = rows.join(top, "fact_id").where(F.col(value) == F.col("_top"))
    return shaping.integer(facts, F.col("_top"), shaping.findings(located(at), message))


def covered(table: FactTable, population: DataFrame, met: Column, message: Column) -> Result:
    """The percentage of a fact's population that meets a condition, with a finding for each member that does not."""
    missed = population.where(~F.coalesce(met, F.lit(False)))
    return shaping.floating(table.coverage(population, met), "coverage", shaping.findings(located(missed.join(table.identity().select("fact_id", "path"), "fact_id") if "path" not in missed.columns else missed), message))


def text(*parts: Column | str) -> Column:
    """A message of texts and columns; a null part shows as nothing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
