"""Fact tables: a family's relations as DataFrames, and the operators every rule composes.

A family has a `facts` relation with one row per fact (IDENTITY columns and its scalars) and child relations whose rows
carry fact_id and ordinal. Relations stay natively typed, so column pruning and filters reach the scans below them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

IDENTITY = ["fact_order", "fact_id", "path", "start_line", "start_column", "end_line", "end_column", "language"]


class FactTable:
    """The relations of one family. `required` names the relations that must be there, no more and no fewer."""

    def __init__(self, family: str, relations: dict[str, DataFrame], required: set[str] | None = None):
        required = {"facts"} if required is None else required | {"facts"}
        if (len(required) > 1 and set(relations) != required) or "facts" not in relations:
            raise ValueError(f"{family} has the relations {sorted(relations)}, not {sorted(required)}")
        self.family, self.relations = family, relations

    def relation(self, name: str) -> DataFrame:
        return self.relations[name]

    def identity(self) -> DataFrame:
        return self.relations["facts"].select(*IDENTITY)

    def facts(self) -> DataFrame:
        """The facts with their evidence as an ordered list, empty where there is none."""
        facts = self.relations["facts"]
        if "evidence" not in self.relations:
            return facts.withColumn("evidence", F.array().cast("array<string>")) if "evidence" not in facts.columns else facts
        rows = self.relations["evidence"].groupBy("fact_id").agg(ordered("detail", "ordinal").alias("evidence"))
        return facts.join(rows, "fact_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))

    def restricted(self, *languages: str) -> FactTable:
        """The table as rules of one language see it; only the identity relation is filtered, rules join to it."""
        return FactTable(self.family, self.relations | {"facts": self.relations["facts"].where(F.col("language").isin(*languages))}, set(self.relations) - {"facts"})

    def counted(self, rows: DataFrame, amount: Column | None = None, name: str = "count") -> DataFrame:
        """Every fact with the number of its rows (or the sum of an amount), 0 where there are none."""
        made = rows.groupBy("fact_id").agg((F.count("*") if amount is None else F.sum(amount)).alias(name))
        return self.facts().join(made, "fact_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))

    def coverage(self, population: DataFrame, met: Column, name: str = "coverage") -> DataFrame:
        """Every fact with 100 times the share of its population that meets a condition, 0 for an empty population."""
        made = population.groupBy("fact_id").agg((F.sum(F.coalesce(met, F.lit(False)).cast("int")) * 100.0 / F.count("*")).alias(name))
        return self.facts().join(made, "fact_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))

    def value_counts(self, relation: str) -> DataFrame:
        return self.counted(self.relations[relation])


def ordered(value: str | Column, *keys: str) -> Column:
    """The aggregate of a value as a list in the order of the keys."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.sort_array(F.collect_list(F.struct(*keys, value.alias("_value")))), lambda x: x["_value"])


def first_per(frame: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in a stated order."""
    return frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


#: Repeated keys are sent to every task only up to this number.
FEW = 100_000


def latest(frame: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in a stated order, for wide rows few of which are repeated: only repeated keys' rows are shuffled.

    The repeated keys are counted first (a job over the key column alone): none leave the frame as it is, few are
    broadcast, many are joined.
    """
    again = written(frame.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    n = again.count()
    if not n:
        return frame
    again = F.broadcast(again) if n <= FEW else again
    return frame.join(again, key, "left_anti").unionByName(first_per(frame.join(again, key, "left_semi"), [key], *order).select(*frame.columns))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def filled(text: Column) -> Column:
    """Whether a text holds more than white space; null does not."""
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def significant(value: Column, digits: int = 4) -> Column:
    """A number rounded half to even to so many significant digits."""
    value = value.cast("double")
    power = digits - 1 - F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), power.cast("double"))
    return F.when(value.isNull(), None).when(value == 0, 0.0).otherwise(F.rint(value * scale) / scale)


def record_table(family: str, records: DataFrame) -> FactTable:
    """A fact table from nested records: one row per fact with its scalars and its lists of objects.

    A list of objects becomes a relation of that name (fact_id, ordinal from 0, path, and the objects' fields); other
    columns stay on the facts. Identity columns the records lack are filled: path '', lines 1, columns 0, no language, and
    for the order a hash of the fact_id.
    """
    have = dict(records.dtypes)
    defaults = {"fact_order": F.abs(F.xxhash64("fact_id")), "path": F.lit(""), "start_line": F.lit(1), "start_column": F.lit(0), "end_line": F.lit(1), "end_column": F.lit(0), "language": F.lit(None).cast("string")}
    for name, value in defaults.items():
        if name not in have:
            records = records.withColumn(name, value.cast("string" if name in ("path", "language") else "long"))
    nested = [c for c, t in have.items() if t.startswith("array<struct<")]
    relations = {"facts": records.drop(*nested)}
    for name in nested:
        rows = records.select("fact_id", F.col("path").alias("_path"), F.posexplode(name).alias("ordinal", "_row"))
        fields = [f.name for f in records.schema[name].dataType.elementType.fields]
        relations[name] = rows.select("fact_id", F.col("ordinal").cast("long").alias("ordinal"), *([] if "path" in fields else [F.col("_path").alias("path")]), "_row.*")
    return FactTable(family, relations)
