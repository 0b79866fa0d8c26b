"""Evidence from outside: providers that bring declared families as nested records, and dependency releases.

A provider names the families it brings with their schemas, and reads them. What it reads is held to what it declares, so
a rule never sees a column a provider made up. Families several providers bring are united; of one fact_id the provider
named first counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.facts import FactTable, record_table


class Provider(Protocol):
    """name; families: schema (DDL) of each family's records, fact_id first; read: the records of one family."""

    name: str
    families: dict[str, str]

    def read(self, spark: SparkSession, family: str) -> DataFrame: ...


class Recorded:
    """Families recorded as folders of JSON records below one root, `<root>/<family>/`; nothing is inferred."""

    def __init__(self, name: str, root: str, families: dict[str, str]):
        self.name, self.root, self.families = name, root, families

    def read(self, spark: SparkSession, family: str) -> DataFrame:
        return spark.read.schema(self.families[family]).option("mode", "PERMISSIVE").json(f"{self.root}/{family}")


def _held(provider: Provider, spark: SparkSession, family: str) -> DataFrame:
    declared = T.StructType.fromDDL(provider.families[family])
    records = provider.read(spark, family)
    missing = [f.name for f in declared if f.name not in records.columns]
    if "fact_id" not in declared.names or missing:
        raise ValueError(f"{provider.name} declares {family} without fact_id, or reads it without {missing}")
    return records.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in declared)).where("fact_id IS NOT NULL")


def tables(spark: SparkSession, providers: Iterable[Provider]) -> dict[str, FactTable]:
    """Fact tables of all families the providers bring."""
    brought: dict[str, list[DataFrame]] = {}
    for place, provider in enumerate(providers):
        for family in provider.families:
            brought.setdefault(family, []).append(_held(provider, spark, family).withColumns({"provider": F.lit(provider.name), "_place": F.lit(place)}))
    out = {}
    for family, frames in brought.items():
        every = frames[0]
        for frame in frames[1:]:
            every = every.unionByName(frame, allowMissingColumns=True)
        # An aggregate, so that a fact many providers or records name is reduced in each task before the shuffle.
        row = F.struct(*[c for c in every.columns if c not in ("_place", "fact_id")])
        one = every.groupBy("fact_id").agg(F.min_by(row, F.struct("_place", F.xxhash64(F.to_json(row)))).alias("_row"))
        out[family] = record_table(family, one.select("fact_id", "_row.*"))
    return out


def dependency_records(pins: DataFrame, releases: DataFrame) -> DataFrame:
    """Nested dependency records by manifest, from pinned dependencies and a table of releases.

    pins: fact_id, name, version, is_development. releases: name, version, major, day, is_yanked (day: number of a day).
    The latest compatible release has the pinned one's major number and is not yanked. A pin without its release, or a
    package without releases, has null evidence.
    """
    own = releases.groupBy("name", "version").agg(F.min("day").alias("resolved_release_day"), F.max("is_yanked").alias("yanked"), F.max("major").alias("major"))
    best = releases.where("NOT coalesce(is_yanked, false)").groupBy("name", "major").agg(F.max(F.struct("day", "version")).alias("b"))
    rows = pins.dropDuplicates(["fact_id", "name"]).join(own, ["name", "version"], "left").join(best, ["name", "major"], "left")
    record = F.struct(
        "name", F.coalesce("is_development", F.lit(False)).alias("is_development"), "resolved_release_day", F.greatest("b.day", "resolved_release_day").alias("latest_compatible_release_day"), F.col("b.version").alias("latest_compatible_version"),
        F.lit("unknown").alias("project_state"), F.lit("unknown").alias("repository_state"), F.when(F.col("yanked"), "yanked").when(F.col("yanked").isNotNull(), "available").otherwise("unknown").alias("resolved_release_state"),
    )
    return rows.groupBy("fact_id").agg(F.sort_array(F.collect_list(record)).alias("dependencies"))
