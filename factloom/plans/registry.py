"""Every core query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..context import queries as context
from ..operators import analytics, queries as data
from ..rules import queries as rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return data.queries() | analytics.QUERIES | rules.queries() | context.queries()


def oracle_sql() -> dict[str, str]:
    return data.oracle_sql() | analytics.SQL | rules.oracle_sql() | context.oracle_sql()


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    """Sentence-length uniformity of every document, judged and with the verdict: the shortest path through engine and operators."""
    return analytics.writ_sentence_uniformity(spark, directory).withColumn("failed", F.col("uniformity") > 90)
