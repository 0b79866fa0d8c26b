"""Exact quantiles at the nearest rank, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUCKETS = 4096


def nearest_rank(frame: DataFrame, keys: list[str], value: str, q: float, buckets: int = BUCKETS) -> DataFrame:
    """keys, count, value: the value at rank rint((count - 1) q) of each group (nulls left out).

    Values are counted in equal buckets between a group's least and greatest value; only the rows of the bucket the rank
    falls into are ranked, and a bucket of one value needs no ranking.
    """
    rows = frame.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = F.when(F.col("_high") > F.col("_low"), (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    placed = rows.join(ends, keys).withColumn("_b", F.floor(share * buckets))
    w = Window.partitionBy(*keys)
    counted = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    counted = counted.withColumns({"count": F.sum("_n").over(w), "_before": F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rank = F.rint((F.col("count") - 1) * F.lit(q)).cast("long")
    hit = counted.withColumn("_rank", rank).where("_before <= _rank AND _rank < _before + _n")
    one = hit.where("_first = _last").select(*keys, "count", F.col("_first").alias("value"))
    many = placed.join(hit.where("_first <> _last").select(*keys, "_b", "count", "_before", "_rank"), [*keys, "_b"])
    ranked = many.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_v")) - 1 + F.col("_before")).where("_k = _rank")
    return one.unionByName(ranked.select(*keys, "count", F.col("_v").alias("value")))
