"""A materialised hourly pre-aggregate, and answers over any range from it plus the edge hours' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly(rows: DataFrame) -> DataFrame:
    """The hourly rollup of events: n, min_ts and max_ts per collection, hour, maker ('' = none) and type."""
    hour = F.floor(F.col("valid_ts") / 3_600).cast("bigint")
    timed = rows.filter("valid_ts is not null and collection is not null")
    return timed.groupBy("collection", hour.alias("hour"), F.coalesce("maker", F.lit("")).alias("maker"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("valid_ts").alias("min_ts"), F.max("valid_ts").alias("max_ts"))


def from_rollup(rollup: DataFrame, rows: DataFrame, start: float, end: float) -> DataFrame:
    """Counts per maker and type over [start, end): whole hours from the rollup, the edge hours from the rows."""
    lo, hi = -int(-start // 3_600), int(end // 3_600)
    whole = rollup.filter((F.col("hour") >= lo) & (F.col("hour") < hi)).groupBy("maker", "event_type").agg(F.sum("n").alias("n"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    edge = rows.filter("collection is not null").filter((F.col("valid_ts") >= start) & (F.col("valid_ts") < end) & ((F.col("valid_ts") < lo * 3_600) | (F.col("valid_ts") >= max(lo, hi) * 3_600)))
    rest = edge.groupBy(F.coalesce("maker", F.lit("")).alias("maker"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("valid_ts").alias("min_ts"), F.max("valid_ts").alias("max_ts"))
    return whole.unionByName(rest).groupBy("maker", "event_type").agg(F.sum("n").alias("n"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
