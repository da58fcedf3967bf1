"""Problem 1: the summed n of every maker, though a few makers hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.skew import skew_aggregate, skew_join
from tidemark.session import table


def totals(spark: SparkSession, d: str) -> DataFrame:
    aggs = [("n_rows", "rows", None), ("n_sum", "sum", "n"), ("first_ts", "min", "min_ts"), ("last_ts", "max", "max_ts")]
    return skew_aggregate(table(spark, d, "maker_hour"), ["maker"], aggs)


def found(spark: SparkSession, d: str) -> DataFrame:
    per_maker = skew_aggregate(table(spark, d, "maker_hour"), ["maker"], [("n_sum", "sum", "n")])
    return per_maker.filter(F.col("maker").isNotNull() & (F.col("n_sum") >= 1000)).select("maker")


def row_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "maker_hour").select("collection", "hour", "maker", "event_type", "n")
    per_maker = skew_aggregate(rows, ["maker"], [("maker_n", "sum", "n")])
    return skew_join(rows, per_maker, ["maker"]).select("*", F.try_divide("n", "maker_n").alias("share"))


QUERIES = {
    "p1_found": (found, "SELECT maker FROM maker_hour WHERE maker IS NOT NULL GROUP BY maker HAVING sum(n) >= 1000"),
    "p1_maker_totals": (
        totals,
        "SELECT maker, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_sum, min(min_ts) AS first_ts, max(max_ts) AS last_ts FROM maker_hour GROUP BY maker",
    ),
    "p1_row_shares": (
        row_shares,
        "SELECT collection, hour, maker, event_type, n, n / m.maker_n AS share, m.maker_n FROM maker_hour"
        " JOIN (SELECT maker, CAST(sum(n) AS BIGINT) AS maker_n FROM maker_hour GROUP BY maker) m USING (maker)",
    ),
}
