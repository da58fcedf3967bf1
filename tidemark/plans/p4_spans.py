"""Problem 4: continuous blind periods of every connection, and the clear stretches between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.times import duck_us, instant_us
from tidemark.operators.spans import periods
from tidemark.session import table

CLEAR_MS = 48 * 3_600_000


def found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gap_register").select(
        F.coalesce("conn_label", F.lit("a")).alias("conn_label"), instant_us(F.col("started_at")).alias("s"), instant_us(F.col("ended_at")).alias("t")
    )
    blind, between = periods(rows, "conn_label", "s", "t")
    ms = lambda c: F.floor(F.col(c) / F.lit(1000)).cast("bigint")
    out = lambda x, kind: x.select("conn_label", F.lit(kind).alias("kind"), ms("from").alias("from_ms"), ms("to").alias("to_ms"))
    return out(blind, "blind").unionByName(out(between.filter(F.col("to") - F.col("from") <= CLEAR_MS * 1000), "clear"))


SQL = f"""
WITH s AS (SELECT coalesce(conn_label, 'a') AS c, {duck_us("started_at")} AS s, {duck_us("ended_at")} AS t FROM gap_register),
m AS (SELECT *, max(t) OVER (PARTITION BY c ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s WHERE t > s),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM m),
b AS (SELECT c, k, min(s) AS s, max(t) AS t FROM i GROUP BY c, k),
n AS (SELECT *, lead(s) OVER (PARTITION BY c ORDER BY k) AS x FROM b)
SELECT c AS conn_label, 'blind' AS kind, s // 1000 AS from_ms, t // 1000 AS to_ms FROM b
UNION ALL SELECT c, 'clear', t // 1000, x // 1000 FROM n WHERE x - t <= {CLEAR_MS * 1000}
"""

QUERIES = {"p4_found": (found, SQL)}
