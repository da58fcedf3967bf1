"""Problem 6: hourly counts per collection by event time, corrected up to a cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.times import duck_us, instant_ms, instant_us
from tidemark.operators.late import CORRECTION, HOUR_MS, IN_TIME, PeriodCounts, first_copies, issues, marks, value_counts
from tidemark.operators.once import arrival_batches, arrival_edges
from tidemark.session import cut, table, work_folder

GRACE_MS, CUTOFF_MS = 120_000, 6 * 3_600_000
BATCHES = 3


def _state(spark: SparkSession, d: str) -> PeriodCounts:
    """The state after all messages, merged in batches by observed time; hours past their cut-off are closed on the way."""
    rows = table(spark, d, "market_events")
    seen = F.coalesce(instant_us(F.col("observed_at")), F.round(F.col("observed_ts") * 1e6).cast("bigint"))
    timed = rows.select("run", "seq", seen.alias("o"), "collection", "valid_at", "price_eth")
    once = first_copies(timed, ["run", "seq"], "o", ["collection", "valid_at", "price_eth"])
    ready = once.select("collection", instant_ms(F.col("valid_at")).alias("event_ms"), F.floor(F.col("o") / F.lit(1000)).cast("bigint").alias("observed_ms"), "price_eth")
    state, ready = PeriodCounts(spark, work_folder(spark, "periods")), cut(ready)
    edges = arrival_edges(ready, "observed_ms", BATCHES)
    for i, batch in enumerate(arrival_batches(ready, "observed_ms", edges)):
        # when a batch is in, the hours whose cut-off lies before its end take no more corrections
        closed = int((edges[i] - CUTOFF_MS) // HOUR_MS) if i < len(edges) else None
        state.merge(value_counts(batch, "collection", "event_ms", "observed_ms", "price_eth", GRACE_MS, CUTOFF_MS), f"{i:06d}", closed)
    return state


def counts(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).read()


def found(spark: SparkSession, d: str) -> DataFrame:
    return marks(counts(spark, d)).select(F.col("key").alias("collection"), F.col("period").alias("hour"), "what")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    state = counts(spark, d)
    both = issues(state, {"first": IN_TIME, "final": CORRECTION})
    refused = state.filter("round = 2").groupBy("key", "period").agg(F.sum("n").alias("n_refused"))
    zero = {f"{c}_{k}": 0 for c in ("n", "n_values", "n_distinct") for k in ("first", "final")} | {"n_refused": 0}
    return both.join(refused, ["key", "period"], "full").fillna(zero).withColumnsRenamed({"key": "collection", "period": "hour"})


_BASE = f"""
WITH once AS (SELECT collection, {duck_us("valid_at")} // 1000 AS e, {duck_us("observed_at")} // 1000 AS o, CASE WHEN NOT isnan(price_eth) THEN price_eth END AS v
  FROM market_events QUALIFY run IS NULL OR seq IS NULL OR row_number() OVER (PARTITION BY run, seq ORDER BY {duck_us("observed_at")}, collection NULLS FIRST, valid_at NULLS FIRST, price_eth NULLS FIRST) = 1),
m AS (SELECT collection, CAST(floor(e / {3_600_000}) AS BIGINT) AS hour, o - (CAST(floor(e / {3_600_000}) AS BIGINT) + 1) * {3_600_000} AS lag, v FROM once WHERE collection IS NOT NULL AND e IS NOT NULL)
"""
_AGG = "CAST(count(*) FILTER ({w}) AS BIGINT) AS n_{k}, count(v) FILTER ({w}) AS n_values_{k}, count(DISTINCT v) FILTER ({w}) AS n_distinct_{k}, min(v) FILTER ({w}) AS lowest_{k}, max(v) FILTER ({w}) AS highest_{k}, median(v) FILTER ({w}) AS median_{k}"

QUERIES = {
    "p6_found": (
        found,
        _BASE + f"SELECT DISTINCT collection, hour, CASE WHEN lag <= {CUTOFF_MS} THEN 'corrected' ELSE 'refused' END AS what FROM m WHERE lag > {GRACE_MS}",
    ),
    "p6_hourly": (
        hourly,
        _BASE + f"SELECT collection, hour, {_AGG.format(k='first', w=f'lag <= {GRACE_MS}')}, {_AGG.format(k='final', w=f'lag <= {CUTOFF_MS}')}, count(*) FILTER (lag > {CUTOFF_MS}) AS n_refused FROM m GROUP BY collection, hour",
    ),
}
