"""Set-filtered floors, metadata, store status, lags, and rolling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators.grid import bucketed
from tidemark.operators.standing import live_intervals, standing_series
from tidemark.operators.tags import TOKEN, tokens_matching
from tidemark.plans.books import DAY_MS, END, START, series_sql
from tidemark.session import table
from tidemark.sources.metadata import explode_attributes

FLT = {"Season": ["Thaw", "High Sun", "Leaf Fall"]}


def multi_connection(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce("conn", F.lit("a"))
    return table(spark, d, "market_events").agg((F.min(label) != F.max(label)).alias("several"), F.count_if(label != "a").alias("others"))


def trait_set_floor(spark: SparkSession, d: str) -> DataFrame:
    """The standing floor of the tokens that a trait filter selects."""
    chosen = tokens_matching(table(spark, d, "traits"), FLT)
    asks = table(spark, d, "order_lives").filter("event_type = 'item_listed'").join(chosen, TOKEN, "left_semi")
    return standing_series(live_intervals(asks, "collection", START, END), "min", DAY_MS)


def metadata_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Traits written as token metadata (a list of pairs) and read again."""
    pairs = table(spark, d, "traits").groupBy(*TOKEN).agg(F.to_json(F.struct(F.collect_list(F.struct("trait_type", "value")).alias("attributes"))).alias("json"))
    good, _ = explode_attributes(pairs, TOKEN, "json")
    return good.groupBy(*TOKEN).agg(F.count(F.lit(1)).alias("pairs"), F.min("value").alias("first_value"), F.max("trait_type").alias("last_type"))


def store_status(spark: SparkSession, d: str) -> DataFrame:
    rate = F.max(F.when(F.col("implied_ethusd").isNotNull() & F.col("valid_ts").isNotNull(), F.struct("valid_ts", "implied_ethusd")))
    return table(spark, d, "market_events").agg(
        F.count(F.lit(1)).alias("events"), F.max("observed_ts").alias("last_observed"), F.max("valid_ts").alias("last_valid"), rate["implied_ethusd"].alias("rate"), F.count_if(F.col("valid_ts").isNull()).alias("untimed")
    )


def lag_profile(spark: SparkSession, d: str) -> DataFrame:
    """Observation lag in powers of two of a second per event type; negative lags apart (-1)."""
    lag = F.col("observed_ts") - F.col("valid_ts")
    step = F.when(lag < 0, -1).when(lag < 1, 0).otherwise(F.floor(F.log2(F.floor(lag))) + 1).cast("int")
    return table(spark, d, "market_events").filter("valid_ts is not null").groupBy("event_type", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").filter("event_type = 'item_received_bid' and price_eth is not null and not isnan(price_eth) and collection is not null")
    return bucketed(rows, "valid_ts", "price_eth", "max", "1d", keys=("collection",))


def rolling(spark: SparkSession, d: str) -> DataFrame:
    """Daily top bid per collection with its 7-bucket mean, running peak and drawdown; a collection has a row a day."""
    by = W.partitionBy("collection").orderBy("bucket")
    peak = F.max("value").over(by.rowsBetween(W.unboundedPreceding, 0))
    return _daily(spark, d).select("collection", "bucket", "value", F.round(F.avg("value").over(by.rowsBetween(-6, 0)), 9).alias("mean_7"), F.round(F.try_divide("value", peak) - 1, 9).alias("drawdown"))


_LOCAL_DAY = "CAST(epoch(timezone('America/Chicago', date_trunc('day', timezone('America/Chicago', to_timestamp(valid_ts))))) AS BIGINT)"

QUERIES = {
    "multi_connection": (multi_connection, "SELECT count(DISTINCT coalesce(conn, 'a')) > 1 AS several, count(*) FILTER (coalesce(conn, 'a') <> 'a') AS others FROM market_events"),
    "trait_set_floor": (trait_set_floor, series_sql("item_listed", "min", "AND (collection, token_id) IN (SELECT (collection, token_id) FROM traits WHERE trait_type = 'Season' AND value IN ('Thaw', 'High Sun', 'Leaf Fall'))")),
    "metadata_round_trip": (
        metadata_round_trip,
        "SELECT collection, token_id, count(*) AS pairs, min(trim(value)) AS first_value, max(trim(trait_type)) AS last_type FROM traits WHERE trim(value) <> '' GROUP BY ALL",
    ),
    "store_status": (
        store_status,
        "SELECT count(*) AS events, max(observed_ts) AS last_observed, max(valid_ts) AS last_valid, arg_max(implied_ethusd, struct_pack(a := valid_ts, b := implied_ethusd)) FILTER (implied_ethusd IS NOT NULL AND valid_ts IS NOT NULL) AS rate, count(*) FILTER (valid_ts IS NULL) AS untimed FROM market_events",
    ),
    "lag_profile": (
        lag_profile,
        "SELECT event_type, CAST(CASE WHEN l < 0 THEN -1 WHEN l < 1 THEN 0 ELSE floor(log2(floor(l))) + 1 END AS INTEGER) AS step, count(*) AS n FROM (SELECT event_type, observed_ts - valid_ts AS l FROM market_events WHERE valid_ts IS NOT NULL) GROUP BY ALL",
    ),
    "rolling_stats": (
        rolling,
        f"WITH d AS (SELECT collection, {_LOCAL_DAY} AS bucket, max(price_eth) AS value FROM market_events WHERE event_type = 'item_received_bid' AND price_eth IS NOT NULL AND NOT isnan(price_eth) AND collection IS NOT NULL AND valid_ts IS NOT NULL GROUP BY ALL)"
        " SELECT collection, bucket, value, round(avg(value) OVER (PARTITION BY collection ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 9) AS mean_7, round(value / max(value) OVER (PARTITION BY collection ORDER BY bucket ROWS UNBOUNDED PRECEDING) - 1, 9) AS drawdown FROM d",
    ),
}
