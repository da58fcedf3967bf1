"""Series on full grids: metrics per bucket, gap masks, transforms, ranges, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.times import duck_us, instant_us
from tidemark.operators.grid import bucket_grid, mask_gaps, range_start, series, transform
from tidemark.operators.spans import periods
from tidemark.session import table

COLLECTION, START, END = "ember-beetles", 1_706_745_600, 1_709_251_200
PLACED = ("item_listed", "item_received_bid", "collection_offer", "trait_offer", "item_received_offer")


def _events(spark: SparkSession, d: str, *types: str) -> DataFrame:
    rows = table(spark, d, "market_events").filter(F.col("collection") == COLLECTION)
    return rows.filter(F.col("event_type").isin(*types)) if types else rows


def _metric(agg: str, value: str | None, interval: str, *types: str, start: float = START, end: float = END):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _events(spark, d, *types)
        if value:
            rows = rows.filter(~F.isnan(value) & F.col(value).isNotNull())
        out = series(rows, "valid_ts", value, agg, interval, start, end).drop("bucket_end")
        return out.withColumn("value", F.round("value", 9)) if agg == "sum" else out

    return run


def _floor(spark: SparkSession, d: str) -> DataFrame:
    return series(_events(spark, d, "item_listed").filter("not isnan(price_eth)"), "valid_ts", "price_eth", "min", "6h", START, END)


def _transformed(kind: str):
    return lambda spark, d: transform(_floor(spark, d), kind).select("bucket", F.round("value", 9).alias("value"))


def _blind(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gap_register").filter(F.coalesce("conn_label", F.lit("a")) == "a")
    spans = rows.select(F.lit("a").alias("c"), instant_us(F.col("started_at")).alias("s"), instant_us(F.col("ended_at")).alias("t"))
    merged, _ = periods(spans, "c", "s", "t")
    return merged.select((F.col("from") / 1e6).alias("from"), (F.col("to") / 1e6).alias("to"))


def gap_mask(spark: SparkSession, d: str) -> DataFrame:
    counts = series(_events(spark, d), "valid_ts", None, "count", "1h", START, END)
    return mask_gaps(counts, _blind(spark, d), END, "1h").select("bucket", "value", "blind_s")


def observed_spread(spark: SparkSession, d: str) -> DataFrame:
    bid = series(_events(spark, d, "collection_offer").filter("not isnan(price_eth)"), "valid_ts", "price_eth", "max", "6h", START, END)
    both = _floor(spark, d).select("bucket", F.col("value").alias("ask")).join(bid.select("bucket", F.col("value").alias("bid")), "bucket")
    return both.withColumn("spread", F.round(F.col("ask") - F.col("bid"), 9))


def overlay(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, agg, value, types in (("listings", "count", None, ["item_listed"]), ("bids", "count", None, ["item_received_bid"]), ("top_bid", "max", "price_eth", ["item_received_bid"]), ("sales", "count", None, ["item_sold"])):
        rows = _events(spark, d, *types)
        one = series(rows.filter("not isnan(price_eth)") if value else rows, "valid_ts", value, agg, "1d", START, END).select("bucket", F.col("value").alias(name))
        out = one if out is None else out.join(one, "bucket")
    return out


def grid_hour(spark: SparkSession, d: str) -> DataFrame:
    return bucket_grid(spark, START, END, "1h")


def grid_week(spark: SparkSession, d: str) -> DataFrame:
    return bucket_grid(spark, 1_700_000_000, 1_720_000_000, "1w")


def ranges(spark: SparkSession, d: str) -> DataFrame:
    now = 1_710_120_661.0  # the day of a clock change
    return spark.createDataFrame([(r, range_start(r, now)) for r in ("HTD", "DTD", "MTD", "YTD", "24h", "7d", "2w", "30m")], "name string, start double")


_E = f"FROM market_events WHERE collection = '{COLLECTION}' AND valid_ts >= {START} AND valid_ts < {END}"
_H = f"SELECT range AS bucket FROM range({START}, {END}, {{n}})"
_LOCAL = "CAST(epoch(timezone('America/Chicago', {x})) AS BIGINT)"
_DAYS = f"SELECT {_LOCAL.format(x='g')} AS bucket, {_LOCAL.format(x='g + INTERVAL 1 DAY')} AS bucket_end FROM range(TIMESTAMP '2024-01-31', TIMESTAMP '2024-03-02', INTERVAL 1 DAY) r(g) WHERE {_LOCAL.format(x='g')} < {END}"


def _sub_day(n: int, agg: str, cond: str) -> str:
    return f"WITH g AS ({_H.format(n=n)}), v AS (SELECT CAST(floor(valid_ts / {n}) AS BIGINT) * {n} AS bucket, {agg} AS value {_E} AND {cond} GROUP BY 1) SELECT g.bucket, value FROM g LEFT JOIN v USING (bucket)"


def _zoned(grid: str, agg: str, cond: str) -> str:
    return f"WITH g AS ({grid}), v AS (SELECT g.bucket, {agg} AS value FROM g JOIN (SELECT * {_E} AND {cond}) e ON valid_ts >= g.bucket AND valid_ts < g.bucket_end GROUP BY 1) SELECT g.bucket, value FROM g LEFT JOIN v USING (bucket)"


_PRICED = "price_eth IS NOT NULL AND NOT isnan(price_eth)"
_ASK = _sub_day(21_600, "min(price_eth)", f"event_type = 'item_listed' AND {_PRICED}")
_BID = _sub_day(21_600, "max(price_eth)", f"event_type = 'collection_offer' AND {_PRICED}")
_MONTHS = f"SELECT {_LOCAL.format(x='g')} AS bucket, {_LOCAL.format(x='g + INTERVAL 1 MONTH')} AS bucket_end FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH) r(g)"


def _change(expr: str) -> str:
    return f"WITH s AS ({_ASK}), b AS (SELECT *, first_value(value IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v0 FROM s) SELECT bucket, round({expr}, 9) AS value FROM b"


_GAPS = f"""
s AS (SELECT {duck_us("started_at")} AS s, {duck_us("ended_at")} AS t FROM gap_register WHERE coalesce(conn_label, 'a') = 'a'),
m AS (SELECT *, max(t) OVER (ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s WHERE t > s),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM m),
blind AS (SELECT min(s) / 1e6 AS f, max(t) / 1e6 AS t FROM i GROUP BY k)
"""
_N = f"event_type IN {PLACED}"

QUERIES = {
    "grid_hour": (grid_hour, f"SELECT range AS bucket, range + 3600 AS bucket_end FROM range({START}, {END}, 3600)"),
    "grid_week_local": (
        grid_week,
        f"SELECT {_LOCAL.format(x='g')} AS bucket, {_LOCAL.format(x='g + INTERVAL 7 DAY')} AS bucket_end FROM range(TIMESTAMP '2023-11-13', TIMESTAMP '2024-07-08', INTERVAL 7 DAY) r(g) WHERE {_LOCAL.format(x='g')} < 1720000000",
    ),
    "anchored_ranges": (
        ranges,
        "SELECT * FROM (VALUES ('HTD', 1710118800.0::DOUBLE), ('DTD', epoch(timezone('America/Chicago', TIMESTAMP '2024-03-10'))), ('MTD', epoch(timezone('America/Chicago', TIMESTAMP '2024-03-01'))),"
        " ('YTD', epoch(timezone('America/Chicago', TIMESTAMP '2024-01-01'))), ('24h', 1710034261.0), ('7d', 1709515861.0), ('2w', 1708911061.0), ('30m', 1710118861.0)) t(name, start)",
    ),
    "series_count_1h": (_metric("count", None, "1h", *PLACED), _sub_day(3_600, "count(*)", _N).replace("g.bucket, value FROM", "g.bucket, coalesce(value, 0) AS value FROM")),
    "series_max_1d": (_metric("max", "price_eth", "1d", "item_received_bid"), _zoned(_DAYS, "max(price_eth)", f"event_type = 'item_received_bid' AND {_PRICED}")),
    "series_min_1h": (_metric("min", "price_eth", "1h", "item_listed"), _sub_day(3_600, "min(price_eth)", f"event_type = 'item_listed' AND {_PRICED}")),
    "series_sum_1mo": (
        _metric("sum", "price_eth", "1mo", "item_sold"),
        _zoned(_MONTHS, "round(sum(price_eth), 9)", f"event_type = 'item_sold' AND {_PRICED}").replace("g.bucket, value FROM", "g.bucket, coalesce(value, 0) AS value FROM"),
    ),
    "series_median_1d": (_metric("median", "price_eth", "1d", "item_received_bid"), _zoned(_DAYS, "median(price_eth)", f"event_type = 'item_received_bid' AND {_PRICED}")),
    "series_gap_mask": (
        gap_mask,
        f"WITH {_GAPS}, g AS ({_H.format(n=3600)}), c AS (SELECT CAST(floor(valid_ts / 3600) AS BIGINT) * 3600 AS bucket, count(*) AS n {_E} GROUP BY 1),"
        f" l AS (SELECT g.bucket, round(sum(least(t, bucket + 3600, {END}) - greatest(f, bucket)), 3) AS s FROM g JOIN blind ON f < bucket + 3600 AND t > bucket GROUP BY 1)"
        " SELECT g.bucket, CASE WHEN coalesce(s, 0) <= 360 THEN coalesce(n, 0) END AS value, coalesce(s, 0.0)::DOUBLE AS blind_s FROM g LEFT JOIN c USING (bucket) LEFT JOIN l USING (bucket)",
    ),
    "series_transform_abs": (_transformed("ABS"), _change("value")),
    "series_transform_diff": (_transformed("DIFF"), _change("value - v0")),
    "series_transform_pct": (_transformed("PCT"), _change("CASE WHEN v0 <> 0 THEN value / v0 * 100 - 100 END")),
    "series_transform_bps": (_transformed("BPS"), _change("CASE WHEN v0 <> 0 THEN value / v0 * 10000 - 10000 END")),
    "series_transform_log": (_transformed("LOG"), _change("CASE WHEN v0 > 0 AND value > 0 THEN ln(value / v0) END")),
    "observed_spread": (observed_spread, f"SELECT bucket, a.value AS ask, b.value AS bid, round(a.value - b.value, 9) AS spread FROM ({_ASK}) a JOIN ({_BID}) b USING (bucket)"),
    "multi_overlay": (
        overlay,
        f"WITH g AS ({_DAYS}) SELECT g.bucket, count(*) FILTER (event_type = 'item_listed') AS listings, count(*) FILTER (event_type = 'item_received_bid') AS bids,"
        f" max(price_eth) FILTER (event_type = 'item_received_bid' AND NOT isnan(price_eth)) AS top_bid, count(*) FILTER (event_type = 'item_sold') AS sales"
        f" FROM g LEFT JOIN (SELECT * {_E}) e ON valid_ts >= g.bucket AND valid_ts < g.bucket_end GROUP BY 1",
    ),
}
