"""Time grids: bucket of an instant, full regular grids, series with explicit holes, transforms, ranges.

Buckets under a day are cut in UTC; days and longer follow the calendar of a
display zone (weeks begin on Mondays). All instants are epoch seconds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators.late import weighted_median

ZONE = "America/Chicago"
#: Buckets of a grid at most.
MAX_BUCKETS = 20_000
DAY = 86_400


@dataclass(frozen=True)
class Interval:
    """``n`` of a unit: second, month or year."""

    n: int
    unit: str = "second"


#: The interval names of a request.
INTERVALS = {
    "1m": Interval(60), "5m": Interval(300), "15m": Interval(900), "1h": Interval(3_600), "3h": Interval(10_800), "6h": Interval(21_600),
    "1d": Interval(DAY), "2d": Interval(2 * DAY), "1w": Interval(7 * DAY),
    "1mo": Interval(1, "month"), "2mo": Interval(2, "month"), "3mo": Interval(3, "month"), "6mo": Interval(6, "month"), "1y": Interval(1, "year"), "2y": Interval(2, "year"),
}


def _local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def _midnight(day: Column, zone: str) -> Column:
    return F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp"), zone))


def bucket_start(ts: Column, interval: str, zone: str = ZONE) -> Column:
    """Start of the bucket that holds ``ts``, as whole epoch seconds."""
    i = INTERVALS[interval]
    if i.unit == "second" and i.n < DAY:
        return (F.floor(ts / F.lit(i.n)) * i.n).cast("bigint")
    day = _local_day(ts, zone)
    if i.unit == "second":
        return _midnight(F.date_sub(day, F.pmod(F.datediff(day, F.lit("1970-01-05").cast("date")), F.lit(i.n // DAY))), zone)
    if i.unit == "month":
        month = ((F.month(day) - 1 - (F.month(day) - 1) % i.n) + 1).cast("int")
        return _midnight(F.make_date(F.year(day), month, F.lit(1)), zone)
    return _midnight(F.make_date((F.year(day) - F.year(day) % i.n).cast("int"), F.lit(1), F.lit(1)), zone)


def bucket_floor(ts: float, interval: str, zone: str = ZONE) -> int:
    """The same on the driver, for the bounds of a request."""
    i = INTERVALS[interval]
    if i.unit == "second" and i.n < DAY:
        return int(ts // i.n * i.n)
    local = datetime.fromtimestamp(ts, ZoneInfo(zone)).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    if i.unit == "second":
        local -= timedelta(days=(local - datetime(1970, 1, 5)).days % (i.n // DAY))
    elif i.unit == "month":
        local = local.replace(day=1, month=local.month - (local.month - 1) % i.n)
    else:
        local = local.replace(day=1, month=1, year=local.year - local.year % i.n)
    return int(local.replace(tzinfo=ZoneInfo(zone)).timestamp())


def bucket_grid(spark: SparkSession, start: float, end: float, interval: str, zone: str = ZONE) -> DataFrame:
    """Every bucket that meets [start, end): bucket, bucket_end. The first may begin before ``start``."""
    i = INTERVALS[interval]
    first = bucket_floor(start, interval, zone)
    step = {"second": i.n, "month": 28 * DAY * i.n, "year": 365 * DAY * i.n}[i.unit]
    if (end - first) / step > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets; choose a longer interval or a shorter range")
    if i.unit == "second" and i.n < DAY:
        at = spark.range(first, max(first, int(-(-end // 1))), i.n).select(F.col("id").alias("bucket"))
        return at.select("bucket", (F.col("bucket") + i.n).alias("bucket_end"))
    steps = int((end - first) // step) + 3
    day = _local_day(F.lit(first), zone)
    k = F.col("id").cast("int")
    starts = lambda k: F.date_add(day, k * F.lit(i.n // DAY)) if i.unit == "second" else F.add_months(day, k * F.lit(i.n * (12 if i.unit == "year" else 1)))
    grid = spark.range(steps).select(_midnight(starts(k), zone).alias("bucket"), _midnight(starts(k + 1), zone).alias("bucket_end"))
    return grid.filter(F.col("bucket") < end)


_RANGE = re.compile(r"^(\d+)([mhdw])$")


def range_start(text: str, now: float, zone: str = ZONE) -> float:
    """Start of a trailing (24h, 7d ...) or anchored (HTD, DTD, MTD, YTD) range that ends at ``now``."""
    if m := _RANGE.match(text):
        return now - int(m[1]) * {"m": 60, "h": 3_600, "d": DAY, "w": 7 * DAY}[m[2]]
    local = datetime.fromtimestamp(now, ZoneInfo(zone)).replace(minute=0, second=0, microsecond=0)
    if text == "HTD":
        return local.timestamp()
    if text in ("DTD", "MTD", "YTD"):
        cut = {"DTD": {}, "MTD": {"day": 1}, "YTD": {"day": 1, "month": 1}}[text]
        return local.replace(hour=0, **cut, fold=0).timestamp()
    raise ValueError(f"unknown range {text!r}")


def bucketed(df: DataFrame, ts: str, value: str | None, agg: str, interval: str, zone: str = ZONE, keys: tuple[str, ...] = ()) -> DataFrame:
    """One aggregate per (keys and) bucket: max, min, sum, count or median of ``value``."""
    rows = df.filter(F.col(ts).isNotNull()).select(*keys, bucket_start(F.col(ts), interval, zone).alias("bucket"), *([F.col(value).alias("v")] if value else []))
    by = [*keys, "bucket"]
    if agg == "median":  # by counts of values, so that no bucket is gathered in one task
        counts = rows.filter("v is not null and not isnan(v)").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
        return weighted_median(counts, by, "v", "n").withColumnRenamed("median", "value")
    fn = {"max": F.max, "min": F.min, "sum": F.sum}.get(agg)
    return rows.groupBy(*by).agg((F.count("v" if value else F.lit(1)) if agg == "count" else fn("v")).alias("value"))


def series(df: DataFrame, ts: str, value: str | None, agg: str, interval: str, start: float, end: float, zone: str = ZONE) -> DataFrame:
    """The aggregate on the full grid of [start, end): an empty bucket is 0 for count and sum, null otherwise."""
    inside = df.filter((F.col(ts) >= start) & (F.col(ts) < end))
    out = bucket_grid(df.sparkSession, start, end, interval, zone).join(bucketed(inside, ts, value, agg, interval, zone), "bucket", "left")
    return out.fillna(0, ["value"]) if agg in ("count", "sum") else out


def mask_gaps(points: DataFrame, blind: DataFrame, end: float, interval: str, share: float = 0.10, least: float = 60.0, zone: str = ZONE) -> DataFrame:
    """Null the buckets whose blind seconds exceed max(least, share of the observable time).

    ``blind`` holds disjoint periods (from, to) in epoch seconds. They meet the
    buckets by equality: each period is split over the buckets it touches.
    """
    i = INTERVALS[interval]
    if i.unit != "second" or i.n >= DAY:
        raise ValueError("gap masking works on intervals under a day")
    first, last = F.floor(F.col("from") / i.n), F.floor((F.col("to") - 1e-6) / i.n)
    pieces = blind.filter("to > from").select("from", "to", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("k"))
    bucket = (F.col("k") * i.n).alias("bucket")
    gone = F.least(F.col("to"), (F.col("k") + 1) * F.lit(float(i.n)), F.lit(float(end))) - F.greatest(F.col("from"), F.col("k") * F.lit(float(i.n)))
    lost = pieces.select(bucket, gone.alias("s")).groupBy("bucket").agg(F.round(F.sum(F.greatest(F.lit(0.0), "s")), 3).alias("blind_s"))
    seen = F.least(F.col("bucket_end"), F.lit(end)) - F.col("bucket")
    both = points.join(lost, "bucket", "left").fillna(0.0, ["blind_s"])
    return both.withColumn("value", F.when(F.col("blind_s") <= F.greatest(F.lit(least), F.lit(share) * seen), F.col("value")))


def transform(points: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """ABS, DIFF, PCT, BPS or LOG of ``value`` against the first value of the window; a grid is at most MAX_BUCKETS rows a key."""
    v, v0 = F.col("value"), F.first("value", ignorenulls=True).over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = {
        "ABS": v, "DIFF": v - v0, "PCT": F.try_divide(v, v0) * 100 - 100, "BPS": F.try_divide(v, v0) * 10_000 - 10_000,
        "LOG": F.when((v0 > 0) & (v > 0), F.ln(v / v0)),
    }[kind]
    return points.withColumn("value", out)
