"""Survival of orders: observations, episodes, curves, tables, histograms, drill lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.ordered import running_total
from tidemark.operators.survival import CAUSES, bootstrap_band, downsample, duration_histogram, episodes, excluded, km_curve, observations, quantiles, rmst
from tidemark.session import table

START, END, AS_OF, EPS, TAU = 1_707_000_000.0, 1_708_500_000.0, 1_708_600_000.0, 60.0, 3_600.0


def obs(spark: SparkSession, d: str) -> DataFrame:
    return observations(table(spark, d, "order_lives").filter("event_type is not null"), START, END, AS_OF)


def counted(spark: SparkSession, d: str) -> DataFrame:
    return excluded(table(spark, d, "order_lives").filter("event_type is not null"), START, END, AS_OF, "event_type")


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return episodes(obs(spark, d), EPS).select("order_hash", "maker", "scope_kind", "token_id", "episode")


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return km_curve(obs(spark, d), ["event_type"])


def curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("event_type", "t", "at_risk", "d", *[F.round(c, 8).alias(c) for c in ("s", "v", "lower", "upper")])


def cif(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("event_type", "t", *[F.round(f"cif_{c}", 8).alias(f"cif_{c}") for c in CAUSES])


def restricted_mean(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    return rmst(km_curve(o, ["event_type"]), o, ["event_type"], TAU).withColumn("rmst", F.round("rmst", 5))


def km_quantiles(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).withColumn("m", F.coalesce("maker", F.lit("")))
    return quantiles(km_curve(o, ["event_type"]), o, ["event_type"], ["m"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def thinned(spark: SparkSession, d: str) -> DataFrame:
    return downsample(_curve(spark, d), ["event_type"], 100).select("event_type", "t", "at_risk", "d")


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return duration_histogram(obs(spark, d), ["event_type"])


def minimap(spark: SparkSession, d: str) -> DataFrame:
    bars = 240
    slot = F.least(F.floor((F.col("t_place") - START) / ((END - START) / bars)), F.lit(bars - 1)).cast("int")
    counts = obs(spark, d).groupBy(slot.alias("bar")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(bars).select(F.col("id").cast("int").alias("bar")).join(counts, "bar", "left").fillna(0)


def drill(spark: SparkSession, d: str) -> DataFrame:
    """One page of the observations of a duration bin, longest first."""
    o = obs(spark, d).filter("event_type = 'item_listed' and duration >= 60 and duration < 86400")
    return o.orderBy(F.desc("duration"), "order_hash").offset(20).limit(20).select("order_hash", "duration", "cause")


def lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """Lifetimes of ended bids per collection, by sample percentiles at index min(n - 1, int(p * n)), refused under 30."""
    o = obs(spark, d).filter("event_type = 'item_received_bid'")
    counts = o.filter("ended").groupBy("collection", "duration").agg(F.count(F.lit(1)).alias("c")).filter("collection is not null")
    ranked = running_total(counts, ["collection"], ["duration"], "c", "upto").join(counts.groupBy("collection").agg(F.sum("c").alias("n")), "collection")
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("duration")))
    q = ranked.groupBy("collection").agg(F.max("n").alias("n_ended"), *[at(p).alias(k) for k, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])
    per = o.filter("collection is not null").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ended")).alias("censored"))
    return per.join(q, "collection", "left").select("collection", "n", "censored", *[F.when(F.col("n_ended") >= 30, F.col(c)).alias(c) for c in ("p10", "p50", "p90")])


def band(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap_band(obs(spark, d), ["event_type"], ["maker"], [10.0, 60.0, 300.0, 1_800.0, 7_200.0, 43_200.0, 86_400.0, 604_800.0])


_OBS = f"""o AS (SELECT order_hash, collection, event_type, scope_kind, token_id, maker, CASE WHEN NOT isnan(price_eth) THEN price_eth END AS price_eth, t_place, e AS ended, CASE WHEN e THEN exit_reason END AS cause, round(CASE WHEN e THEN t_term ELSE {AS_OF} END - t_place, 3) AS duration
 FROM (SELECT *, coalesce(exit_reason IN {CAUSES} AND t_term <= {AS_OF}, false) AS e FROM order_lives WHERE event_type IS NOT NULL AND placement_seen = 1 AND t_place >= {START} AND t_place < {END} AND t_place <= {AS_OF} AND exit_reason <> 'unknown'))"""
_KM = f"""WITH {_OBS}, c AS (SELECT event_type, duration AS t, count(*) AS c, count(*) FILTER (ended) AS d, {", ".join(f"count(*) FILTER (cause = '{c}') AS d_{c}" for c in CAUSES)} FROM o GROUP BY ALL),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY event_type ORDER BY t DESC) AS BIGINT) AS n FROM c),
e AS (SELECT * FROM r WHERE d > 0),
s AS (SELECT *, product(1 - d / n) OVER w AS s, sum(CASE WHEN n > d THEN d / (n * (n - d)) ELSE 0 END) OVER w AS v, max(CASE WHEN n <= d THEN 1 ELSE 0 END) OVER w AS over FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t)),
b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY event_type ORDER BY t), 1.0) AS sp FROM s),
k AS (SELECT *, {", ".join(f"sum(sp * d_{c} / n) OVER (PARTITION BY event_type ORDER BY t) AS cif_{c}" for c in CAUSES)} FROM b)
"""
_BAND = "CASE WHEN over = 0 AND s > 0 AND s < 1 THEN round(pow(s, exp({}1.959963984540054 * sqrt(v) / abs(ln(s)))), 8) END"

QUERIES = {
    "survival_obs": (obs, f"WITH {_OBS} SELECT * FROM o"),
    "survival_counts": (
        counted,
        f"SELECT event_type, count(*) AS selected, count(*) FILTER (t_place > {AS_OF}) AS placed_after_as_of, count(*) FILTER (t_place <= {AS_OF} AND exit_reason = 'unknown') AS unknown_terminator,"
        f" count(*) FILTER (t_place <= {AS_OF} AND exit_reason IN {CAUSES} AND t_term <= {AS_OF}) AS ended, count(*) FILTER (t_place <= {AS_OF} AND exit_reason IN {CAUSES} AND t_term > {AS_OF}) AS ended_after_as_of"
        f" FROM order_lives WHERE event_type IS NOT NULL AND placement_seen = 1 AND t_place >= {START} AND t_place < {END} GROUP BY 1",
    ),
    "episodes": (
        clustered,
        f"WITH {_OBS}, g AS (SELECT *, t_place - lag(t_place) OVER w AS gap FROM o WINDOW w AS (PARTITION BY maker, coalesce(scope_kind, ''), coalesce(token_id, '') ORDER BY t_place, order_hash))"
        f" SELECT order_hash, maker, scope_kind, token_id, CASE WHEN maker IS NULL THEN 0 ELSE CAST(sum(CASE WHEN gap IS NULL OR gap >= {EPS} THEN 1 ELSE 0 END) OVER (PARTITION BY maker, coalesce(scope_kind, ''), coalesce(token_id, '') ORDER BY t_place, order_hash ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS episode FROM g",
    ),
    "km_curve": (curve, _KM + f"SELECT event_type, t, n AS at_risk, d, round(s, 8) AS s, round(v, 8) AS v, {_BAND.format('')} AS lower, {_BAND.format('-')} AS upper FROM k"),
    "cif": (cif, _KM + f"SELECT event_type, t, {', '.join(f'round(cif_{c}, 8) AS cif_{c}' for c in CAUSES)} FROM k"),
    "rmst": (
        restricted_mean,
        _KM + f", p AS (SELECT event_type, t, s, least(coalesce(lead(t) OVER (PARTITION BY event_type ORDER BY t), {TAU}), {TAU}) AS nx, sp, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i FROM k WHERE t <= {TAU}),"
        f" a AS (SELECT event_type, sum(s * (nx - t)) + max(CASE WHEN i = 1 THEN t END) AS area FROM p GROUP BY 1), m AS (SELECT event_type, max(duration) AS mx FROM o GROUP BY 1)"
        f" SELECT event_type, CASE WHEN mx >= {TAU} THEN round(coalesce(area, {TAU}), 5) END AS rmst FROM m LEFT JOIN a USING (event_type)",
    ),
    "km_quantiles": (
        km_quantiles,
        _KM + ", n AS (SELECT event_type, count(DISTINCT coalesce(maker, '')) AS clusters FROM o GROUP BY 1)"
        + " SELECT n.event_type, any_value(clusters) AS clusters, " + ", ".join(f"CASE WHEN any_value(clusters) >= 30 THEN min(t) FILTER (s <= {1 - q} + 1e-12) END AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM n LEFT JOIN k USING (event_type) GROUP BY 1",
    ),
    "km_downsample": (
        thinned,
        _KM + ", sp_ AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM k WHERE t > 0 GROUP BY 1), z AS (SELECT k.event_type, t, n, d, CASE WHEN t <= lo OR hi <= lo THEN 0 ELSE ceil((ln(t) - ln(lo)) / ((ln(hi) - ln(lo)) / 99) - 1e-9) END AS slot FROM k JOIN sp_ USING (event_type))"
        " SELECT event_type, t, n AS at_risk, d FROM z QUALIFY row_number() OVER (PARTITION BY event_type, slot ORDER BY t) = 1",
    ),
    "lifetime_histogram": (
        histogram,
        f"WITH {_OBS}, s AS (SELECT event_type, ln(min(greatest(duration, 0.001))) AS lo, ln(max(greatest(duration, 0.001))) AS hi FROM o GROUP BY 1)"
        " SELECT event_type, CAST(CASE WHEN hi > lo THEN least(floor((ln(greatest(duration, 0.001)) - lo) / ((hi - lo) / 40) + 1e-9), 39) ELSE 0 END AS INTEGER) AS bin, "
        + ", ".join(f"count(*) FILTER (coalesce(cause, 'censored') = '{c}') AS {c}" for c in (*CAUSES, "censored")) + " FROM o JOIN s USING (event_type) GROUP BY 1, 2",
    ),
    "placement_minimap": (
        minimap,
        f"WITH {_OBS}, c AS (SELECT CAST(least(floor((t_place - {START}) / {(END - START) / 240}), 239) AS INTEGER) AS bar, count(*) AS n FROM o GROUP BY 1) SELECT CAST(range AS INTEGER) AS bar, coalesce(n, 0) AS n FROM range(240) LEFT JOIN c ON bar = range",
    ),
    "survival_drill": (drill, f"WITH {_OBS} SELECT order_hash, duration, cause FROM o WHERE event_type = 'item_listed' AND duration >= 60 AND duration < 86400 ORDER BY duration DESC, order_hash LIMIT 20 OFFSET 20"),
    "bid_lifetimes": (
        lifetimes,
        f"WITH {_OBS}, b AS (SELECT * FROM o WHERE event_type = 'item_received_bid' AND collection IS NOT NULL), l AS (SELECT collection, list_sort(list(duration)) AS x FROM b WHERE ended GROUP BY 1), n AS (SELECT collection, count(*) AS n, count(*) FILTER (NOT ended) AS censored FROM b GROUP BY 1)"
        " SELECT collection, n, censored, " + ", ".join(f"CASE WHEN len(x) >= 30 THEN x[CAST(least(len(x) - 1, floor(len(x) * {p}::DOUBLE)) AS INTEGER) + 1] END AS {k}" for k, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))) + " FROM n LEFT JOIN l USING (collection)",
    ),
    "bootstrap_band": (band, None),
}
