"""Lives, standing books, spreads and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.lives import fold_lives, one_per_key, standing_at
from tidemark.operators.standing import live_intervals, segments, standing_series, standing_spread, time_weighted
from tidemark.session import table

START, END, NOW, DAY_MS = 1_706_745_600, 1_709_251_200, 1_709_251_200.0, 86_400_000


def lives(spark: SparkSession, d: str) -> DataFrame:
    return fold_lives(table(spark, d, "market_events"), NOW).drop("t_place_observed")


def dedup_lives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").select("order_hash", "dedup_key", "observed_ts", "run", "seq", "conn").filter("order_hash is not null")
    once = one_per_key(rows, "order_hash", "dedup_key", ["observed_ts", "run", "seq"])
    return once.groupBy("order_hash").agg(
        F.count(F.lit(1)).alias("kept"), (F.sum("__copies") - F.count(F.lit(1))).alias("merged"), F.count_if(F.col("dedup_key").isNull()).alias("undedupable"),
        F.sum("__a").alias("deliveries_a"), F.sum("__b").alias("deliveries_b"), F.sum("__uneven").cast("bigint").alias("disagreements"),
    )


def _intervals(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return live_intervals(table(spark, d, "order_lives").filter(F.col("event_type") == kind), "collection", START, END)


def standing_ask(spark: SparkSession, d: str) -> DataFrame:
    return standing_series(_intervals(spark, d, "item_listed"), "min", DAY_MS)


def standing_bid(spark: SparkSession, d: str) -> DataFrame:
    return standing_series(_intervals(spark, d, "collection_offer"), "max", DAY_MS)


def spread(spark: SparkSession, d: str) -> DataFrame:
    return standing_spread(_intervals(spark, d, "item_listed"), _intervals(spark, d, "collection_offer"), DAY_MS)


def spread_segments(spark: SparkSession, d: str) -> DataFrame:
    legs = {"ask": (_intervals(spark, d, "item_listed"), "min"), "bid": (_intervals(spark, d, "collection_offer"), "max")}
    return segments(legs, DAY_MS).filter("ask is not null or bid is not null")


def crossed_book(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("buckets"), F.sum("crossed").alias("crossed"), F.min("spread").alias("tightest"))


def trait_set_bid(spark: SparkSession, d: str) -> DataFrame:
    """The best bid of three kinds together, and which kinds hold it."""
    legs = {n: (_intervals(spark, d, k), "max") for n, k in (("item", "item_received_bid"), ("collection", "collection_offer"), ("trait", "trait_offer"))}
    segs = segments(legs, DAY_MS).withColumn("best", F.greatest(*legs)).filter("best is not null")
    winners = F.concat_ws("+", *[F.when(F.col(n) == F.col("best"), n) for n in legs])
    held = segs.groupBy("key", winners.alias("legs")).agg(F.sum(F.col("t1") - F.col("t0")).alias("held_ms"), F.max("best").alias("highest"))
    return held


def tw_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("w"))
    return time_weighted(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", F.col("w"), {"p10": 0.1, "median": 0.5, "p90": 0.9})


def standing_asof(spark: SparkSession, d: str) -> DataFrame:
    now = 1_708_000_000.0
    return standing_at(table(spark, d, "order_lives"), now).groupBy("collection", "event_type").agg(
        F.count(F.lit(1)).alias("standing"), F.sum(F.greatest(F.lit(1), F.coalesce("quantity", F.lit(1)))).alias("depth"),
        F.min(F.when(~F.isnan("price_eth"), F.col("price_eth"))).alias("lowest"), F.max(F.when(~F.isnan("price_eth"), F.col("price_eth"))).alias("highest"),
    )


def orphan_rate(spark: SparkSession, d: str) -> DataFrame:
    orphan = F.col("placement_seen") == 0
    return table(spark, d, "order_lives").groupBy("collection").agg(
        F.count(F.lit(1)).alias("lives"), F.count_if(orphan).alias("orphans"), F.try_divide(F.count_if(orphan) * 100.0, F.count(F.lit(1))).alias("pct")
    )


_ROWS = """
r AS (SELECT order_hash, dedup_key, observed_ts, run, seq, event_type, valid_ts, coalesce(conn, 'a') AS c, collection, token_id, maker, quantity, price_eth, expiration_ts FROM market_events
  WHERE order_hash IS NOT NULL AND event_type IN ('item_listed', 'item_received_bid', 'collection_offer', 'trait_offer', 'item_received_offer', 'item_cancelled', 'order_invalidate', 'item_sold', 'order_revalidate')),
k AS (SELECT order_hash, dedup_key, max(nc) <> min(nc) AS uneven FROM (SELECT order_hash, dedup_key, c, count(*) AS nc FROM r WHERE dedup_key IS NOT NULL GROUP BY ALL) GROUP BY ALL),
o AS (SELECT * FROM r QUALIFY dedup_key IS NULL OR row_number() OVER (PARTITION BY order_hash, dedup_key ORDER BY observed_ts, run, seq, valid_ts IS NULL, valid_ts) = 1)
"""
_PAY = "collection := collection, token_id := token_id, maker := maker, quantity := quantity, price_eth := price_eth, expiration_ts := expiration_ts"
LIVES_SQL = f"""
WITH {_ROWS},
pl AS (SELECT * FROM o WHERE event_type IN ('item_listed', 'item_received_bid', 'collection_offer', 'trait_offer', 'item_received_offer')
  QUALIFY row_number() OVER (PARTITION BY order_hash ORDER BY valid_ts NULLS LAST, seq, run) = 1),
rv AS (SELECT order_hash, max(valid_ts) AS t FROM o WHERE event_type = 'order_revalidate' GROUP BY 1),
te AS (SELECT o.*, pl.valid_ts AS tp, coalesce(o.event_type = 'order_invalidate' AND rv.t > o.valid_ts, false) AS sup
  FROM o LEFT JOIN pl USING (order_hash) LEFT JOIN rv USING (order_hash) WHERE o.event_type IN ('item_cancelled', 'order_invalidate', 'item_sold')),
ft AS (SELECT * FROM te WHERE valid_ts IS NOT NULL AND (tp IS NULL OR valid_ts >= tp) AND NOT sup QUALIFY row_number() OVER (PARTITION BY order_hash ORDER BY valid_ts, seq, run) = 1),
e0 AS (SELECT * FROM te QUALIFY row_number() OVER (PARTITION BY order_hash ORDER BY observed_ts, run, seq) = 1),
f0 AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY order_hash ORDER BY observed_ts, run, seq) = 1),
tn AS (SELECT order_hash, count(*) AS n, count(*) FILTER (dedup_key IS NULL) AS nk, bool_and(sup) AS allsup FROM te GROUP BY 1),
cn AS (SELECT order_hash, count(*) AS n, count(*) FILTER (c = 'a') AS a, count(*) FILTER (c <> 'a') AS b FROM r GROUP BY 1),
on_ AS (SELECT order_hash, count(*) AS n, max(CASE WHEN event_type = 'order_revalidate' THEN 1 ELSE 0 END) AS rev FROM o GROUP BY 1),
un AS (SELECT order_hash, count(*) FILTER (uneven) AS u FROM k GROUP BY 1),
s AS (SELECT f0.order_hash, CASE WHEN pl.order_hash IS NOT NULL THEN struct_pack(collection := pl.collection, token_id := pl.token_id, maker := pl.maker, quantity := pl.quantity, price_eth := pl.price_eth, expiration_ts := pl.expiration_ts)
   WHEN ft.order_hash IS NOT NULL THEN struct_pack(collection := ft.collection, token_id := ft.token_id, maker := ft.maker, quantity := ft.quantity, price_eth := ft.price_eth, expiration_ts := ft.expiration_ts)
   WHEN e0.order_hash IS NOT NULL THEN struct_pack(collection := e0.collection, token_id := e0.token_id, maker := e0.maker, quantity := e0.quantity, price_eth := e0.price_eth, expiration_ts := e0.expiration_ts)
   ELSE struct_pack(collection := f0.collection, token_id := f0.token_id, maker := f0.maker, quantity := f0.quantity, price_eth := f0.price_eth, expiration_ts := f0.expiration_ts) END AS x,
  pl.order_hash IS NOT NULL AS has_p, pl.event_type AS p_type, pl.valid_ts AS p_ts, pl.expiration_ts AS p_exp, ft.order_hash IS NOT NULL AS has_t, ft.event_type AS t_type, ft.valid_ts AS t_ts, e0.event_type AS e_type,
  coalesce(tn.n, 0) > 0 AND NOT coalesce(tn.allsup, false) AS unk, coalesce(tn.n, 0) AS tn, coalesce(tn.nk, 0) AS nk, cn.n - on_.n AS merged, cn.a, cn.b, on_.rev, coalesce(un.u, 0) AS u
  FROM f0 LEFT JOIN pl USING (order_hash) LEFT JOIN ft USING (order_hash) LEFT JOIN e0 USING (order_hash) LEFT JOIN tn USING (order_hash) JOIN cn USING (order_hash) JOIN on_ USING (order_hash) LEFT JOIN un USING (order_hash))
SELECT order_hash, x.collection AS collection, p_type AS event_type, x.token_id AS token_id, x.maker AS maker, x.quantity AS quantity, x.price_eth AS price_eth, p_ts AS t_place,
  CASE WHEN has_t THEN t_ts WHEN unk THEN NULL WHEN has_p AND p_exp < {NOW} THEN p_exp END AS t_term,
  CASE WHEN has_t THEN CASE t_type WHEN 'item_cancelled' THEN 'cancelled' WHEN 'order_invalidate' THEN 'invalidated' ELSE 'filled' END WHEN unk THEN 'unknown' WHEN has_p AND p_exp < {NOW} THEN 'expired' ELSE 'censored' END AS exit_reason,
  CASE WHEN has_t OR unk THEN 'observed' WHEN has_p AND p_exp < {NOW} THEN 'derived' END AS exit_source, CASE WHEN has_t THEN t_type WHEN unk THEN e_type END AS exit_event_type,
  x.expiration_ts AS expiration_ts, CAST(has_p AS INTEGER) AS placement_seen, rev AS revalidated, CAST(tn AS INTEGER) AS terminations_seen, CAST(nk AS INTEGER) AS terminations_undedupable,
  CAST(merged AS INTEGER) AS duplicates_merged, CAST(a AS INTEGER) AS deliveries_a, CAST(b AS INTEGER) AS deliveries_b, CAST(u AS INTEGER) AS multiplicity_disagreements FROM s
"""


def _iv(name: str, kind: str, extra: str = "") -> str:
    ms = "CAST(round({} * 1000) AS BIGINT)"
    return (
        f"{name}_i AS (SELECT collection AS key, order_hash AS id, {ms.format(f'greatest(t_place, {START})')} AS a, {ms.format(f'least(t_term, expiration_ts, {END})')} AS z, price_eth AS price FROM order_lives"
        f" WHERE event_type = '{kind}' AND placement_seen = 1 AND t_place IS NOT NULL AND exit_reason <> 'unknown' AND price_eth IS NOT NULL AND NOT isnan(price_eth) AND collection IS NOT NULL {extra}),"
        f"{name}_p AS (SELECT key, id, b * {DAY_MS} AS bucket, greatest(a, b * {DAY_MS}) AS a, least(z, (b + 1) * {DAY_MS}) AS z, price FROM (SELECT *, unnest(range(a // {DAY_MS}, (z - 1) // {DAY_MS} + 1)) AS b FROM {name}_i WHERE z > a))"
    )


def _segs(legs: dict[str, tuple[str, str]], extra: str = "") -> str:
    ivs = ",".join(_iv(n, k, extra) for n, (k, _) in legs.items())
    pts = " UNION ".join(f"SELECT key, bucket, unnest([bucket, bucket + {DAY_MS}, a, z]) AS t FROM {n}_p" for n in legs)
    vals = "".join(f", {n}_v AS (SELECT s.key, s.bucket, s.t0, {w}(price) AS {n} FROM sg s JOIN {n}_p p ON p.key = s.key AND p.bucket = s.bucket AND p.a <= s.t0 AND p.z > s.t0 GROUP BY ALL)" for n, (_, w) in legs.items())
    joins = " ".join(f"LEFT JOIN {n}_v USING (key, bucket, t0)" for n in legs)
    return f"{ivs}, pt AS ({pts}), sg AS (SELECT * FROM (SELECT key, bucket, t AS t0, lead(t) OVER (PARTITION BY key, bucket ORDER BY t) AS t1 FROM pt) WHERE t1 IS NOT NULL){vals}, seg AS (SELECT key, bucket, t0, t1, {', '.join(legs)} FROM sg {joins})"


def series_sql(kind: str, want: str, extra: str = "") -> str:
    return f"""WITH {_segs({"best": (kind, want)}, extra)},
w AS (SELECT key, bucket, best AS v, sum(t1 - t0) AS w FROM seg WHERE best IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY key, bucket ORDER BY v) AS cum, sum(w) OVER (PARTITION BY key, bucket) AS tot FROM w),
q AS (SELECT key, bucket, min(v) FILTER (cum >= 0.5 * tot) AS median, min(v) FILTER (cum >= 0.1 * tot - 1e-6) AS p10, min(v) FILTER (cum >= 0.9 * tot - 1e-6) AS p90, max(tot) AS tot FROM c GROUP BY ALL),
n AS (SELECT key, bucket, count(DISTINCT id) AS n FROM best_p GROUP BY ALL)
SELECT key, bucket // 1000 AS bucket, median, CASE WHEN n >= 30 THEN p10 END AS p10, CASE WHEN n >= 30 THEN p90 END AS p90, n, CAST(tot AS BIGINT) / 1000 AS live_s FROM q JOIN n USING (key, bucket)"""


_SPREAD = f"""WITH {_segs({"ask": ("item_listed", "min"), "bid": ("collection_offer", "max")})},
b AS (SELECT *, round(ask - bid, 9) AS spread FROM seg WHERE ask IS NOT NULL AND bid IS NOT NULL),
w AS (SELECT key, bucket, spread AS v, sum(t1 - t0) AS w FROM b GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY key, bucket ORDER BY v) AS cum, sum(w) OVER (PARTITION BY key, bucket) AS tot FROM w),
q AS (SELECT key, bucket, min(v) FILTER (cum >= 0.5 * tot) AS m, max(tot) AS tot FROM c GROUP BY ALL),
x AS (SELECT key, bucket, max(CASE WHEN ask < bid THEN 1 ELSE 0 END) AS crossed FROM b GROUP BY ALL),
r AS (SELECT key, bucket // 1000 AS bucket, CASE WHEN crossed = 0 THEN m END AS spread, crossed, CAST(tot AS BIGINT) / 1000 AS both_s FROM q JOIN x USING (key, bucket))
"""
_UNION = {"item": ("item_received_bid", "max"), "collection": ("collection_offer", "max"), "trait": ("trait_offer", "max")}

QUERIES = {
    "order_lives": (lives, LIVES_SQL),
    "dedup_lives": (
        dedup_lives,
        "WITH r AS (SELECT order_hash, dedup_key, coalesce(conn, 'a') AS c FROM market_events WHERE order_hash IS NOT NULL),"
        " k AS (SELECT order_hash, dedup_key, count(*) AS n, count(*) FILTER (c = 'a') AS a FROM r WHERE dedup_key IS NOT NULL GROUP BY ALL),"
        " u AS (SELECT order_hash, count(*) FILTER (x) AS u FROM (SELECT order_hash, dedup_key, min(n) <> max(n) AS x FROM (SELECT order_hash, dedup_key, c, count(*) AS n FROM r WHERE dedup_key IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY 1),"
        " t AS (SELECT order_hash, count(*) AS n, count(*) FILTER (dedup_key IS NULL) AS nk, count(*) FILTER (c = 'a') AS a, count(*) FILTER (c <> 'a') AS b FROM r GROUP BY 1),"
        " q AS (SELECT order_hash, count(*) AS n FROM k GROUP BY 1)"
        " SELECT order_hash, coalesce(q.n, 0) + nk AS kept, t.n - coalesce(q.n, 0) - nk AS merged, nk AS undedupable, a AS deliveries_a, b AS deliveries_b, coalesce(u, 0) AS disagreements FROM t LEFT JOIN q USING (order_hash) LEFT JOIN u USING (order_hash)",
    ),
    "standing_ask": (standing_ask, series_sql("item_listed", "min")),
    "standing_bid": (standing_bid, series_sql("collection_offer", "max")),
    "standing_spread": (spread, _SPREAD + "SELECT * FROM r"),
    "spread_segments": (
        spread_segments,
        f"WITH {_segs({'ask': ('item_listed', 'min'), 'bid': ('collection_offer', 'max')})} SELECT * FROM seg WHERE ask IS NOT NULL OR bid IS NOT NULL",
    ),
    "crossed_book": (crossed_book, _SPREAD + "SELECT key, count(*) AS buckets, CAST(sum(crossed) AS BIGINT) AS crossed, min(spread) AS tightest FROM r GROUP BY key"),
    "trait_set_bid": (
        trait_set_bid,
        f"WITH {_segs(_UNION)}, b AS (SELECT *, greatest(item, collection, trait) AS best FROM seg) SELECT key, concat_ws('+', CASE WHEN item = best THEN 'item' END, CASE WHEN collection = best THEN 'collection' END,"
        " CASE WHEN trait = best THEN 'trait' END) AS legs, CAST(sum(t1 - t0) AS BIGINT) AS held_ms, max(best) AS highest FROM b WHERE best IS NOT NULL GROUP BY ALL",
    ),
    "tw_quantile": (
        tw_quantile,
        "WITH w AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL),"
        " c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot FROM w)"
        " SELECT l_returnflag, l_linestatus, min(v) FILTER (cum >= 0.1 * tot - 1e-6) AS p10, min(v) FILTER (cum >= 0.5 * tot - 1e-6) AS median, min(v) FILTER (cum >= 0.9 * tot - 1e-6) AS p90, CAST(max(tot) AS BIGINT) AS weight FROM c GROUP BY ALL",
    ),
    "standing_asof": (
        standing_asof,
        "SELECT collection, event_type, count(*) AS standing, CAST(sum(greatest(1, coalesce(quantity, 1))) AS BIGINT) AS depth, min(price_eth) FILTER (NOT isnan(price_eth)) AS lowest, max(price_eth) FILTER (NOT isnan(price_eth)) AS highest"
        " FROM order_lives WHERE placement_seen = 1 AND t_place <= 1708000000 AND exit_reason <> 'unknown' AND (t_term IS NULL OR t_term > 1708000000) AND (expiration_ts IS NULL OR expiration_ts > 1708000000) GROUP BY ALL",
    ),
    "orphan_rate": (
        orphan_rate,
        "SELECT collection, count(*) AS lives, count(*) FILTER (placement_seen = 0) AS orphans, 100.0::DOUBLE * count(*) FILTER (placement_seen = 0) / count(*) AS pct FROM order_lives GROUP BY ALL",
    ),
}
