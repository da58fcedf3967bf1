"""Redundant streams, coverage, gaps, as-of lookups, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.times import duck_us, instant_us
from tidemark.operators.intervals import asof_join, covered_whole, silences, subtract
from tidemark.operators.spans import periods
from tidemark.session import cut, table
from tidemark.sources.envelopes import parse_envelopes, to_envelopes

NOW, WINDOW = 1_709_251_200.0, 20 * 86_400.0


def _duplicates(rows: DataFrame) -> DataFrame:
    """One row: how the two connections' keyed events relate."""
    side = F.when(F.coalesce("conn", F.lit("a")) == "a", "a").otherwise("b")
    keyed = rows.filter("dedup_key is not null").groupBy("dedup_key", side.alias("side")).agg(F.count(F.lit(1)).alias("c"))
    per = keyed.groupBy("dedup_key").agg(F.max((F.col("side") == "a").cast("int")).alias("a"), F.max((F.col("side") == "b").cast("int")).alias("b"), F.min("c").alias("mn"), F.max("c").alias("mx"))
    return per.agg(
        F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("mx") > 1).alias("repeat_delivery_keys"), F.count_if(F.expr("a = 1 and b = 1")).alias("both"),
        F.count_if(F.expr("a = 1 and b = 1 and mn <> mx")).alias("multiplicity_disagreements"), F.count_if(F.expr("a = 1 and b = 0")).alias("a_only"), F.count_if(F.expr("a = 0 and b = 1")).alias("b_only"),
    )


def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").filter(F.col("observed_ts") >= NOW - WINDOW)
    b = F.coalesce("conn", F.lit("a")) == "b"
    keyed = F.col("dedup_key").isNotNull()
    totals = rows.agg(F.count_if(~b & keyed).alias("a_keyable"), F.count_if(b & keyed).alias("b_keyable"), F.count_if(~b & ~keyed).alias("a_undedupable"), F.count_if(b & ~keyed).alias("b_undedupable"))
    return totals.join(F.broadcast(_duplicates(rows)))


def dedup_monitor(spark: SparkSession, d: str) -> DataFrame:
    c = dedup_counts(spark, d)
    share = F.try_divide("both", F.col("a_only") + F.col("both"))
    few = F.least("a_keyable", "b_keyable") < 200
    status = F.when(few, "ok").when(share < 0.5, "warn").when(F.col("multiplicity_disagreements") > 0, "warn").otherwise("ok")
    return c.select("both", "a_only", share.alias("fraction"), status.alias("status"))


def overlap(spark: SparkSession, d: str) -> DataFrame:
    """Keys seen by each connection per event type over their common window: union, common, and Jaccard share."""
    rows = table(spark, d, "market_events").filter("dedup_key is not null").select("event_type", "dedup_key", F.coalesce("conn", F.lit("a")).alias("c"), "observed_ts")
    window = rows.groupBy("c").agg(F.min("observed_ts").alias("lo"), F.max("observed_ts").alias("hi"))
    lo, hi = window.agg(F.max("lo")).scalar(), window.agg(F.min("hi")).scalar()
    # keys first seen before the common window belong to no side
    first = rows.groupBy("event_type", "dedup_key").agg(F.min("observed_ts").alias("at"), F.max((F.col("c") == "a").cast("int")).alias("a"), F.max((F.col("c") == "b").cast("int")).alias("b"))
    inside = first.filter((F.col("at") >= lo) & (F.col("at") <= hi))
    return inside.groupBy("event_type").agg(F.count(F.lit(1)).alias("either"), F.sum(F.col("a") * F.col("b")).alias("both"), F.avg((F.col("a") * F.col("b")).cast("double")).alias("jaccard"))


def undedupable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "market_events").filter("dedup_key is null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    return silences(table(spark, d, "market_events").withColumn("c", F.coalesce("conn", F.lit("a"))), ["c"], "observed_ts", 2_400.0)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gap_register").select(
        "id", F.coalesce("conn_label", F.lit("a")).alias("c"), "reason", instant_us(F.col("started_at")).alias("from"), instant_us(F.col("ended_at")).alias("to")
    ).filter("to > from")


def merge_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return periods(_spans(spark, d), "reason", "from", "to")[0]


def _files(spark: SparkSession, d: str) -> DataFrame:
    us = F.round(F.col("observed_ts") * 1e6).cast("bigint")
    return table(spark, d, "market_events").groupBy(F.coalesce("conn", F.lit("a")).alias("c"), "file").agg(F.min(us).alias("from"), F.max(us).alias("to"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """When each connection's files were open and it wasn't blind."""
    return subtract(_files(spark, d).select("c", "from", "to"), _spans(spark, d).select("c", "from", "to"), "c")


def covered(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of any other connection that a's effective coverage contains whole."""
    cover = coverage(spark, d).filter("c = 'a'")
    gaps = _spans(spark, d).filter("c <> 'a'").select("id", F.lit("a").alias("c"), "from", "to")
    return covered_whole(gaps, cover, "c").select("id", "from", "to")


def asof_offer(spark: SparkSession, d: str) -> DataFrame:
    """Each sale with the collection's latest offer at or before it."""
    rows = table(spark, d, "market_events").filter("not isnan(price_eth) and price_eth is not null")
    sold = rows.filter("event_type = 'item_sold'").select("run", "seq", "collection", "valid_ts", "price_eth")
    offers = rows.filter("event_type = 'collection_offer'").select("collection", F.col("valid_ts").alias("offer_ts"), F.col("price_eth").alias("offer"))
    return asof_join(sold, offers.withColumn("offered_at", F.col("offer_ts")), ["collection"], "valid_ts", "offer_ts", ["offered_at", "offer"])


def gap_days(spark: SparkSession, d: str) -> DataFrame:
    """How many gaps touch each UTC day; a gap of any length counts on all its days."""
    day = lambda c: F.to_date(F.timestamp_micros(c))
    spans = _spans(spark, d).select(day("from").alias("lo"), day("to").alias("hi"))
    # a gap adds one on its first day and takes one off behind its last; a row per day, so the window is bounded by the calendar
    change = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("n")), F.struct(F.date_add("hi", 1).alias("at"), F.lit(-1).alias("n"))))
    days = spans.select(change.alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n"))
    order = W.orderBy("at")
    steps = days.select("at", F.lead("at").over(order).alias("until"), F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("gaps")).filter("gaps > 0")
    return steps.select(F.explode(F.sequence("at", F.date_sub("until", 1))).alias("day"), "gaps")


def gap_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Which gaps another connection's coverage lets be marked, and which marks it no longer bears: id, label, change."""
    register = table(spark, d, "gap_register").select("id", F.coalesce("conn_label", F.lit("a")).alias("own"), "covered_by")
    cover = cut(coverage(spark, d))
    labels = [r[0] for r in cover.select("c").distinct().orderBy("c").limit(3).collect()]  # the recording connections, a and b
    spans = _spans(spark, d).select("id", "c", "from", "to")
    out = None
    for label in labels:
        others = spans.filter(F.col("c") != label).select("id", F.lit(label).alias("c"), "from", "to")
        held = covered_whole(others, cover.filter(F.col("c") == label), "c").select("id", F.lit(True).alias("held"))
        both = register.filter(F.col("own") != label).join(held, "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
        change = F.when(F.col("held") & F.col("covered_by").isNull(), "set").when(~F.col("held") & (F.col("covered_by") == label), "revoked")
        one = both.select("id", F.lit(label).alias("label"), change.alias("change")).filter("change is not null")
        out = one if out is None else out.unionByName(one)
    return out


def backfill_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Closed gaps that aren't backfilled but hold recoverable classes, and which of the placement classes those are."""
    rows = table(spark, d, "gap_register").filter("ended_at is not null and backfilled_at is null").filter(F.size("backfillable_classes") > 0)
    placed = F.array(*[F.lit(x) for x in ("item_listed", "item_received_bid", "collection_offer")])
    return rows.select("id", "run_id", F.size("backfillable_classes").alias("classes"), F.array_join(F.array_sort(F.array_intersect("backfillable_classes", placed)), ",").alias("placements"))


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events written as raw envelopes in both wire shapes and parsed again."""
    rows = table(spark, d, "market_events")
    return parse_envelopes(to_envelopes(rows)).select("run", "seq", "event_type", "collection", "maker", "taker", "price_wei", "quantity", "order_hash")


def json_scalar(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("highest"))


_G = f"g AS (SELECT id, coalesce(conn_label, 'a') AS c, reason, {duck_us('started_at')} AS s, {duck_us('ended_at')} AS t FROM gap_register), v AS (SELECT * FROM g WHERE t > s)"
_D = f"r AS (SELECT dedup_key, CASE WHEN coalesce(conn, 'a') = 'a' THEN 'a' ELSE 'b' END AS side FROM market_events WHERE observed_ts >= {NOW - WINDOW}), k AS (SELECT dedup_key, side, count(*) AS c FROM r WHERE dedup_key IS NOT NULL GROUP BY ALL), p AS (SELECT dedup_key, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b, min(c) AS mn, max(c) AS mx FROM k GROUP BY 1)"
_COUNTS = f"""WITH {_D} SELECT (SELECT count(*) FROM r WHERE side = 'a' AND dedup_key IS NOT NULL) AS a_keyable, (SELECT count(*) FROM r WHERE side = 'b' AND dedup_key IS NOT NULL) AS b_keyable,
 (SELECT count(*) FROM r WHERE side = 'a' AND dedup_key IS NULL) AS a_undedupable, (SELECT count(*) FROM r WHERE side = 'b' AND dedup_key IS NULL) AS b_undedupable,
 count(*) AS distinct_keys, count(*) FILTER (mx > 1) AS repeat_delivery_keys, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND b AND mn <> mx) AS multiplicity_disagreements, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM p"""
_EDGES = f"""{_G}, f AS (SELECT coalesce(conn, 'a') AS c, CAST(round(min(observed_ts) * 1e6) AS BIGINT) AS s, CAST(round(max(observed_ts) * 1e6) AS BIGINT) AS t FROM market_events GROUP BY coalesce(conn, 'a'), file),
e AS (SELECT c, s AS t, 1 AS x, 0 AS y FROM f WHERE t > s UNION ALL SELECT c, t, -1, 0 FROM f WHERE t > s UNION ALL SELECT c, s, 0, 1 FROM v UNION ALL SELECT c, t, 0, -1 FROM v),
a AS (SELECT c, t, sum(sum(x)) OVER w AS x, sum(sum(y)) OVER w AS y FROM e GROUP BY c, t WINDOW w AS (PARTITION BY c ORDER BY t)),
o AS (SELECT c, t, x > 0 AND y = 0 AS is_on, lead(t) OVER (PARTITION BY c ORDER BY t) AS n FROM a),
q AS (SELECT *, sum(CASE WHEN is_on AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t) AS k FROM (SELECT *, lag(is_on) OVER (PARTITION BY c ORDER BY t) AS was FROM o)),
cov AS (SELECT c, min(t) AS f, max(n) AS t FROM q WHERE is_on GROUP BY c, k)"""

QUERIES = {
    "dedup_counts": (dedup_counts, _COUNTS),
    "dedup_monitor": (
        dedup_monitor,
        f"WITH c AS ({_COUNTS}) SELECT \"both\", a_only, \"both\"::DOUBLE / (a_only + \"both\") AS fraction, CASE WHEN least(a_keyable, b_keyable) < 200 THEN 'ok' WHEN \"both\"::DOUBLE / (a_only + \"both\") < 0.5 THEN 'warn' WHEN multiplicity_disagreements > 0 THEN 'warn' ELSE 'ok' END AS status FROM c",
    ),
    "stream_overlap": (
        overlap,
        "WITH r AS (SELECT event_type, dedup_key, coalesce(conn, 'a') AS c, observed_ts FROM market_events WHERE dedup_key IS NOT NULL), w AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT c, min(observed_ts) AS lo, max(observed_ts) AS hi FROM r GROUP BY 1)),"
        " f AS (SELECT event_type, dedup_key, min(observed_ts) AS at_, bool_or(c = 'a') AND bool_or(c = 'b') AS x FROM r GROUP BY ALL)"
        " SELECT event_type, count(*) AS either, count(*) FILTER (x) AS both, count(*) FILTER (x)::DOUBLE / count(*) AS jaccard FROM f, w WHERE at_ >= lo AND at_ <= hi GROUP BY 1",
    ),
    "undedupable": (undedupable, "SELECT event_type, count(*) AS n FROM market_events WHERE dedup_key IS NULL GROUP BY 1"),
    "heartbeat_gaps": (
        heartbeat_gaps,
        "SELECT c, p AS \"from\", t AS \"to\" FROM (SELECT c, t, lag(t) OVER (PARTITION BY c ORDER BY t) AS p FROM (SELECT DISTINCT coalesce(conn, 'a') AS c, observed_ts AS t FROM market_events)) WHERE t - p > 2400",
    ),
    "interval_merge": (
        merge_by_reason,
        f"WITH {_G}, m AS (SELECT *, max(t) OVER (PARTITION BY reason ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v), i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY reason ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM m)"
        " SELECT reason, min(s) AS \"from\", max(t) AS \"to\" FROM i GROUP BY reason, k",
    ),
    "interval_subtract": (coverage, f"WITH {_EDGES} SELECT c, f AS \"from\", t AS \"to\" FROM cov"),
    "gap_covered_by": (covered, f"WITH {_EDGES} SELECT id, s AS \"from\", v.t AS \"to\" FROM v WHERE c <> 'a' AND EXISTS (SELECT 1 FROM cov WHERE cov.c = 'a' AND cov.f <= v.s AND cov.t >= v.t)"),
    "gap_annotations": (
        gap_annotations,
        f"WITH {_EDGES}, h AS (SELECT r.id, l.c AS label, r.covered_by, EXISTS (SELECT 1 FROM v, cov WHERE v.id = r.id AND cov.c = l.c AND cov.f <= v.s AND cov.t >= v.t) AS held"
        " FROM gap_register r, (SELECT DISTINCT c FROM cov) l WHERE coalesce(r.conn_label, 'a') <> l.c)"
        " SELECT id, label, CASE WHEN held AND covered_by IS NULL THEN 'set' WHEN NOT held AND covered_by = label THEN 'revoked' END AS change FROM h WHERE (held AND covered_by IS NULL) OR (NOT held AND covered_by = label)",
    ),
    "asof_offer": (
        asof_offer,
        "WITH p AS (SELECT * FROM market_events WHERE price_eth IS NOT NULL AND NOT isnan(price_eth)), s AS (SELECT run, seq, collection, valid_ts, price_eth FROM p WHERE event_type = 'item_sold'),"
        " o AS (SELECT collection, valid_ts AS offered_at, max(price_eth) AS offer FROM p WHERE event_type = 'collection_offer' AND collection IS NOT NULL AND valid_ts IS NOT NULL GROUP BY ALL)"
        " SELECT s.run, s.seq, s.collection, s.valid_ts, s.price_eth, o.offered_at, o.offer FROM s ASOF LEFT JOIN o ON s.collection = o.collection AND s.valid_ts >= o.offered_at",
    ),
    "gap_days": (gap_days, f"WITH {_G} SELECT CAST(unnest(range(date_trunc('day', make_timestamp(s)), date_trunc('day', make_timestamp(t)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day, count(*) AS gaps FROM v GROUP BY 1"),
    "backfill_worklist": (
        backfill_worklist,
        "SELECT id, run_id, CAST(len(backfillable_classes) AS INTEGER) AS classes, array_to_string(list_sort(list_filter(list_distinct(backfillable_classes), lambda x: x IN ('item_listed', 'item_received_bid', 'collection_offer'))), ',') AS placements"
        " FROM gap_register WHERE ended_at IS NOT NULL AND backfilled_at IS NULL AND len(backfillable_classes) > 0",
    ),
    "parse_envelope": (envelopes, "SELECT run, seq, event_type, collection, maker, taker, price_wei, quantity, order_hash FROM market_events"),
    "json_scalar": (json_scalar, "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS highest FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"),
}
