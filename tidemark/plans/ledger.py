"""Ledger pages, tape, live book, event mix, makers, wallets, counterparties, hourly rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators.late import first_copies
from tidemark.operators.ledger import Listing, capped_count, where
from tidemark.operators.lives import standing_at
from tidemark.operators.rollup import from_rollup, hourly
from tidemark.operators.skew import skew_aggregate
from tidemark.session import table

COLUMNS = ["event_type", "collection", "token_id", "maker", "taker", "price_eth", "valid_ts", "order_hash"]
NOW, START, END = 1_708_000_000.0, 1_706_749_200, 1_708_000_000
FILTERS = {"collection": "cobalt-keepers", "start": float(START), "types": ["item_listed", "item_received_bid", "item_sold"]}


def _messages(spark: SparkSession, d: str, collection: str | None = None) -> DataFrame:
    rows = table(spark, d, "market_events")
    if collection:
        rows = rows.filter(F.col("collection") == collection)
    return first_copies(rows.filter("run is not null and seq is not null"), ["run", "seq"], "observed_ts", COLUMNS)


def _priced(rows: DataFrame) -> DataFrame:
    return rows.withColumn("price_eth", F.when(~F.isnan("price_eth"), F.col("price_eth")))


def _listing(spark: SparkSession, d: str, descending: bool, filters: dict) -> Listing:
    return Listing(_priced(_messages(spark, d, "cobalt-keepers")), "price_eth", descending, filters)


def page_1(spark: SparkSession, d: str) -> DataFrame:
    lives = table(spark, d, "order_lives").select("order_hash", "exit_reason", "t_term")
    shown = _listing(spark, d, True, FILTERS).page(200)
    return shown.join(lives, "order_hash", "left").withColumn("lag_s", F.round(F.col("observed_ts") - F.col("valid_ts"), 6)).select("run", "seq", "event_type", "price_eth", "valid_ts", "exit_reason", "t_term", "lag_s")


def page_2(spark: SparkSession, d: str) -> DataFrame:
    listing = _listing(spark, d, True, FILTERS)
    return listing.page(100, listing.mark(listing.page(100))).select("run", "seq", "event_type", "price_eth", "valid_ts")


def nulls_asc(spark: SparkSession, d: str) -> DataFrame:
    listing = _listing(spark, d, False, {"collection": "cobalt-keepers"})
    return listing.page(300, listing.mark(listing.page(300))).select("run", "seq", "price_eth")


def by_token(spark: SparkSession, d: str) -> DataFrame:
    """The second page by token number of the rows in a range of numbers."""
    rows = _priced(_messages(spark, d, "ember-beetles"))
    listing = Listing(rows, "token_num", False, {"collection": "ember-beetles", "tokens": (1, 900)})
    return listing.page(200, listing.mark(listing.page(200))).select("run", "seq", "token_id", "token_num")


def count(spark: SparkSession, d: str) -> DataFrame:
    return capped_count(table(spark, d, "market_events").filter(where(start=START, has_price=True)), 5_000)


def chart(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d, "ember-beetles").filter(where(has_price=True)).filter("valid_ts is not null")
    newest = rows.orderBy(F.desc("valid_ts"), F.desc("run"), F.desc("seq")).limit(500)
    points = F.transform(F.array_sort(F.collect_list(F.struct("valid_ts", "price_eth"))), lambda x: F.format_string("%.3f:%.6f", x["valid_ts"], x["price_eth"]))
    return newest.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(points, ",")).alias("points"))


def tape(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d, "ember-beetles").filter("event_type = 'item_sold' and valid_ts is not null")
    return rows.orderBy(F.desc("valid_ts"), F.desc("run"), F.desc("seq")).limit(50).select("run", "seq", "valid_ts", "price_eth", "maker", "taker")


def _book(kind: str, descending: bool):
    """The 25 best standing orders of a kind in every collection, with the depth of its whole book."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        live = standing_at(table(spark, d, "order_lives"), NOW).filter((F.col("event_type") == kind) & F.col("collection").isNotNull() & F.col("price_eth").isNotNull() & ~F.isnan("price_eth"))
        best = W.partitionBy("collection").orderBy(F.desc("price_eth") if descending else F.asc("price_eth"), "order_hash")
        top = live.select("collection", "order_hash", "price_eth", "token_id", "quantity", F.row_number().over(best).alias("place")).filter("place <= 25")
        depth = live.groupBy("collection").agg(F.sum(F.greatest(F.lit(1), F.coalesce("quantity", F.lit(1)))).alias("depth"))
        return top.join(depth, "collection")

    return run


def event_mix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").filter(where(start=START, end=END))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("of", total).withColumn("pct", F.try_divide(F.col("n") * 100.0, F.col("of")))


def _wallet_base(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").filter("maker is not null").select("maker", "event_type", "collection", "token_id", "valid_ts", "price_eth")
    flag = lambda *t: F.col("event_type").isin(*t).cast("int")
    return rows.select(
        "maker", flag("item_listed").alias("listed"), flag("item_received_bid", "collection_offer", "trait_offer").alias("bid"), flag("item_cancelled").alias("cancelled"), flag("item_sold").alias("sold"), "valid_ts",
        F.when((F.col("event_type") == "item_sold") & ~F.isnan("price_eth"), F.col("price_eth")).alias("sale"),
    )


_SUMS = [("events", "rows", None), *[(c, "sum", c) for c in ("listed", "bid", "cancelled", "sold")], ("first_ts", "min", "valid_ts"), ("last_ts", "max", "valid_ts"), ("dearest", "max", "sale")]


def makers_top(spark: SparkSession, d: str) -> DataFrame:
    out = skew_aggregate(_wallet_base(spark, d), ["maker"], _SUMS)
    return out.orderBy(F.desc("events"), "maker").limit(40).select("maker", "events", "listed", "bid", "cancelled", "sold")


def wallets_ranked(spark: SparkSession, d: str) -> DataFrame:
    out = skew_aggregate(_wallet_base(spark, d), ["maker"], _SUMS).filter("events >= 5")
    total = table(spark, d, "market_events").filter("maker is not null").agg(F.count(F.lit(1))).scalar()
    return out.withColumn("of", total).select("maker", "events", "first_ts", "last_ts", F.try_divide(F.col("events") * 100.0, "of").alias("pct"), F.try_divide(F.col("cancelled") * 100.0, F.col("listed") + F.col("bid")).alias("cancel_pct"))


def wallet_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every maker's card: sums, distinct collections and tokens, counterparties."""
    sums = skew_aggregate(_wallet_base(spark, d), ["maker"], _SUMS)
    rows = table(spark, d, "market_events").filter("maker is not null")
    # distinct counts in two steps, so that no maker's values are gathered in one task
    distinct = lambda c: rows.filter(F.col(c).isNotNull()).select("maker", *(["collection", c] if c == "token_id" else [c])).distinct().groupBy("maker").agg(F.count(F.lit(1)).alias(f"{c}s"))
    out = sums
    for c in ("collection", "token_id", "taker"):
        out = out.join(distinct(c), "maker", "left")
    return out.fillna(0, ["collections", "token_ids", "takers"])


def counterparties(spark: SparkSession, d: str) -> DataFrame:
    """Who traded with whom, whichever side each was on."""
    sold = table(spark, d, "market_events").filter("event_type = 'item_sold' and maker is not null and taker is not null")
    value = F.when(~F.isnan("price_eth"), F.col("price_eth"))
    sides = sold.select(F.col("maker").alias("address"), F.col("taker").alias("other"), F.lit(1).alias("as_seller"), value.alias("v")).unionByName(
        sold.select(F.col("taker").alias("address"), F.col("maker").alias("other"), F.lit(0).alias("as_seller"), value.alias("v"))
    )
    return sides.groupBy("address", "other").agg(F.count(F.lit(1)).alias("trades"), F.sum("as_seller").alias("as_seller"), F.max("v").alias("dearest"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Trades among the 12 busiest addresses, every pair of them listed (144 rows at most)."""
    sold = table(spark, d, "market_events").filter("event_type = 'item_sold' and maker is not null and taker is not null").select("maker", "taker")
    pairs = sold.groupBy("maker", "taker").agg(F.count(F.lit(1)).alias("n"))
    busy = sold.select(F.col("maker").alias("a")).unionByName(sold.select(F.col("taker").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a").limit(12).select("a")
    names = [r[0] for r in busy.collect()]  # 12 at most
    cells = spark.createDataFrame([(a, b) for a in names for b in names], "maker string, taker string")
    return F.broadcast(cells).join(pairs, ["maker", "taker"], "left").fillna(0)


def rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").select("collection", "maker", "event_type", "valid_ts")
    return from_rollup(hourly(rows), rows, 1_706_800_123.5, 1_707_900_456.25)


_M = "m AS (SELECT run, seq, observed_ts, event_type, collection, token_id, maker, taker, price_eth, valid_ts, order_hash FROM market_events QUALIFY row_number() OVER (PARTITION BY run, seq ORDER BY observed_ts, collection NULLS FIRST, token_id NULLS FIRST, maker NULLS FIRST, taker NULLS FIRST, price_eth NULLS FIRST, valid_ts NULLS FIRST) = 1)"
_P = f"{_M}, p AS (SELECT * REPLACE (CASE WHEN NOT isnan(price_eth) THEN price_eth END AS price_eth) FROM m WHERE collection = 'cobalt-keepers')"
_F = f"valid_ts >= {START} AND event_type IN ('item_listed', 'item_received_bid', 'item_sold')"
_LIVE = f"placement_seen = 1 AND t_place <= {NOW} AND exit_reason <> 'unknown' AND (t_term IS NULL OR t_term > {NOW}) AND (expiration_ts IS NULL OR expiration_ts > {NOW}) AND price_eth IS NOT NULL AND NOT isnan(price_eth)"
_W = "w AS (SELECT maker, count(*) AS events, count(*) FILTER (event_type = 'item_listed') AS listed, count(*) FILTER (event_type IN ('item_received_bid', 'collection_offer', 'trait_offer')) AS bid, count(*) FILTER (event_type = 'item_cancelled') AS cancelled, count(*) FILTER (event_type = 'item_sold') AS sold, min(valid_ts) AS first_ts, max(valid_ts) AS last_ts, max(price_eth) FILTER (event_type = 'item_sold' AND NOT isnan(price_eth)) AS dearest FROM market_events WHERE maker IS NOT NULL GROUP BY maker)"
_SOLD = "s AS (SELECT maker, taker, CASE WHEN NOT isnan(price_eth) THEN price_eth END AS v FROM market_events WHERE event_type = 'item_sold' AND maker IS NOT NULL AND taker IS NOT NULL)"


def _book_sql(kind: str, way: str) -> str:
    return (
        f"WITH l AS (SELECT * FROM order_lives WHERE {_LIVE} AND event_type = '{kind}' AND collection IS NOT NULL) SELECT collection, order_hash, price_eth, token_id, quantity,"
        f" CAST(row_number() OVER (PARTITION BY collection ORDER BY price_eth {way}, order_hash) AS INTEGER) AS place, CAST(sum(greatest(1, coalesce(quantity, 1))) OVER (PARTITION BY collection) AS BIGINT) AS depth FROM l QUALIFY place <= 25"
    )


QUERIES = {
    "ledger_page_1": (
        page_1,
        f"WITH {_P}, g AS (SELECT * FROM p WHERE {_F} ORDER BY price_eth DESC NULLS LAST, run DESC, seq DESC LIMIT 200) SELECT run, seq, g.event_type, g.price_eth, valid_ts, exit_reason, t_term, round(observed_ts - valid_ts, 6) AS lag_s FROM g LEFT JOIN order_lives l USING (order_hash)",
    ),
    "ledger_page_2": (page_2, f"WITH {_P} SELECT run, seq, event_type, price_eth, valid_ts FROM p WHERE {_F} ORDER BY price_eth DESC NULLS LAST, run DESC, seq DESC LIMIT 100 OFFSET 100"),
    "ledger_nulls_asc": (nulls_asc, f"WITH {_P} SELECT run, seq, price_eth FROM p ORDER BY price_eth ASC NULLS FIRST, run, seq LIMIT 300 OFFSET 300"),
    "ledger_tokens": (
        by_token,
        f"WITH {_M}, t AS (SELECT run, seq, token_id, CASE WHEN CAST(TRY_CAST(token_id AS BIGINT) AS VARCHAR) = token_id THEN TRY_CAST(token_id AS BIGINT) END AS token_num FROM m WHERE collection = 'ember-beetles')"
        " SELECT * FROM t WHERE token_num BETWEEN 1 AND 900 ORDER BY token_num, run, seq LIMIT 200 OFFSET 200",
    ),
    "ledger_count": (count, f"SELECT least(count(*), 5000) AS n, count(*) <= 5000 AS exact FROM market_events WHERE valid_ts >= {START} AND price_eth IS NOT NULL AND NOT isnan(price_eth)"),
    "ledger_chart": (
        chart,
        f"WITH {_M}, n AS (SELECT * FROM m WHERE collection = 'ember-beetles' AND price_eth IS NOT NULL AND NOT isnan(price_eth) AND valid_ts IS NOT NULL ORDER BY valid_ts DESC, run DESC, seq DESC LIMIT 500)"
        " SELECT event_type, count(*) AS n, md5(string_agg(printf('%.3f', valid_ts) || ':' || printf('%.6f', price_eth), ',' ORDER BY valid_ts, price_eth)) AS points FROM n GROUP BY 1",
    ),
    "tape": (tape, f"WITH {_M} SELECT run, seq, valid_ts, price_eth, maker, taker FROM m WHERE collection = 'ember-beetles' AND event_type = 'item_sold' AND valid_ts IS NOT NULL ORDER BY valid_ts DESC, run DESC, seq DESC LIMIT 50"),
    "live_book_asks": (_book("item_listed", False), _book_sql("item_listed", "ASC")),
    "live_book_bids": (_book("item_received_bid", True), _book_sql("item_received_bid", "DESC")),
    "live_book_offers": (_book("collection_offer", True), _book_sql("collection_offer", "DESC")),
    "event_mix": (event_mix, f"WITH r AS (SELECT * FROM market_events WHERE valid_ts >= {START} AND valid_ts < {END}), n AS (SELECT event_type, count(*) AS n FROM r GROUP BY 1) SELECT event_type, n, (SELECT count(*) FROM r) AS of, 100.0::DOUBLE * n / (SELECT count(*) FROM r) AS pct FROM n"),
    "makers_top": (makers_top, f"WITH {_W} SELECT maker, events, listed, bid, cancelled, sold FROM w ORDER BY events DESC, maker LIMIT 40"),
    "wallets_ranked": (
        wallets_ranked,
        f"WITH {_W}, t AS (SELECT CAST(sum(events) AS BIGINT) AS of FROM w) SELECT maker, events, first_ts, last_ts, 100.0::DOUBLE * events / of AS pct, CASE WHEN listed + bid > 0 THEN 100.0::DOUBLE * cancelled / (listed + bid) END AS cancel_pct FROM w, t WHERE events >= 5",
    ),
    "wallet_profile": (
        wallet_profile,
        f"WITH {_W}, c AS (SELECT maker, count(DISTINCT collection) AS collections, count(DISTINCT (collection, token_id)) FILTER (token_id IS NOT NULL) AS token_ids, count(DISTINCT taker) AS takers FROM market_events WHERE maker IS NOT NULL GROUP BY 1) SELECT * FROM w JOIN c USING (maker)",
    ),
    "counterparties": (
        counterparties,
        f"WITH {_SOLD}, u AS (SELECT maker AS address, taker AS other, 1 AS x, v FROM s UNION ALL SELECT taker, maker, 0, v FROM s) SELECT address, other, count(*) AS trades, CAST(sum(x) AS BIGINT) AS as_seller, max(v) AS dearest FROM u GROUP BY ALL",
    ),
    "adjacency": (
        adjacency,
        f"WITH {_SOLD}, b AS (SELECT a FROM (SELECT maker AS a FROM s UNION ALL SELECT taker FROM s) GROUP BY a ORDER BY count(*) DESC, a LIMIT 12), n AS (SELECT maker, taker, count(*) AS n FROM s GROUP BY ALL)"
        " SELECT x.a AS maker, y.a AS taker, coalesce(n, 0) AS n FROM b x CROSS JOIN b y LEFT JOIN n ON n.maker = x.a AND n.taker = y.a",
    ),
    "rollup_equals_direct": (
        rollup,
        "SELECT coalesce(maker, '') AS maker, event_type, count(*) AS n, min(valid_ts) AS min_ts, max(valid_ts) AS max_ts FROM market_events WHERE collection IS NOT NULL AND valid_ts >= 1706800123.5 AND valid_ts < 1707900456.25 GROUP BY ALL",
    ),
}
