"""Trait filters, set containment, verdicts, floors, screener, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.lives import standing_at
from tidemark.operators.tags import TOKEN, case_near_misses, covers, offer_verdicts, parse_filter, reconcile, token_number, tokens_matching, value_census
from tidemark.session import table

FLT = parse_filter("Season:Thaw|High Sun|Leaf Fall;Companion:Lantern Eel|Tin Fox|Paper Owl")
PINS = parse_filter("Season:Thaw;Companion:Lantern Eel;Hull:Riveted Brass;Rune:Tesh")
NOW = 1_708_000_000.0
#: Values of the tags by which offers of the test data are given criteria (the table holds only their number).
PAIRS = [("Season", "Thaw"), ("Companion", "Lantern Eel"), ("Hull", "Riveted Brass"), ("Season", "High Sun"), ("Rune", "Tesh"), ("Companion", "Tin Fox"), ("Banner", "Checker")]


def token_filter(spark: SparkSession, d: str) -> DataFrame:
    return tokens_matching(table(spark, d, "traits"), FLT)


def trait_values(spark: SparkSession, d: str) -> DataFrame:
    return value_census(table(spark, d, "traits"))


def trait_coverage(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "traits").select(*TOKEN).distinct().withColumn("has", F.lit(1))
    return table(spark, d, "tokens").join(have, TOKEN, "left").groupBy("collection", "traits_source").agg(
        F.count(F.lit(1)).alias("tokens"), F.count("has").alias("with_traits"), F.count("traits_error").alias("errors"), F.try_divide(F.count("has") * 100.0, F.count(F.lit(1))).alias("pct")
    )


def near_misses(spark: SparkSession, d: str) -> DataFrame:
    return case_near_misses(table(spark, d, "traits"))


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Trait offers with criteria chosen from PAIRS by the order hash."""
    rows = table(spark, d, "order_lives").filter("event_type = 'trait_offer'")
    code = F.ascii(F.substring("order_hash", -1, 1)) * 31 + F.ascii(F.substring("order_hash", -2, 1))
    pairs = F.array(*[F.struct(F.lit(a).alias("trait_type"), F.lit(v).alias("value")) for a, v in PAIRS])
    n = F.coalesce("criteria_n", F.lit(0))
    picked = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(pairs, F.pmod(code + i, F.lit(len(PAIRS))) + 1))).otherwise(F.slice(pairs, 1, 0))
    return rows.select("order_hash", "collection", "price_eth", "criteria_n", "criteria_numeric_n", picked.alias("criteria"))


def cover_offers(spark: SparkSession, d: str) -> DataFrame:
    o = offers(spark, d)
    return o.filter(covers(F.col("criteria"), F.col("criteria_n"), F.col("criteria_numeric_n"), PINS)).select("order_hash", "collection", "price_eth")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return offer_verdicts(offers(spark, d), table(spark, d, "traits"), parse_filter("Season:Thaw;Companion:Lantern Eel|Tin Fox"))


def criteria_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Criteria that no stored tag of their collection can meet."""
    pairs = offers(spark, d).select("collection", F.explode("criteria").alias("c")).select("collection", "c.trait_type", "c.value").distinct()
    return pairs.join(table(spark, d, "traits").select("collection", "trait_type", "value"), ["collection", "trait_type", "value"], "left_anti")


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Per token the lowest standing listing and the highest standing bid."""
    live = standing_at(table(spark, d, "order_lives"), NOW).filter("token_id is not null and collection is not null and price_eth is not null and not isnan(price_eth)")
    ask, bid = F.when(F.col("event_type") == "item_listed", F.col("price_eth")), F.when(F.col("event_type") == "item_received_bid", F.col("price_eth"))
    return live.groupBy(*TOKEN).agg(F.min(ask).alias("floor"), F.max(bid).alias("best_bid"))


def trait_floors(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "traits").select(*TOKEN, "trait_type", "value").distinct().join(_books(spark, d), TOKEN, "left")
    floor_at = F.min(F.when(F.col("floor").isNotNull(), F.struct("floor", "token_id")))
    bid_at = F.min(F.when(F.col("best_bid").isNotNull(), F.struct((-F.col("best_bid")).alias("b"), "token_id")))
    out = both.groupBy("collection", "trait_type", "value").agg(F.count(F.lit(1)).alias("tokens"), F.count("floor").alias("listed"), floor_at.alias("f"), bid_at.alias("b"))
    return out.select("collection", "trait_type", "value", "tokens", "listed", F.col("f.floor").alias("floor"), F.col("f.token_id").alias("floor_token"), (-F.col("b.b")).alias("best_bid"), F.col("b.token_id").alias("bid_token"))


def screener(spark: SparkSession, d: str) -> DataFrame:
    """Second page of a collection's tokens by floor; missing last, numbers before texts."""
    sold = table(spark, d, "market_events").filter("event_type = 'item_sold' and price_eth is not null and not isnan(price_eth) and valid_ts is not null")
    last = sold.groupBy(*TOKEN).agg(F.max(F.struct("valid_ts", "price_eth")).alias("s")).select(*TOKEN, F.col("s.price_eth").alias("last_sale"))
    season = table(spark, d, "traits").filter("trait_type = 'Season'").groupBy(*TOKEN).agg(F.min("value").alias("season"))
    rows = table(spark, d, "tokens").filter("collection = 'ember-beetles'").select(*TOKEN).join(_books(spark, d), TOKEN, "left").join(last, TOKEN, "left").join(season, TOKEN, "left")
    number = token_number(F.col("token_id"))
    order = [F.col("floor").isNull(), F.col("floor"), number.isNull(), number, F.lower("token_id"), F.col("token_id")]
    return rows.orderBy(*order).offset(10).limit(25)


def import_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The tags as stored against the same tags with names and values without outer blanks."""
    left = table(spark, d, "traits")
    right = left.filter("length(value) > 1").select(*TOKEN, F.trim("trait_type").alias("trait_type"), F.trim("value").alias("value"))
    return reconcile(left, right).select(*TOKEN, "trait_type", "status", F.array_join("l", "|").alias("l"), F.array_join("r", "|").alias("r"))


def token_num_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokens").filter("collection = 'ember-beetles'").withColumn("token_num", token_number(F.col("token_id")))
    return rows.filter("token_num between 4 and 500").orderBy("token_num").select("token_id", "token_num").limit(50)


_IN = " AND ".join(
    f"(collection, token_id) IN (SELECT (collection, token_id) FROM traits WHERE trait_type = '{a}' AND value IN ({', '.join(repr(v) for v in vs)}))" for a, vs in FLT.items()
)
_PAIRS = ", ".join(f"({i}, '{a}', '{v}')" for i, (a, v) in enumerate(PAIRS))
_OFF = f"""p(i, trait_type, value) AS (VALUES {_PAIRS}),
off_ AS (SELECT order_hash, collection, price_eth, criteria_n, criteria_numeric_n, ascii(right(order_hash, 1)) * 31 + ascii(left(right(order_hash, 2), 1)) AS code FROM order_lives WHERE event_type = 'trait_offer'),
cr AS (SELECT o.order_hash, o.collection, p.trait_type, p.value FROM (SELECT *, unnest(range(criteria_n)) AS k FROM off_ WHERE criteria_n > 0) o JOIN p ON p.i = (o.code + o.k) % {len(PAIRS)})"""
_PINNED = ", ".join(f"('{a}', '{v[0]}')" for a, v in PINS.items())
_BOOKS = f"""b AS (SELECT collection, token_id, min(price_eth) FILTER (event_type = 'item_listed') AS floor, max(price_eth) FILTER (event_type = 'item_received_bid') AS best_bid FROM order_lives
 WHERE placement_seen = 1 AND t_place <= {NOW} AND exit_reason <> 'unknown' AND (t_term IS NULL OR t_term > {NOW}) AND (expiration_ts IS NULL OR expiration_ts > {NOW}) AND token_id IS NOT NULL AND collection IS NOT NULL AND price_eth IS NOT NULL AND NOT isnan(price_eth) GROUP BY ALL)"""
_NUM = "CASE WHEN CAST(TRY_CAST(token_id AS BIGINT) AS VARCHAR) = token_id THEN TRY_CAST(token_id AS BIGINT) END"

QUERIES = {
    "token_filter": (token_filter, f"SELECT DISTINCT collection, token_id FROM traits WHERE {_IN}"),
    "trait_values": (trait_values, "SELECT collection, trait_type, value, count(DISTINCT token_id) AS tokens FROM traits GROUP BY ALL"),
    "trait_coverage": (
        trait_coverage,
        "SELECT collection, traits_source, count(*) AS tokens, count(h) AS with_traits, count(traits_error) AS errors, 100.0::DOUBLE * count(h) / count(*) AS pct"
        " FROM tokens LEFT JOIN (SELECT DISTINCT collection, token_id, 1 AS h FROM traits) USING (collection, token_id) GROUP BY ALL",
    ),
    "case_near_misses": (
        near_misses,
        "SELECT collection, trait_type, lower(trim(value)) AS folded, count(DISTINCT value) AS variants, string_agg(DISTINCT value, '|' ORDER BY value) AS spellings FROM traits GROUP BY ALL HAVING count(DISTINCT value) > 1",
    ),
    "cover_offers": (
        cover_offers,
        f"WITH {_OFF} SELECT order_hash, collection, price_eth FROM off_ WHERE criteria_n > 0 AND coalesce(criteria_numeric_n, 0) = 0 AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.order_hash = off_.order_hash AND (cr.trait_type, cr.value) NOT IN (VALUES {_PINNED}))",
    ),
    "offer_verdicts": (
        verdicts,
        f"""WITH {_OFF}, f AS (SELECT DISTINCT collection, token_id FROM traits WHERE trait_type = 'Season' AND value = 'Thaw' INTERSECT SELECT DISTINCT collection, token_id FROM traits WHERE trait_type = 'Companion' AND value IN ('Lantern Eel', 'Tin Fox')),
c AS (SELECT DISTINCT * FROM cr), k AS (SELECT order_hash, count(*) AS k FROM c GROUP BY 1),
m AS (SELECT c.order_hash, t.token_id, count(*) AS k FROM c JOIN (SELECT DISTINCT * FROM traits) t ON t.collection = c.collection AND t.trait_type = c.trait_type AND t.value = c.value JOIN f ON f.collection = t.collection AND f.token_id = t.token_id GROUP BY ALL),
v AS (SELECT m.order_hash, count(*) AS overlap FROM m JOIN k ON k.order_hash = m.order_hash AND k.k = m.k GROUP BY 1),
x AS (SELECT off_.order_hash, collection, CASE WHEN criteria_n IS NULL OR criteria_n = 0 THEN 'unparsed' WHEN criteria_numeric_n > 0 THEN 'unknown'
 WHEN NOT EXISTS (SELECT 1 FROM cr WHERE cr.order_hash = off_.order_hash AND (cr.trait_type, cr.value) <> ('Season', 'Thaw')) THEN 'covers' WHEN overlap > 0 THEN 'partial' ELSE 'disjoint' END AS verdict, overlap FROM off_ LEFT JOIN v USING (order_hash))
SELECT order_hash, collection, verdict, CASE WHEN verdict = 'partial' THEN overlap END AS overlap FROM x""",
    ),
    "criteria_coverage": (criteria_coverage, f"WITH {_OFF} SELECT DISTINCT collection, trait_type, value FROM cr WHERE NOT EXISTS (SELECT 1 FROM traits t WHERE t.collection = cr.collection AND t.trait_type = cr.trait_type AND t.value = cr.value)"),
    "trait_floors": (
        trait_floors,
        f"WITH {_BOOKS}, j AS (SELECT t.*, floor, best_bid FROM (SELECT DISTINCT collection, token_id, trait_type, value FROM traits) t LEFT JOIN b USING (collection, token_id))"
        " SELECT collection, trait_type, value, count(*) AS tokens, count(floor) AS listed, min(floor) AS floor, (list(token_id ORDER BY floor, token_id) FILTER (floor IS NOT NULL))[1] AS floor_token, max(best_bid) AS best_bid,"
        " (list(token_id ORDER BY best_bid DESC, token_id) FILTER (best_bid IS NOT NULL))[1] AS bid_token FROM j GROUP BY ALL",
    ),
    "screener": (
        screener,
        f"WITH {_BOOKS}, l AS (SELECT collection, token_id, arg_max(price_eth, struct_pack(a := valid_ts, b := price_eth)) AS last_sale FROM market_events WHERE event_type = 'item_sold' AND price_eth IS NOT NULL AND NOT isnan(price_eth) AND valid_ts IS NOT NULL GROUP BY ALL),"
        " s AS (SELECT collection, token_id, min(value) AS season FROM traits WHERE trait_type = 'Season' GROUP BY ALL)"
        f" SELECT collection, token_id, floor, best_bid, last_sale, season FROM (SELECT collection, token_id FROM tokens WHERE collection = 'ember-beetles') LEFT JOIN b USING (collection, token_id) LEFT JOIN l USING (collection, token_id) LEFT JOIN s USING (collection, token_id)"
        f" ORDER BY floor IS NULL, floor, ({_NUM}) IS NULL, ({_NUM}), lower(token_id), token_id LIMIT 25 OFFSET 10",
    ),
    "import_reconcile": (
        import_reconcile,
        "WITH l AS (SELECT collection, token_id, trait_type, string_agg(DISTINCT value, '|' ORDER BY value) AS l FROM traits GROUP BY ALL),"
        " r AS (SELECT collection, token_id, trait_type, string_agg(DISTINCT value, '|' ORDER BY value) AS r FROM (SELECT collection, token_id, trim(trait_type) AS trait_type, trim(value) AS value FROM traits WHERE length(value) > 1) GROUP BY ALL)"
        " SELECT collection, token_id, trait_type, CASE WHEN r IS NULL THEN 'left_only' WHEN l IS NULL THEN 'right_only' WHEN l = r THEN 'same' ELSE 'conflict' END AS status, l, r FROM l FULL JOIN r USING (collection, token_id, trait_type)",
    ),
    "token_num_sort": (token_num_sort, f"SELECT token_id, {_NUM} AS token_num FROM tokens WHERE collection = 'ember-beetles' AND {_NUM} BETWEEN 4 AND 500 ORDER BY 2 LIMIT 50"),
}
