"""Raw landing envelopes: one JSON object per line around a frame in one of two wire shapes.

Envelope: ``{_seq, _run, _recv, _topic, _ets, raw}``; ``raw`` is JSON text, a
map ``{topic, event, payload, ref}`` or an array ``[join_ref, ref, topic, event,
payload]``. Parsing is by JSON expressions with fixed schemas, without any Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.times import seconds
from tidemark.operators.ordered import PART, carried, range_sorted

ENVELOPE = "_seq bigint, _run string, _recv string, _topic string, _ets string, raw string"
CONTROL = "__control__"
#: The event types of the market.
EVENT_TYPES = (
    "item_listed", "item_sold", "item_cancelled", "item_received_bid", "item_received_offer", "item_transferred", "item_metadata_updated",
    "collection_offer", "trait_offer", "order_invalidate", "order_revalidate",
)
#: Fields of the identity of an event that two connections agree on, in order.
KEY_FIELDS = ["event_type", "order_hash", "event_timestamp", "tx_hash", "contract", "token_id", "maker", "price_wei", "quantity"]


_CRITERION = "struct<trait_type:string,trait_name:string,value:string,trait_value:string>"
_ADDRESS = "struct<address:string>"
_ORDER_ITEMS = "array<struct<itemType:int,identifierOrCriteria:string,token:string>>"
#: The item types of an order that are tokens (or criteria over tokens), not money.
TOKEN_ITEMS = (2, 3, 4, 5)
#: The payload fields that are read; anything else is ignored, the raw text stays in the landing zone.
PAYLOAD = (
    "event_timestamp string, collection struct<slug:string>, chain string, item struct<nft_id:string,chain:struct<name:string>>, order_hash string,"
    f" maker {_ADDRESS}, taker {_ADDRESS}, from_account {_ADDRESS}, to_account {_ADDRESS}, base_price string, sale_price string, payment_token struct<symbol:string>, quantity bigint,"
    f" expiration_date string, `transaction` struct<hash:string>, trait_criteria {_CRITERION}, trait_criteria_list array<{_CRITERION}>, numeric_trait_criteria_list array<struct<trait_type:string,min:double,max:double>>,"
    f" protocol_data struct<parameters:struct<consideration:{_ORDER_ITEMS},offer:{_ORDER_ITEMS}>>, asset_contract_criteria {_ADDRESS}"
)


def dedup_key(event_timestamp: Column, fields: list[Column]) -> Column:
    """SHA-256 over the identity fields; null without an event timestamp. A null field is an empty text, not left out."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.when(event_timestamp.isNotNull(), F.sha2(F.concat_ws("\x1f", *parts), 256))


def criteria(p: Column) -> Column:
    """The AND-list of a trait offer: array of (idx, kind, trait_type, value, num_min, num_max); a list wins over a single one, unreadable ones give no entry."""
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    single = F.when(p["trait_criteria"].isNotNull(), F.array(p["trait_criteria"]))
    named = lambda c: F.coalesce(c["trait_type"], c["trait_name"])
    strings = F.transform(F.coalesce(p["trait_criteria_list"], single), lambda c: F.struct(F.lit("string").alias("kind"), named(c).alias("trait_type"), F.coalesce(c["value"], c["trait_value"]).alias("value"), no_number.alias("num_min"), no_number.alias("num_max")))
    numbers = F.transform(p["numeric_trait_criteria_list"], lambda c: F.struct(F.lit("numeric").alias("kind"), c["trait_type"].alias("trait_type"), no_text.alias("value"), c["min"].alias("num_min"), c["max"].alias("num_max")))
    none = F.array().cast("array<struct<kind:string,trait_type:string,value:string,num_min:double,num_max:double>>")
    readable = F.filter(F.concat(F.coalesce(strings, none), F.coalesce(numbers, none)), lambda c: c["trait_type"].isNotNull() & ((c["kind"] == "numeric") | c["value"].isNotNull()))
    return F.transform(readable, lambda c, i: F.struct(i.alias("idx"), *[c[f].alias(f) for f in ("kind", "trait_type", "value", "num_min", "num_max")]))


def token_of(p: Column) -> tuple[Column, Column]:
    """(contract, token id): the item's own, else the first token among the order's consideration, then its offer; the contract at last from the criteria."""
    nft = F.split(p["item"]["nft_id"], "/")
    parameters = p["protocol_data"]["parameters"]
    none = F.array().cast(_ORDER_ITEMS)
    named = F.filter(F.concat(F.coalesce(parameters["consideration"], none), F.coalesce(parameters["offer"], none)), lambda x: x["itemType"].isin(*TOKEN_ITEMS) & (x["identifierOrCriteria"] != ""))
    own, ordered = F.get(nft, 2), F.get(named, 0)
    contract = F.coalesce(F.get(nft, 1), F.when(own.isNull(), ordered["token"]), p["asset_contract_criteria"]["address"])
    return contract, F.coalesce(own, ordered["identifierOrCriteria"])


def frame_counts(envelopes: DataFrame) -> DataFrame:
    """Per run: frames, market events, control frames, frames without event time, and frames that arrived behind a later event time of their run's file order."""
    frames = split_frames(envelopes).select("_run", "_seq", seconds(F.col("_ets")).alias("t"), F.col("event").isin(*EVENT_TYPES).alias("market"))
    control = envelopes.filter(F.col("_topic") == CONTROL).groupBy("_run").agg(F.count(F.lit(1)).alias("controls"))
    timed = frames.filter("t is not null and _run is not null and _seq is not null").groupBy("_run", "_seq").agg(F.max("t").alias("t"))
    parts = range_sorted(timed, ["_run"], ["_seq"])
    before = F.max("t").over(W.partitionBy("_run", PART).orderBy("_seq").rowsBetween(W.unboundedPreceding, -1))
    late = parts.withColumn("__b", before).join(carried(parts, ["_run"], F.col("t"), F.max), ["_run", PART]).filter(F.col("t") < F.greatest("__b", "__carry")).groupBy("_run").agg(F.count(F.lit(1)).alias("out_of_order"))
    per = frames.groupBy("_run").agg(F.count(F.lit(1)).alias("frames"), F.count_if("market").alias("events"), F.count_if(F.col("t").isNull()).alias("without_time"))
    out = per.join(control, "_run", "full").join(late, "_run", "left")
    return out.fillna(0, ["frames", "events", "without_time", "controls", "out_of_order"])


def split_frames(envelopes: DataFrame) -> DataFrame:
    """Envelopes with the frame's ``event``, ``sent_at`` and ``payload`` (JSON text), control frames left out; unreadable ones keep nulls."""
    frames = envelopes.filter(F.coalesce("_topic", F.lit("")) != CONTROL)
    array = F.startswith(F.ltrim("raw"), F.lit("["))
    read = frames.select(*envelopes.columns, F.when(array, F.from_json("raw", "array<string>")).alias("__a"), F.when(~array, F.from_json("raw", "event string, payload string")).alias("__m"))
    outer = read.select(*envelopes.columns, F.coalesce(F.get("__a", 3), F.col("__m.event")).alias("event"), F.coalesce(F.get("__a", 4), F.col("__m.payload")).alias("__o"))
    opened = outer.withColumn("__p", F.from_json("__o", "sent_at string, payload string"))
    is_object = lambda c: F.startswith(F.ltrim(c), F.lit("{"))
    payload = F.when(is_object(F.col("__p.payload")), F.col("__p.payload")).when(is_object(F.col("__o")), F.col("__o"))
    return opened.select(*envelopes.columns, "event", F.col("__p.sent_at").alias("sent_at"), payload.alias("payload"))


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """One event row per readable market frame; the rest is in :func:`unparsed`."""
    # the choice of rows is a generator and no filter: a filter would be pushed below the parsing and repeat all of it
    market = F.col("event").isin(*EVENT_TYPES) & F.col("payload").isNotNull()
    rows = split_frames(envelopes).select("_run", "_seq", "_recv", "event", "sent_at", F.explode(F.when(market, F.array("payload"))).alias("payload"))
    read = rows.select("_run", "_seq", "_recv", "event", "sent_at", F.from_json("payload", PAYLOAD).alias("p"))
    p = F.col("p")
    contract, token = token_of(p)
    out = read.select(
        F.col("_run").alias("run"), F.col("_seq").alias("seq"), F.col("_recv").alias("observed_at"), F.coalesce(p["event_timestamp"], "sent_at").alias("valid_at"), p["event_timestamp"].alias("event_timestamp"),
        F.col("event").alias("event_type"), p["collection"]["slug"].alias("collection"), F.coalesce(p["chain"], p["item"]["chain"]["name"]).alias("chain"),
        contract.alias("contract"), token.alias("token_id"), p["order_hash"].alias("order_hash"),
        F.coalesce(p["maker"]["address"], p["from_account"]["address"]).alias("maker"), F.coalesce(p["taker"]["address"], p["to_account"]["address"]).alias("taker"),
        F.coalesce(p["base_price"], p["sale_price"]).alias("price_wei"), p["payment_token"]["symbol"].alias("payment_symbol"), p["quantity"].alias("quantity"),
        p["expiration_date"].alias("expiration_at"), p["transaction"]["hash"].alias("tx_hash"), criteria(p).alias("criteria"),
    )
    timed = out.withColumns({"observed_ts": seconds(F.col("observed_at")), "valid_ts": seconds(F.col("valid_at")), "expiration_ts": seconds(F.col("expiration_at"))})
    return timed.withColumn("dedup_key", dedup_key(F.col("event_timestamp"), [F.col(f) for f in KEY_FIELDS]))


def unparsed(envelopes: DataFrame) -> DataFrame:
    """Frames no row could be made of, kept with the reason."""
    rows = split_frames(envelopes)
    reason = F.when(F.try_parse_json("raw").isNull(), "not JSON").when(F.col("event").isNull(), "no event").when(~F.col("event").isin(*EVENT_TYPES), "unknown event").when(F.col("payload").isNull(), "no payload")
    return rows.withColumn("reason", reason).filter("reason is not null").select("_run", "_seq", "raw", "reason")


def order_criteria(events: DataFrame) -> DataFrame:
    """The criteria as child rows."""
    return events.select("run", "seq", F.explode("criteria").alias("c")).select("run", "seq", "c.*")


def to_envelopes(events: DataFrame) -> DataFrame:
    """Events written as envelopes again, odd sequence numbers in the array shape; the inverse of parse_envelopes for the fields it writes."""
    payload = F.struct(
        F.col("valid_at").alias("event_timestamp"), F.struct(F.col("collection").alias("slug")).alias("collection"), "chain", "order_hash",
        F.struct(F.when(F.col("token_id").isNotNull(), F.concat_ws("/", F.coalesce("chain", F.lit("")), F.coalesce("contract", F.lit("")), "token_id")).alias("nft_id")).alias("item"),
        F.struct(F.col("maker").alias("address")).alias("maker"), F.struct(F.col("taker").alias("address")).alias("taker"), F.col("price_wei").alias("base_price"),
        F.struct(F.col("payment_symbol").alias("symbol")).alias("payment_token"), "quantity", F.col("expiration_at").alias("expiration_date"), F.struct(F.col("tx_hash").alias("hash")).alias("transaction"),
    )
    inner = F.to_json(F.struct(payload.alias("payload")))
    topic = F.concat(F.lit("collection:"), F.coalesce("collection", F.lit("")))
    array = F.concat(F.lit('["1","2",'), F.to_json(F.array(topic)).substr(F.lit(2), F.length(F.to_json(F.array(topic))) - 2), F.lit(',"'), F.col("event_type"), F.lit('",'), inner, F.lit("]"))
    mapped = F.concat(F.lit('{"event":"'), F.col("event_type"), F.lit('","payload":'), inner, F.lit("}"))
    return events.select(F.col("seq").alias("_seq"), F.col("run").alias("_run"), F.col("observed_at").alias("_recv"), topic.alias("_topic"), F.col("valid_at").alias("_ets"), F.when(F.col("seq") % 2 == 1, array).otherwise(mapped).alias("raw"))
