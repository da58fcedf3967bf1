"""Events of a key folded into one interval-valued life, with redundant deliveries merged and counted.

Which event types open a life, end it, end it until revoked, or revoke, are
parameters (``Roles``). No list of events is gathered: everything is a minimum,
maximum or count per key, so a key of any size is handled with map-side
combination.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Roles:
    opens: tuple[str, ...] = ("item_listed", "item_received_bid", "collection_offer", "trait_offer", "item_received_offer")
    ends: dict[str, str] = field(default_factory=lambda: {"item_cancelled": "cancelled", "order_invalidate": "invalidated", "item_sold": "filled"})
    revocable: str = "order_invalidate"
    revokes: str = "order_revalidate"


PRIMARY = "a"
PAYLOAD = ["collection", "token_id", "maker", "quantity", "price_eth", "expiration_ts"]


def one_per_key(events: DataFrame, group: str, key: str, order: list[str], conn: str = "conn") -> DataFrame:
    """One row per (group, key): the lowest in ``order``; rows without key all stay.

    ``__copies`` counts the rows merged into it, ``__a`` and ``__b`` those of the
    primary and of other connections, ``__uneven`` is 1 where connections
    disagree about the number of copies.
    """
    label = F.coalesce(conn, F.lit(PRIMARY))
    rest = [c for c in events.columns if c not in (group, key, *order)]
    row = F.struct(*order, *rest)
    keyed = events.filter(F.col(key).isNotNull()).groupBy(group, key, label.alias("__label")).agg(F.min(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
    primary = F.col("__label") == PRIMARY
    merged = keyed.groupBy(group, key).agg(
        F.min("__row").alias("__row"), F.sum("__n").alias("__copies"),
        F.coalesce(F.sum(F.when(primary, F.col("__n"))), F.lit(0)).alias("__a"), F.coalesce(F.sum(F.when(~primary, F.col("__n"))), F.lit(0)).alias("__b"),
        (F.min("__n") != F.max("__n")).cast("int").alias("__uneven"),
    )
    counts = ["__copies", "__a", "__b", "__uneven"]
    kept = merged.select(group, key, *[F.col(f"__row.{c}").alias(c) for c in (*order, *rest)], *counts)
    keyless = events.filter(F.col(key).isNull()).withColumns({"__copies": F.lit(1).cast("bigint"), "__a": (label == PRIMARY).cast("bigint"), "__b": (label != PRIMARY).cast("bigint"), "__uneven": F.lit(0)})
    return kept.unionByName(keyless.select(*kept.columns))


def fold_lives(events: DataFrame, now: float, roles: Roles = Roles(), key: str = "order_hash") -> DataFrame:
    """One life per key.

    The earliest timed opening counts (else any untimed one). An ending counts
    if it is timed, not before the opening, and not revoked by a strictly later
    revocation; the first such ends the life. Endings that can't be placed make
    it 'unknown'. Otherwise it is 'expired' if its expiration lies before
    ``now``, else 'censored'. Keys with an ending only are orphans
    (placement_seen = 0). Rows with a null key take no part.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("event_type").isin(*roles.opens, *roles.ends, roles.revokes))
    # of copies that tie in all else, one with a time is preferred
    slim = rows.select(key, "dedup_key", "observed_ts", "run", "seq", F.col("valid_ts").isNull().alias("__untimed"), "event_type", "valid_ts", "conn", *PAYLOAD)
    once = one_per_key(slim, key, "dedup_key", ["observed_ts", "run", "seq", "__untimed"])
    kind = F.col("event_type")
    opens, ends = kind.isin(*roles.opens), kind.isin(*roles.ends)
    payload = [F.col(c).alias(c) for c in PAYLOAD]
    place = F.struct(F.col("valid_ts").isNull().alias("untimed"), "valid_ts", "seq", "run", "event_type", "observed_ts", *payload)
    first_end = F.struct("observed_ts", "run", "seq", "event_type", *payload)
    facts = once.groupBy(key).agg(
        F.min(F.when(opens, place)).alias("p"), F.min(F.when(ends, first_end)).alias("e0"), F.min(first_end).alias("any"),
        F.max(F.when(kind == roles.revokes, F.col("valid_ts"))).alias("__revoked"), F.max((kind == roles.revokes).cast("int")).alias("revalidated"),
        F.count_if(ends).cast("int").alias("terminations_seen"), F.count_if(ends & F.col("dedup_key").isNull()).cast("int").alias("terminations_undedupable"),
        (F.sum("__copies") - F.count(F.lit(1))).cast("int").alias("duplicates_merged"),
        F.sum("__a").cast("int").alias("deliveries_a"), F.sum("__b").cast("int").alias("deliveries_b"), F.sum("__uneven").cast("int").alias("multiplicity_disagreements"),
    )
    ended = once.filter(ends).select(key, "event_type", "valid_ts", "seq", "run", *PAYLOAD).join(facts.select(key, F.col("p.valid_ts").alias("__t"), "__revoked"), key)
    revoked = (kind == roles.revocable) & (F.col("__revoked") > F.col("valid_ts"))
    counts = F.col("valid_ts").isNotNull() & (F.col("__t").isNull() | (F.col("valid_ts") >= F.col("__t"))) & ~F.coalesce(revoked, F.lit(False))
    last = ended.groupBy(key).agg(
        F.min(F.when(counts, F.struct("valid_ts", "seq", "run", "event_type", *PAYLOAD))).alias("t"), F.min(F.coalesce(revoked, F.lit(False))).alias("__all_revoked")
    )
    both = facts.join(last, key, "left")
    p, t = F.col("p"), F.col("t")
    expired = p.isNotNull() & (p["expiration_ts"] < now)
    unknown = (F.col("terminations_seen") > 0) & ~F.col("__all_revoked")
    reason: Column = F.lit(None)
    for name, out in roles.ends.items():
        reason = F.when(t["event_type"] == name, out).otherwise(reason)
    src = lambda c: F.when(p.isNotNull(), p[c]).when(t.isNotNull(), t[c]).when(F.col("e0").isNotNull(), F.col("e0")[c]).otherwise(F.col("any")[c])
    return both.select(
        key, src("collection").alias("collection"), p["event_type"].alias("event_type"), src("token_id").alias("token_id"), src("maker").alias("maker"), src("quantity").alias("quantity"),
        src("price_eth").alias("price_eth"), p["valid_ts"].alias("t_place"), p["observed_ts"].alias("t_place_observed"),
        F.when(t.isNotNull(), t["valid_ts"]).when(unknown, None).when(expired, p["expiration_ts"]).alias("t_term"),
        F.when(t.isNotNull(), reason).when(unknown, "unknown").when(expired, "expired").otherwise("censored").alias("exit_reason"),
        F.when(t.isNotNull() | unknown, "observed").when(expired, "derived").alias("exit_source"),
        F.when(t.isNotNull(), t["event_type"]).when(unknown, F.col("e0")["event_type"]).alias("exit_event_type"),
        src("expiration_ts").alias("expiration_ts"), p.isNotNull().cast("int").alias("placement_seen"), "revalidated", "terminations_seen", "terminations_undedupable",
        "duplicates_merged", "deliveries_a", "deliveries_b", "multiplicity_disagreements",
    )


def standing_at(lives: DataFrame, now: float) -> DataFrame:
    """The lives that stand at an instant: [t_place, min(t_term, expiration)), unknown ones excluded."""
    open_ended = lambda c: F.col(c).isNull() | (F.col(c) > now)
    return lives.filter((F.col("placement_seen") == 1) & (F.col("t_place") <= now) & (F.col("exit_reason") != "unknown") & open_ended("t_term") & open_ended("expiration_ts"))
