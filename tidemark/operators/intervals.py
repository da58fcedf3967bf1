"""Interval algebra, as-of lookups and silence detection on globally ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.ordered import PART, carried, cumulate, range_sorted
from tidemark.operators.spans import periods


def subtract(cover: DataFrame, blind: DataFrame, entity: str) -> DataFrame:
    """What of ``cover`` lies outside ``blind``, both as (entity, from, to): (entity, from, to), disjoint and maximal.

    A sweep over the borders: depth of both sets as running sums, a stretch
    begins where cover is open and blind is not, and its label is the running
    number of such beginnings.
    """
    edge = lambda d, c, b: [d.select(entity, F.col(at).alias("__t"), F.lit(s * c).alias("__c"), F.lit(s * b).alias("__b")) for at, s in (("from", 1), ("to", -1))]
    rows = [*edge(cover.filter("to > from"), 1, 0), *edge(blind.filter("to > from"), 0, 1)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy(entity, "__t").agg(F.sum("__c").alias("__c"), F.sum("__b").alias("__b"))
    at = cumulate(range_sorted(every, [entity], ["__t"]), [entity], ["__t"], {"__cover": F.col("__c"), "__blind": F.col("__b")})
    on, was = (F.col("__cover") > 0) & (F.col("__blind") == 0), (F.col("__cover") - F.col("__c") > 0) & (F.col("__blind") - F.col("__b") == 0)
    turned = at.withColumns({"__on": (on & ~was).cast("int"), "__off": (~on & was).cast("int")})
    label = cumulate(turned, [entity], ["__t"], {"__k": F.col("__on")}).filter("__on = 1 or __off = 1")
    return label.groupBy(entity, "__k").agg(F.min(F.when(F.col("__on") == 1, F.col("__t"))).alias("from"), F.min(F.when(F.col("__off") == 1, F.col("__t"))).alias("to")).drop("__k")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, payload: list[str]) -> DataFrame:
    """Each left row with the payload of the latest right row of its key at or before its time; null if there is none.

    Of right rows at one time the highest payload counts. Rows with a null key
    or time on the right are ignored, on the left they get null.
    """
    named = None
    for k in keys:
        named = F.col(k).isNotNull() if named is None else named & F.col(k).isNotNull()
    l_ok = named & F.col(left_t).isNotNull()
    rest = F.struct(*[F.col(c) for c in left.columns])
    values = F.struct(F.col(right_t).alias("__at"), *payload)
    steps = right.filter(named & F.col(right_t).isNotNull()).groupBy(*keys, F.col(right_t).alias("t")).agg(F.max(values).alias("v"))
    types = {f.name: f.dataType for f in steps.schema}
    rows = left.filter(l_ok).select(*keys, F.col(left_t).alias("t"), F.lit(None).cast(types["v"]).alias("v"), F.lit(1).alias("side"), rest.alias("row"))
    rows = rows.unionByName(steps.select(*keys, F.col("t"), "v", F.lit(0).alias("side")).withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    parts = range_sorted(rows, keys, ["t", "side"])
    here = W.partitionBy(*keys, PART).orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    local = parts.withColumn("__last", F.last("v", ignorenulls=True).over(here))
    both = local.join(carried(parts, keys, F.col("v"), F.max), [*keys, PART]).filter("side = 1")
    found = F.coalesce("__last", "__carry")
    out = both.select("row.*", *[found[p].alias(p if p not in left.columns else f"{p}_right") for p in payload])
    lost = left.filter(~F.coalesce(l_ok, F.lit(False)))
    for f in out.schema[len(left.columns) :]:
        lost = lost.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.unionByName(lost)


def covered_whole(spans: DataFrame, cover: DataFrame, entity: str) -> DataFrame:
    """The spans (entity, from, to, ...) that lie wholly within one continuous period of ``cover``."""
    merged, _ = periods(cover, entity, "from", "to")
    at = asof_join(spans, merged.withColumnsRenamed({"from": "__begin", "to": "__end"}), [entity], "from", "__begin", ["__end"])
    return at.filter(F.col("__end") >= F.col("to")).drop("__end")


def silences(df: DataFrame, keys: list[str], t: str, longer_than: float) -> DataFrame:
    """Stretches between successive rows of a key that last longer than ``longer_than``: (keys, from, to)."""
    times = df.filter(F.col(t).isNotNull()).select(*keys, F.col(t).alias("t")).distinct()
    parts = range_sorted(times, keys, ["t"])
    prev = F.lag("t").over(W.partitionBy(*keys, PART).orderBy("t"))
    both = parts.withColumn("__prev", prev).join(carried(parts, keys, F.col("t"), F.max), [*keys, PART])
    return both.select(*keys, F.coalesce("__prev", "__carry").alias("from"), F.col("t").alias("to")).filter(F.col("to") - F.col("from") > longer_than)
