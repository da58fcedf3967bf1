"""The best of a set of expiring offers over time, and its time-weighted quantiles per bucket.

Elements enter and leave, so no window frame has them. Each bucket's elementary
segments are numbered; a life that covers segments [l, r) is put on the O(log n)
dyadic blocks that make up that range, each block keeps its best price, and a
segment reads the O(log n) blocks that hold it. Work is n log n for any bucket,
all by equality joins; lives that cover a whole bucket are reduced to one best
first. Times are whole milliseconds, so weights add up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = ["key", "bucket"]


def live_intervals(lives: DataFrame, key: str, start: float, horizon: float, price: str = "price_eth") -> DataFrame:
    """key, id, a_ms, z_ms, price of the lives that stand in [start, horizon), clipped to it; null and NaN prices and keys don't take part."""
    ms = lambda c: F.round(c * 1000).cast("bigint")
    end = F.least(F.coalesce("t_term", F.lit(float("inf"))), F.coalesce("expiration_ts", F.lit(float("inf"))), F.lit(float(horizon)))
    ok = (F.col("placement_seen") == 1) & F.col("t_place").isNotNull() & (F.col("exit_reason") != "unknown") & F.col(price).isNotNull() & ~F.isnan(price) & F.col(key).isNotNull()
    cut = lives.filter(ok).select(F.col(key).alias("key"), F.col("order_hash").alias("id"), ms(F.greatest("t_place", F.lit(float(start)))).alias("a"), ms(end).alias("z"), F.col(price).alias("price"))
    return cut.filter("z > a")


def _best(want: str):
    return F.min if want == "min" else F.max


def pieces(intervals: DataFrame, bucket_ms: int) -> DataFrame:
    """Intervals split at bucket borders."""
    split = intervals.withColumn("bucket", F.explode(F.sequence(F.expr(f"a div {bucket_ms}"), F.expr(f"(z - 1) div {bucket_ms}"))))
    lo = F.col("bucket") * bucket_ms
    return split.withColumns({"bucket": lo, "a": F.greatest("a", lo), "z": F.least(F.col("z"), lo + bucket_ms)})


def segments(legs: dict[str, tuple[DataFrame, str]], bucket_ms: int) -> DataFrame:
    """key, bucket, t0, t1 and one best price per leg; a leg without a live offer is null there.

    ``legs``: name -> (intervals, 'min' or 'max'). Segments are those of all
    legs together, so the legs can be compared instant by instant.
    """
    cut = {n: pieces(i, bucket_ms) for n, (i, _) in legs.items()}
    every = None
    for n, p in cut.items():
        p = p.select(*KEY, "a", "z", "price", F.lit(n).alias("leg"))
        every = p if every is None else every.unionByName(p)
    whole = (F.col("a") == F.col("bucket")) & (F.col("z") == F.col("bucket") + bucket_ms)
    part, full = every.filter(~whole), every.filter(whole)
    of = {n: F.col("leg") == n for n in legs}
    best_of = lambda price: [_best(w)(F.when(of[n], F.col(price))).alias(n) for n, (_, w) in legs.items()]
    base = full.groupBy(*KEY).agg(*[c.alias(f"__full_{n}") for c, n in zip(best_of("price"), legs)])
    edges = F.explode(F.array("bucket", F.col("bucket") + bucket_ms, "a", "z"))
    points = every.select(*KEY, edges.alias("t")).distinct()
    order = W.partitionBy(*KEY).orderBy("t")
    numbered = points.withColumns({"i": F.row_number().over(order) - 1, "t1": F.lead("t").over(order)})
    at = numbered.select(*KEY, "t", "i")
    ranged = part.join(at.withColumnsRenamed({"t": "a", "i": "l"}), [*KEY, "a"]).join(at.withColumnsRenamed({"t": "z", "i": "r"}), [*KEY, "z"])
    # the blocks of level j that make up [l, r): an odd lower bound at its left, an odd upper bound at its right
    blocks = F.expr(
        "flatten(transform(sequence(0, cast(floor(log2(r - l)) as int) + 1), j -> filter(array("
        "named_struct('j', j, 'b', cast(ceil(l / shiftleft(1L, j)) as bigint), 'on', ceil(l / shiftleft(1L, j)) < floor(r / shiftleft(1L, j)) and ceil(l / shiftleft(1L, j)) % 2 = 1),"
        "named_struct('j', j, 'b', cast(floor(r / shiftleft(1L, j)) as bigint) - 1, 'on', ceil(l / shiftleft(1L, j)) < floor(r / shiftleft(1L, j)) and floor(r / shiftleft(1L, j)) % 2 = 1)"
        "), x -> x.on)))"
    )
    nodes = ranged.select(*KEY, "leg", "price", F.explode(blocks).alias("x")).select(*KEY, "leg", "price", "x.j", "x.b").groupBy(*KEY, "j", "b").agg(*best_of("price"))
    elementary = numbered.filter("t1 is not null").select(*KEY, F.col("t").alias("t0"), "t1", "i")
    top = numbered.groupBy(*KEY).agg(F.ceil(F.log2(F.count(F.lit(1)))).cast("int").alias("levels"))
    reads = elementary.join(top, KEY).withColumn("j", F.explode(F.sequence(F.lit(0), "levels"))).withColumn("b", F.expr("cast(shiftright(i, j) as bigint)"))
    found = reads.join(nodes, [*KEY, "j", "b"], "left").groupBy(*KEY, "t0", "t1").agg(*[_best(w)(n).alias(n) for n, (_, w) in legs.items()])
    both = found.join(base, KEY, "left")
    merge = {n: (F.least if w == "min" else F.greatest)(n, f"__full_{n}") for n, (_, w) in legs.items()}
    return both.select(*KEY, "t0", "t1", *[c.alias(n) for n, c in merge.items()])


def covered_buckets(intervals: DataFrame, bucket_ms: int, by: list[str] | None = None) -> DataFrame:
    """key, bucket and n, the number of intervals that touch it: counted where they begin and end, not bucket by bucket."""
    by = by or ["key"]
    first, behind = F.expr(f"a div {bucket_ms}"), F.expr(f"(z - 1) div {bucket_ms} + 1")
    change = F.explode(F.array(F.struct(first.alias("i"), F.lit(1).alias("d")), F.struct(behind.alias("i"), F.lit(-1).alias("d"))))
    steps = intervals.select(*by, change.alias("x")).groupBy(*by, "x.i").agg(F.sum("x.d").alias("d"))
    order = W.partitionBy(*by).orderBy("i")  # a row per bucket at most
    run = steps.select(*by, "i", F.lead("i").over(order).alias("until"), F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("n")).filter("n > 0")
    return run.select(*by, F.explode(F.sequence("i", F.col("until") - 1)).alias("i"), "n").select(*by, (F.col("i") * bucket_ms).alias("bucket"), "n")


def time_weighted(segs: DataFrame, by: list[str], value: str, weight: Column, quantiles: dict[str, float]) -> DataFrame:
    """Smallest value whose cumulated weight reaches the share of the total, per quantile, and the total (``weight``); weights are whole numbers."""
    w = segs.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.sum(weight).alias("__w"))
    run = W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    cum = w.withColumn("__cum", F.sum("__w").over(run)).withColumn("__total", F.sum("__w").over(W.partitionBy(*by)))
    picked = [F.min(F.when(F.col("__cum") >= F.lit(q) * F.col("__total") - 1e-6, F.col("__v"))).alias(n) for n, q in quantiles.items()]
    return cum.groupBy(*by).agg(*picked, F.max("__total").alias("weight"))


def standing_series(intervals: DataFrame, want: str, bucket_ms: int, min_n: int = 30) -> DataFrame:
    """Per key and bucket: time-weighted median, p10 and p90 (null under ``min_n`` lives), live seconds, lives."""
    segs = segments({"best": (intervals, want)}, bucket_ms)
    q = time_weighted(segs, KEY, "best", F.col("t1") - F.col("t0"), {"median": 0.5, "p10": 0.1, "p90": 0.9})
    n = covered_buckets(intervals, bucket_ms)
    enough = lambda c: F.when(F.col("n") >= min_n, F.col(c)).alias(c)
    return q.join(n, KEY).select("key", F.expr("bucket div 1000").alias("bucket"), "median", enough("p10"), enough("p90"), "n", (F.col("weight") / 1000).alias("live_s"))


def standing_spread(ask: DataFrame, bid: DataFrame, bucket_ms: int) -> DataFrame:
    """Per key and bucket: time-weighted median of ask - bid over the instants where both stand; null where any instant is crossed."""
    segs = segments({"ask": (ask, "min"), "bid": (bid, "max")}, bucket_ms).filter("ask is not null and bid is not null").withColumn("spread", F.round(F.col("ask") - F.col("bid"), 9))
    q = time_weighted(segs, KEY, "spread", F.col("t1") - F.col("t0"), {"median": 0.5})
    crossed = segs.groupBy(*KEY).agg(F.max((F.col("ask") < F.col("bid")).cast("int")).alias("crossed"))
    return q.join(crossed, KEY).select("key", F.expr("bucket div 1000").alias("bucket"), F.when(F.col("crossed") == 0, F.col("median")).alias("spread"), "crossed", (F.col("weight") / 1000).alias("both_s"))
