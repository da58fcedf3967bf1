"""Lifetimes: as-of observations, episodes, Kaplan-Meier, competing risks, restricted means, bootstrap bands.

Curves are computed per key from counts per distinct duration with globally
ordered running sums, so neither a key nor a duration is gathered in one task.
Durations are seconds rounded to milliseconds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.ordered import PART, carried, cumulate, range_sorted

CAUSES = ("cancelled", "invalidated", "filled", "expired")
Z95 = 1.959963984540054
#: Fewest clusters for a percentile.
MIN_CLUSTERS = 30


def observations(lives: DataFrame, start: float, end: float, as_of: float) -> DataFrame:
    """Lives placed in [start, end) as seen at ``as_of``: ended, cause and duration; later placements and unknown endings are left out.

    An ending counts only if it had happened by ``as_of``; everything else is censored there. A price that is no number is null.
    """
    placed = lives.filter((F.col("placement_seen") == 1) & (F.col("t_place") >= start) & (F.col("t_place") < end) & (F.col("t_place") <= as_of) & (F.col("exit_reason") != "unknown"))
    ended = F.coalesce(F.col("exit_reason").isin(*CAUSES) & (F.col("t_term") <= as_of), F.lit(False))
    return placed.select(
        "order_hash", "collection", "event_type", "scope_kind", "token_id", "maker", F.when(~F.isnan("price_eth"), F.col("price_eth")).alias("price_eth"), "t_place", ended.alias("ended"), F.when(ended, F.col("exit_reason")).alias("cause"),
        F.round(F.when(ended, F.col("t_term")).otherwise(F.lit(as_of)) - F.col("t_place"), 3).alias("duration"),
    )


def excluded(lives: DataFrame, start: float, end: float, as_of: float, key: str) -> DataFrame:
    """What observations() leaves out or cuts, counted per key."""
    placed = lives.filter((F.col("placement_seen") == 1) & (F.col("t_place") >= start) & (F.col("t_place") < end))
    late, unknown = F.col("t_place") > as_of, F.col("exit_reason") == "unknown"
    caused = F.col("exit_reason").isin(*CAUSES)
    return placed.groupBy(key).agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(late).alias("placed_after_as_of"), F.count_if(~late & unknown).alias("unknown_terminator"),
        F.count_if(~late & caused & (F.col("t_term") <= as_of)).alias("ended"), F.count_if(~late & caused & (F.col("t_term") > as_of)).alias("ended_after_as_of"),
    )


def episodes(obs: DataFrame, eps: float) -> DataFrame:
    """Each observation with its cluster: runs of one (maker, scope, token) whose gaps stay under ``eps`` (a gap of exactly eps parts them).

    Observations without maker share one cluster ('-', episode 0).
    """
    keys = ["__m", "__s", "__k"]
    keyed = obs.withColumns({"__m": F.coalesce("maker", F.lit("")), "__s": F.coalesce("scope_kind", F.lit("")), "__k": F.coalesce("token_id", F.lit(""))})
    own = keyed.filter(F.col("maker").isNotNull())
    parts = range_sorted(own, keys, ["t_place", "order_hash"])
    here = W.partitionBy(*keys, PART).orderBy("t_place", "order_hash")
    before = parts.withColumn("__prev", F.lag("t_place").over(here)).join(carried(parts, keys, F.col("t_place"), F.max), [*keys, PART])
    gap = F.col("t_place") - F.coalesce("__prev", "__carry")
    new = before.withColumn("__new", F.when(gap.isNull() | (gap >= eps), 1).otherwise(0)).drop("__prev", "__carry")
    numbered = cumulate(new, keys, ["t_place", "order_hash"], {"episode": F.col("__new")})
    shared = keyed.filter(F.col("maker").isNull()).withColumn("episode", F.lit(0).cast("bigint"))
    return numbered.select(*obs.columns, "episode").unionByName(shared.select(*obs.columns, "episode"))


def km_curve(obs: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Per key and event time: at_risk, d, s (Kaplan-Meier), v (Greenwood), lower and upper (log-log band), cif_<cause> (Aalen-Johansen).

    An observation censored at t is at risk at t. The band is null at s of 0 or
    1 and from the first time at which all at risk end.
    """
    w = F.col(weight) if weight else F.lit(1)
    counts = obs.groupBy(*keys, "duration").agg(F.sum(w).alias("__c"), F.sum(F.when(F.col("ended"), w).otherwise(0)).alias("d"), *[F.sum(F.when(F.col("cause") == c, w).otherwise(0)).alias(f"d_{c}") for c in CAUSES])
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    parts = range_sorted(counts, keys, ["duration"])
    at = cumulate(parts, keys, ["duration"], {"__upto": F.col("__c")}).join(total, keys)
    at = at.withColumn("at_risk", F.col("__n") - F.col("__upto") + F.col("__c")).filter("d > 0")
    stay = F.col("at_risk") > F.col("d")
    logs = {"__log": F.when(stay, F.ln(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0), "v": F.when(stay, F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(0.0), "__over": (~stay).cast("int")}
    run = cumulate(at, keys, ["duration"], logs)
    run = run.withColumn("s", F.when(F.col("__over") > 0, 0.0).otherwise(F.exp("__log")))
    # survival just before: the curve only falls by this time's own factor
    before = F.when(F.col("__over") - (~stay).cast("int") > 0, 0.0).otherwise(F.exp(F.col("__log") - F.when(stay, F.ln(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)))
    run = cumulate(run.withColumn("__before", before), keys, ["duration"], {f"cif_{c}": F.col("__before") * F.col(f"d_{c}") / F.col("at_risk") for c in CAUSES})
    sigma = F.sqrt("v") / F.abs(F.ln("s"))
    ok = (F.col("__over") == 0) & (F.col("s") > 0) & (F.col("s") < 1)
    band = {"lower": F.when(ok, F.pow("s", F.exp(Z95 * sigma))), "upper": F.when(ok, F.pow("s", F.exp(-Z95 * sigma)))}
    return run.withColumns(band).select(*keys, F.col("duration").alias("t"), "at_risk", "d", "s", "v", "lower", "upper", *[f"cif_{c}" for c in CAUSES])


def rmst(curve: DataFrame, obs: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """Area under the curve up to ``tau`` per key; null where tau lies beyond the largest duration.

    Integrated by parts: tau minus the area above, sum of (s before - s at t) * (tau - t).
    """
    falls = jumps(curve, keys).filter(F.col("t") <= tau)
    longest = obs.groupBy(*keys).agg(F.max("duration").alias("__max"))
    area = falls.groupBy(*keys).agg(F.sum((F.lit(tau) - F.col("t")) * F.col("__fall")).alias("__above"))
    return longest.join(area, keys, "left").select(*keys, F.when(F.col("__max") >= tau, F.lit(tau) - F.coalesce("__above", F.lit(0.0))).alias("rmst"))


def jumps(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The curve with the height of its fall at every time (__fall = s before - s); from s alone: s before = s / (1 - d / n)."""
    stay = F.col("at_risk") > F.col("d")
    before = F.when(stay, F.col("s") / (1 - F.col("d") / F.col("at_risk")))
    # the last fall goes to 0, from what is left of 1 after all causes before it
    total = F.aggregate(F.array(*[F.col(f"cif_{c}") for c in CAUSES]), F.lit(0.0), lambda a, x: a + x)
    fall = F.when(stay & (F.col("s") > 0), before - F.col("s")).otherwise(F.lit(0.0))
    with_last = curve.withColumn("__fall", fall).withColumn("__cif", total)
    lost = with_last.groupBy(*keys).agg(F.sum("__fall").alias("__lost"))
    return with_last.join(lost, keys).withColumn("__fall", F.when((F.col("s") == 0) & (F.col("at_risk") == F.col("d")), F.greatest(F.lit(0.0), F.col("__cif") - F.col("__lost"))).otherwise(F.col("__fall")))


def quantiles(curve: DataFrame, obs: DataFrame, keys: list[str], cluster: list[str], shares: dict[str, float]) -> DataFrame:
    """First time at which the curve has fallen by each share; null with fewer than MIN_CLUSTERS clusters."""
    n = obs.select(*keys, *cluster).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"))
    at = curve.groupBy(*keys).agg(*[F.min(F.when(F.col("s") <= 1 - q + 1e-12, F.col("t"))).alias(f"__{k}") for k, q in shares.items()])
    return n.join(at, keys, "left").select(*keys, "clusters", *[F.when(F.col("clusters") >= MIN_CLUSTERS, F.col(f"__{k}")).alias(k) for k in shares])


def downsample(curve: DataFrame, keys: list[str], points: int = 200) -> DataFrame:
    """At most ``points`` of a curve's own times per key: for log-spaced targets the next time at or after each; never interpolated."""
    span = curve.filter("t > 0").groupBy(*keys).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    both = curve.join(span, keys)
    step = (F.ln("__hi") - F.ln("__lo")) / (points - 1)
    slot = F.when((F.col("t") <= F.col("__lo")) | (step <= 0), 0).otherwise(F.ceil((F.ln("t") - F.ln("__lo")) / step - 1e-9))
    first = both.withColumn("__slot", slot).groupBy(*keys, "__slot").agg(F.min("t").alias("t"))
    return curve.join(first.select(*keys, "t"), [*keys, "t"], "left_semi")


def duration_histogram(obs: DataFrame, keys: list[str], bins: int = 40, floor_s: float = 0.001) -> DataFrame:
    """Durations in log-spaced bins per key, counted by cause (null cause = 'censored')."""
    d = F.greatest("duration", F.lit(floor_s))
    span = obs.groupBy(*keys).agg(F.ln(F.min(d)).alias("__lo"), F.ln(F.max(d)).alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / bins
    slot = F.when(step > 0, F.least(F.floor((F.ln(d) - F.col("__lo")) / step + 1e-9), F.lit(bins - 1))).otherwise(0).cast("int")
    return obs.join(span, keys).groupBy(*keys, slot.alias("bin")).agg(*[F.count_if(F.coalesce("cause", F.lit("censored")) == c).alias(c) for c in (*CAUSES, "censored")])


def bootstrap_band(obs: DataFrame, keys: list[str], cluster: list[str], grid: list[float], replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile band of the curve at grid times by resampling clusters: key, t, low, high, clusters.

    Cluster counts are aggregated once; a replicate gives every cluster a
    Poisson(1) multiplicity hashed from its name, the key and the replicate, so
    it needs no shared state and any executor can repeat it. Per replicate only the
    counts on the grid travel. The curve of a replicate treats durations as grouped
    into the intervals of the grid (an observation censored in one is at risk in it).
    """
    edges = np.array(sorted(grid))
    # grid slots: slot i holds (edge i-1, edge i]; the last holds what lies beyond
    slot = F.size(F.filter(F.array(*[F.lit(float(g)) for g in edges]), lambda g: g < F.col("duration")))
    by = obs.groupBy(*keys, *cluster, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ended").alias("d"))
    name = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, *cluster]])
    u = F.shiftrightunsigned(F.xxhash64(name, F.lit(seed), F.col("b")), 11) / F.lit(float(1 << 53))
    cdf = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(12)])
    at = by.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u)
    times = sum(((F.col("u") >= float(x)).cast("int") for x in cdf[1:]), (F.col("u") >= float(cdf[0])).cast("int"))
    drawn = at.withColumn("m", times).filter("m > 0")
    counts = drawn.groupBy(*keys, "b", "slot").agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.sum(F.col("d") * F.col("m")).alias("d"))
    later = W.partitionBy(*keys, "b").orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, 0)
    upto = W.partitionBy(*keys, "b").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    risk = counts.withColumn("at_risk", F.sum("n").over(later))
    factor = F.when(F.col("at_risk") > F.col("d"), F.ln(1 - F.col("d") / F.col("at_risk")))
    logs = risk.withColumn("s", F.when(F.max((F.col("at_risk") <= F.col("d")).cast("int")).over(upto) > 0, 0.0).otherwise(F.exp(F.sum(F.coalesce(factor, F.lit(0.0))).over(upto))))
    points = obs.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))))
    filled = points.join(logs.select(*keys, "b", "slot", "s"), [*keys, "b", "slot"], "left").withColumn("s", F.coalesce(F.last("s", ignorenulls=True).over(upto), F.lit(1.0)))
    n = obs.select(*keys, *cluster).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"))
    tail = (1 - level) / 2
    band = filled.groupBy(*keys, "slot").agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))
    t = F.element_at(F.array(*[F.lit(float(g)) for g in edges]), F.col("slot") + 1)
    return band.join(n.filter("clusters > 1"), keys).select(*keys, t.alias("t"), "low", "high", "clusters")
