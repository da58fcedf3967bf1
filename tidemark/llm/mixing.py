"""A mix of sources by target shares of its size, every record repeated at most a capped number of times.

Poisson replication: the budget of the mix is the size of all records; a source
with share s, size z and cap c needs the mean repetition rate r = s * budget / z.
A record's number of copies is the inverse of a Poisson distribution at a value
in [0, 1) hashed from its id and the seed, cut at c; the distribution's
parameter is chosen so that the mean after the cut is r. Where r >= c every
record appears c times and the source stays short; with the ``reachable`` budget
the mix is made smaller instead, so that every source with records meets its
share. Each record is exploded by its number of copies, and the copies are
shuffled globally by a second hash; reports are taken from that mix.

Defined cases: a null text has size 0; records of a null source or one without
target aren't in the mix, but count in the budget; a target without records
stays short; of several targets of one source the largest counts; equal ids draw
equal numbers of copies; an empty table gives an empty mix; extra columns pass
through unless they are called like a result column, which then wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.tokens import RANKS, spread, token_count

#: A plan of at most this many sources is broadcast to the records; a larger one meets them by a shuffle join.
BROADCAST_SOURCES = 10_000
#: Standard deviations of a Poisson distribution that are told apart; what lies beyond has a probability under 1e-30.
TAIL = 12.0


def _window(lam: float, cap: int) -> tuple[int, np.ndarray]:
    """(first k, P(X <= k) from there on) for X ~ Poisson(lam) and the k below ``cap`` at which that isn't 0 or 1 for a double."""
    wide = TAIL * math.sqrt(lam) + 40
    lo, hi = max(0, int(lam - wide)), min(cap, int(lam + wide) + 1)
    if hi <= lo:
        return cap, np.empty(0)
    k = np.arange(lo, hi, dtype=float)
    if lam <= 0:
        return lo, np.ones(len(k))
    first = lo * math.log(lam) - lam - math.lgamma(lo + 1)
    logs = first + np.concatenate([[0.0], np.cumsum(math.log(lam) - np.log(k[1:]))])
    return lo, np.minimum(np.cumsum(np.exp(logs)), 1.0)


def capped_mean(lam: float, cap: int) -> float:
    """Mean of min(X, cap) for X ~ Poisson(lam)."""
    lo, upto = _window(lam, cap)
    return lo + float((1.0 - upto).sum())


def poisson_rate(mean: float, cap: int) -> float:
    """The Poisson parameter whose mean after the cut at ``cap`` is ``mean`` (< cap)."""
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return hi


def thresholds(mean: float, cap: int) -> tuple[int, list[float]]:
    """(copies that every record has, rising thresholds): a record has one more for each threshold at or below its hashed value."""
    if mean <= 0 or cap <= 0:
        return 0, []
    if mean >= cap:
        return cap, []
    lo, upto = _window(poisson_rate(mean, cap), cap)
    return lo, upto[upto < 1.0].tolist()


def unit_hash(seed: int, *cols: Column) -> Column:
    """A hashed value in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def sized(docs: DataFrame, text: str, ranks: str = RANKS) -> DataFrame:
    """The records with their n_tokens."""
    return spread(docs).withColumn("n_tokens", token_count(F.col(text), ranks))


PLAN = "source string, target_share double, max_repeats int, tokens bigint, budget double, rate double, base int, cuts array<double>"


def mix_plan(sizes: DataFrame, targets: DataFrame, budget: str = "all") -> DataFrame:
    """One row per target: source, target_share, max_repeats, tokens, budget, rate, base and cuts (see thresholds).

    ``budget``: 'all', the size of all records, or 'reachable', the largest mix up
    to that in which every source with records can have its share.
    """
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("c"))).alias("t"))
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("budget"))  # one row
    named = wanted.join(sums, "source", "left").select("source", F.col("t.s").alias("target_share"), F.col("t.c").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    if budget == "reachable":
        most = named.filter("tokens > 0 and target_share > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("most"))
        total = total.join(F.broadcast(most)).select(F.least("budget", "most").alias("budget"))
    elif budget != "all":
        raise ValueError(f"no such budget: {budget}")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, share, cap, size, all_ in batch[["source", "target_share", "max_repeats", "tokens", "budget"]].itertuples(index=False):
                rate = share * all_ / size if size else float(cap)
                rows.append((source, share, cap, size, all_, rate, *thresholds(rate, int(cap))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PLAN.split(", ")])

    return named.join(F.broadcast(total)).mapInPandas(solve, PLAN)


def replicas(sizes: DataFrame, plan: DataFrame, doc_id: str, seed: int = 1) -> DataFrame:
    """The records of the mix's sources with their number of copies, 0 included."""
    slim = plan.select("source", "base", "cuts")
    if slim.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        slim = F.broadcast(slim)
    drawn = sizes.drop("copies", "base", "cuts").join(slim, "source")
    at = unit_hash(seed, F.col(doc_id))
    return drawn.withColumn("copies", F.col("base") + F.size(F.filter("cuts", lambda c: c <= at))).drop("base", "cuts")


def mix(sizes: DataFrame, plan: DataFrame, doc_id: str, seed: int = 1) -> DataFrame:
    """The mix: a row per copy (copy = 1..), shuffled globally; ``position`` is its place in the order."""
    copies = replicas(sizes, plan, doc_id, seed).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    placed = copies.withColumn("position", F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.col("copy")))
    # positions are even over all numbers, so equal stretches of them are even partitions, without a look at the data
    n = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stretch = F.least(F.floor((F.col("position").cast("double") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("int")
    return placed.repartitionById(n, stretch).sortWithinPartitions("position")


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per target with what a mix reaches: mixed_tokens, mixed_records, actual_share (of the mix), short."""
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_records"))
    full = plan.join(reached, "source", "left").fillna(0, ["mixed_tokens", "mixed_records"])
    # short: every record is at its cap and the source still lies below its share of the budget
    short = (F.col("rate") >= F.col("max_repeats")) & (F.col("mixed_tokens") < F.col("target_share") * F.col("budget"))
    whole = full.agg(F.sum("mixed_tokens").alias("__all"))  # one row
    return full.join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "tokens", "mixed_tokens", "mixed_records", F.try_divide("mixed_tokens", "__all").alias("actual_share"), short.alias("short")
    )
