"""Aggregates per period of event time that are corrected as late records arrive, up to a cut-off.

State: a multiset per period, kept as counts of values. A batch of records only
adjusts counts; sizes, sums of counts, distincts, extremes and exact medians
are read off the counts again (the median by cumulative counts over the values
in order). A record observed after the cut-off is refused: it is counted apart
and never enters the multiset. Each count carries the round it belongs to
(0 = in the first issue, 1 = a correction, 2 = refused), so any earlier issue
can be derived again.

Defined cases: records without key or readable event time belong to no period;
a null or NaN value counts as a record but is no value; a record observed
before its period's end is in time; equal records all count (repeated
deliveries are the business of ``first_copies``); an empty table gives an empty
result; columns that aren't named are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.ordered import cumulate, range_sorted, running_total
from tidemark.operators.store import VersionedStore, splits_for
from tidemark.session import cut, remove

HOUR_MS = 3_600_000
IN_TIME, CORRECTION, REFUSED = 0, 1, 2


def first_copies(df: DataFrame, ids: list[str], observed: str, columns: list[str]) -> DataFrame:
    """One row per identifier, as its first observed copy says (a copy without observation only where there is no other). Rows with a null in the identifier are copies of nothing and all stay."""
    named = reduce(lambda c, i: c & F.col(i).isNotNull(), ids, F.lit(True))
    # a null observation comes last, whatever else the copy holds
    slim = df.select(*ids, F.struct(F.col(observed).isNull().alias("__unseen"), F.col(observed).alias("__o"), *columns).alias("__row"))
    one = slim.filter(named).groupBy(*ids).agg(F.min("__row").alias("__row"))
    return one.unionByName(slim.filter(~named)).select(*ids, F.col("__row.__o").alias(observed), *[F.col(f"__row.{c}").alias(c) for c in columns])


def value_counts(df: DataFrame, key: str, event_ms: str, observed_ms: str, value: str, grace_ms: int, cutoff_ms: int, period_ms: int = HOUR_MS) -> DataFrame:
    """A batch as count adjustments: key, period, round, value, n."""
    period = F.floor(F.col(event_ms) / F.lit(period_ms)).cast("bigint")
    lag = F.col(observed_ms) - (period + 1) * period_ms
    rounds = F.when(lag <= grace_ms, IN_TIME).when(lag <= cutoff_ms, CORRECTION).otherwise(REFUSED)
    clean = F.when(~F.isnan(F.col(value)), F.col(value) + F.lit(0.0))
    rows = df.filter(F.col(key).isNotNull() & F.col(event_ms).isNotNull() & F.col(observed_ms).isNotNull())
    return rows.groupBy(F.col(key).alias("key"), period.alias("period"), rounds.alias("round"), clean.alias("value")).agg(F.count(F.lit(1)).alias("n"))


class PeriodCounts:
    """The multisets of all periods; a batch is merged in one atomic step that rewrites only the stretches of periods it touches.

    Periods lie in buckets by a hash of the stretch (``STRETCH`` successive
    periods), so a batch with its few late records touches few of them; ``SPREAD``
    buckets share a stretch, so that a busy one isn't the work of one task. With a
    ``closed_before`` mark, periods that end before it are moved out of the open
    part once; what still comes for them (refused records, or a mark that ran
    ahead) is added to them on reading, so no record is ever lost. A negative n
    takes counts back.
    """

    SCHEMA = "key string, period bigint, round int, value double, n bigint"
    STRETCH, SPREAD = 24, 4

    def __init__(self, spark: SparkSession, path: str, splits: int | None = None):
        """``splits``: buckets; as many as shuffle partitions if not given; a store keeps the number it began with."""
        self.store, self.spark, self.splits = VersionedStore(spark, path), spark, splits

    def merge(self, delta: DataFrame, batch_id: str, closed_before: int | None = None) -> None:
        """Add a batch's counts; periods below ``closed_before`` are closed afterwards."""
        if self.store.done(batch_id):
            return
        state = self.store.state()
        splits = splits_for(self.spark, self.splits, state)
        stretch = F.pmod(F.xxhash64(F.expr(f"period div {self.STRETCH}")), F.lit(max(1, splits // self.SPREAD)))
        split = (stretch * self.SPREAD + F.pmod(F.xxhash64("key", "value"), F.lit(self.SPREAD))).cast("int")
        held = state["parts"].get("open", {})
        closed = max((x for x in (state["meta"].get("closed"), closed_before) if x is not None), default=None)
        delta = delta.select(*[f.split()[0] for f in self.SCHEMA.split(", ")])
        added: dict[str, dict[int, str]] = {}
        if closed == state["meta"].get("closed"):  # only the buckets that the batch falls into
            written = self.store.write_split(delta, "new", split)
            if any(str(k) in held for k in written) or closed is not None:
                fresh = written
                touched, delta = set(fresh), self.spark.read.schema(self.SCHEMA).parquet(*fresh.values()) if fresh else delta.limit(0)
                written, added = self._united(delta, sorted(touched), closed, split, splits)
                for at in fresh.values():
                    remove(self.spark, at)
        else:  # closing looks at all that is open
            written, added = self._united(delta, [int(k) for k in held], closed, split, splits)
        self.store.commit(batch_id, {"open": written}, added, {"splits": splits, "closed": closed}, state["version"])

    def _united(self, delta: DataFrame, touched: list[int], closed: int | None, split: Column, splits: int) -> tuple[dict[int, str | None], dict[str, dict[int, str]]]:
        """Write the open buckets ``touched`` with a batch's counts added; (the new folders, what has been closed)."""
        rows = self.store.read("open", self.SCHEMA, touched).unionByName(delta)
        both = rows.groupBy(split.alias("__by"), "key", "period", "round", "value").agg(F.sum("n").alias("n")).drop("__by").filter("n <> 0")
        offset = splits + self.SPREAD
        over = F.lit(False) if closed is None else F.col("period") < closed
        again = self.store.write_split(both, "open", F.when(over, split + offset).otherwise(split))
        open_ = {k: at for k, at in again.items() if k < offset}
        return dict.fromkeys(touched) | open_, {"closed": {k - offset: at for k, at in again.items() if k >= offset}}

    def read(self) -> DataFrame:
        """All counts, open and closed."""
        rows = self.store.read("open", self.SCHEMA)
        if not self.store.folders("closed"):
            return rows
        rows = rows.unionByName(self.store.read("closed", self.SCHEMA))
        return rows.groupBy("key", "period", "round", "value").agg(F.sum("n").alias("n")).filter("n <> 0")


def weighted_median(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """The exact median per key of a multiset given as counts of distinct values (mean of the middle two)."""
    ranked = running_total(counts, keys, [value], n, "__upto")
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__all"))
    at = ranked.join(total, keys)
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2)
    holds = lambda k: (F.col("__upto") >= k) & (F.col("__upto") - F.col(n) < k)
    return at.groupBy(*keys).agg(((F.min(F.when(holds(low), F.col(value))) + F.min(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def issues(counts: DataFrame, rounds: dict[str, int]) -> DataFrame:
    """Aggregates per period as issued with the rounds up to a number, for several such issues at once: n, n_values, n_distinct, lowest, highest and median, each with the issue's name behind.

    A period that has nothing yet in an issue has zeros and nulls there. All
    issues share one ordered pass over the values with a running count for each.
    """
    by, v = ["key", "period"], F.col("value")
    upto = {k: F.coalesce(F.sum(F.when(F.col("round") <= r, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, r in rounds.items()}
    taken = cut(counts.filter(F.col("round") <= max(rounds.values())).groupBy(*by, "value").agg(*upto.values()))
    here = lambda k: F.when(F.col(f"n_{k}") > 0, v)
    plain = taken.groupBy(*by).agg(*[
        x.alias(f"{name}_{k}") for k in rounds for name, x in (
            ("n", F.sum(f"n_{k}")), ("n_values", F.coalesce(F.sum(F.when(v.isNotNull(), F.col(f"n_{k}"))), F.lit(0))), ("n_distinct", F.count(here(k))), ("lowest", F.min(here(k))), ("highest", F.max(here(k))),
        )
    ])
    ordered = cumulate(range_sorted(taken.filter("value is not null"), by, ["value"]), by, ["value"], {f"upto_{k}": F.col(f"n_{k}") for k in rounds})
    at = ordered.join(plain.select(*by, *[F.col(f"n_values_{k}").alias(f"all_{k}") for k in rounds]), by)

    def middle(k: str) -> Column:
        holds = lambda m: (F.col(f"upto_{k}") >= m) & (F.col(f"upto_{k}") - F.col(f"n_{k}") < m)
        low, high = F.floor((F.col(f"all_{k}") + 1) / 2), F.floor((F.col(f"all_{k}") + 2) / 2)
        return (F.min(F.when(holds(low), v)) + F.min(F.when(holds(high), v))) / 2

    return plain.join(at.groupBy(*by).agg(*[middle(k).alias(f"median_{k}") for k in rounds]), by, "left")


def issue(counts: DataFrame, upto: int) -> DataFrame:
    """One issue, of the periods that have something in it: n, n_values, n_distinct, lowest, highest, median."""
    names = ["n", "n_values", "n_distinct", "lowest", "highest", "median"]
    return issues(counts, {"x": upto}).filter("n_x > 0").select("key", "period", *[F.col(f"{c}_x").alias(c) for c in names])


def marks(counts: DataFrame) -> DataFrame:
    """key, period, what: 'corrected' or 'refused', for periods that have such records."""
    what = F.when(F.col("round") == CORRECTION, "corrected").when(F.col("round") == REFUSED, "refused")
    return counts.filter(F.col("round") > IN_TIME).select("key", "period", what.alias("what")).distinct()
