"""Structured Streaming: envelopes to events, lives of touched keys, hourly rollups, corrected periods.

All sinks are foreachBatch steps on versioned tables, so a repeated batch
changes nothing. No event-time watermark is set on these paths: nothing is
dropped as late; what a late record touches is computed again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.late import HOUR_MS, PeriodCounts, value_counts
from tidemark.operators.lives import fold_lives
from tidemark.operators.once import SeenBitmaps
from tidemark.operators.rollup import hourly
from tidemark.operators.store import VersionedStore, split_of, splits_for
from tidemark.session import cut
from tidemark.sources.envelopes import ENVELOPE, order_criteria, parse_envelopes


def read_envelopes(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The landing zone as a stream of event rows."""
    raw = spark.readStream.schema(ENVELOPE + ", dt string, hour string").option("maxFilesPerTrigger", files_per_batch).json(path)
    return parse_envelopes(raw)


class LiveFold:
    """Events in, one life per order out: a batch appends its first deliveries, and only the lives of keys it touches are folded again.

    History and lives lie in buckets by a hash of the order; a batch reads and
    rewrites the buckets its keys fall into. ``clock`` says what time it is at
    every batch, so lives also expire while the fold runs. Lives carry the
    ``method`` they were folded by; ``refold_if_stale`` folds all of them again
    from the history if that has changed, ``replay`` in any case.
    """

    #: Folders of a bucket's history before they are written as one.
    RUNS = 32

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float], method: int = 1, splits: int | None = None):
        self.seen, self.events, self.lives = SeenBitmaps(spark, f"{path}/seen", "run", "seq"), VersionedStore(spark, f"{path}/events"), VersionedStore(spark, f"{path}/lives")
        self.spark, self.clock, self.method = spark, clock, method
        self.splits = splits_for(spark, splits, self.events.state())

    def _split(self) -> Column:
        return split_of(["order_hash"], self.splits)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        name = f"{epoch:012d}"
        if not self.events.done(name):
            once = self.seen.apply(batch, name, ["observed_ts"]).filter("__accepted").select(*batch.columns)
            fresh = self.events.write_split(once, "events", self._split())
            self.events.commit(name, {}, {"events": fresh}, {"splits": self.splits, "fresh": fresh})
            self.seen.expire([name])
        if self.lives.done(name):
            return
        now, fresh = self.clock(), list(self.events.state()["meta"]["fresh"].values())
        old = self.lives.read("lives")
        keys = [] if old is None else [old.filter((F.col("exit_reason") == "censored") & (F.col("expiration_ts") < now)).select("order_hash")]  # what has expired since
        keys += [self.spark.read.parquet(*fresh).select("order_hash").filter("order_hash is not null")] if fresh else []
        if not keys:
            self.lives.commit(name, {}, meta={"method": self.method})
            return
        touched = cut(reduce(DataFrame.unionByName, keys).distinct().withColumn("__by", self._split()))
        splits = [r[0] for r in touched.select("__by").distinct().collect()]  # at most as many as there are buckets
        keys_only = touched.drop("__by")
        lives = fold_lives(self.events.read("events", splits=splits).join(keys_only, "order_hash", "left_semi"), now)
        held = self.lives.read("lives", splits=splits)
        written = self.lives.write_split(lives if held is None else held.join(keys_only, "order_hash", "left_anti").unionByName(lives), "lives", self._split())
        self.lives.commit(name, {"lives": {k: written.get(k) for k in splits}}, meta={"method": self.meta_method()})
        self._tidy()

    def meta_method(self) -> int:
        """The method of the stored lives: an incremental fold doesn't change what the untouched ones were folded by."""
        return self.lives.state()["meta"].get("method", self.method)

    def _tidy(self) -> None:
        many = {int(k): v for k, v in self.events.state()["parts"].get("events", {}).items() if len(v) > self.RUNS}
        if many:
            base = self.events.state()
            one = self.events.write_split(self.events.read("events", splits=list(many)), "events", self._split())
            self.events.commit(base["last"], {"events": one}, base=base["version"])

    def replay(self) -> None:
        """Fold every life again from the history."""
        base = self.lives.state()
        history = self.events.read("events")
        if history is not None:
            written = self.lives.write_split(fold_lives(history, self.clock()), "lives", self._split())
            gone = {int(k): None for k in base["parts"].get("lives", {})}
            self.lives.commit(base["last"] or "replay", {"lives": gone | written}, meta={"method": self.method}, base=base["version"])

    def refold_if_stale(self) -> bool:
        """Fold all lives again if they stem from another method; whether that was so."""
        stale = self.lives.state()["version"] > 0 and self.meta_method() != self.method
        if stale:
            self.replay()
        return stale

    def criteria(self) -> DataFrame | None:
        """The criteria of all offers, derived from the history anew (no state of its own that could be stale)."""
        history = self.events.read("events")
        return None if history is None or "criteria" not in history.columns else order_criteria(history)


class HourlyRollup:
    """n, min and max per collection, hour, maker and type of first deliveries, kept up by merging each batch's own aggregate into the days it touches."""

    KEYS = ["collection", "hour", "maker", "event_type"]
    SPREAD = 4

    def __init__(self, spark: SparkSession, path: str, splits: int | None = None):
        self.seen, self.store = SeenBitmaps(spark, f"{path}/seen", "run", "seq"), VersionedStore(spark, f"{path}/rollup")
        self.splits = splits_for(spark, splits, self.store.state())

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        name = f"{epoch:012d}"
        if self.store.done(name):
            return
        day = F.pmod(F.xxhash64(F.expr("hour div 24")), F.lit(max(1, self.splits // self.SPREAD)))
        split = (day * self.SPREAD + F.pmod(F.xxhash64("collection", "maker"), F.lit(self.SPREAD))).cast("int")
        base = self.store.state()["version"]
        once = self.seen.apply(batch, name, ["observed_ts"]).filter("__accepted")
        delta = cut(hourly(once).withColumn("__by", split))
        touched = [r[0] for r in delta.select("__by").distinct().collect()]  # at most as many as there are buckets
        old, delta = self.store.read("rollup", splits=touched), delta.drop("__by")
        both = delta if old is None else old.unionByName(delta)
        merged = both.groupBy(*self.KEYS).agg(F.sum("n").alias("n"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
        self.store.commit(name, {"rollup": self.store.write_split(merged, "rollup", split)}, meta={"splits": self.splits}, base=base)
        self.seen.expire([name])

    def read(self) -> DataFrame:
        return self.store.read("rollup")


class LatePeriods:
    """Corrected periods from a stream: each message counts once, as its first observed copy says, whichever batch brings that.

    A copy that comes in a later batch but was observed earlier takes the place of
    the one that was counted: its count is taken back. For that the counted copies
    are kept, in buckets; a batch reads those that its repeated messages fall into.
    """

    COPY = "run string, seq bigint, observed_ms bigint, event_ms bigint, collection string, price_eth double"

    def __init__(self, spark: SparkSession, path: str, grace_ms: int, cutoff_ms: int, splits: int | None = None):
        self.seen, self.counts, self.limits = SeenBitmaps(spark, f"{path}/seen", "run", "seq"), PeriodCounts(spark, f"{path}/counts"), (grace_ms, cutoff_ms)
        self.copies, self.spark = VersionedStore(spark, f"{path}/copies"), spark
        self.splits = splits_for(spark, splits, self.copies.state())

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        name = f"{epoch:012d}"
        ms = lambda c: F.floor(F.col(c) * 1000 + 1e-6).cast("bigint")
        if not self.copies.done(name):
            base = self.copies.state()["version"]
            flagged = self.seen.apply(batch, name, ["observed_ts"]).withColumns({"event_ms": ms("valid_ts"), "observed_ms": ms("observed_ts")})
            plain = [f.split()[0] for f in self.COPY.split(", ")]
            first = flagged.filter("__accepted").select(*plain, F.lit(False).alias("back"))
            again = cut(flagged.filter("__seen and __copy = 1").select(*plain, split_of(["run", "seq"], self.splits).alias("__by")))
            touched = [r[0] for r in again.select("__by").distinct().collect()]  # at most as many as there are buckets
            known = self.copies.read("copies", self.COPY, touched)
            kept = known.groupBy("run", "seq").agg(F.min(F.struct("observed_ms", *[c for c in plain if c not in ("run", "seq", "observed_ms")])).alias("k"))
            earlier = again.drop("__by").join(kept, ["run", "seq"]).filter(F.col("observed_ms") < F.col("k.observed_ms"))
            new = earlier.select(*plain, F.lit(False).alias("back"))
            back = earlier.select("run", "seq", *[F.col(f"k.{c}").alias(c) for c in plain[2:]], F.lit(True).alias("back"))
            at = self.copies.folder("change")
            first.unionByName(new).unionByName(back).write.parquet(at)
            change = self.spark.read.parquet(at)
            written = self.copies.write_split(change.filter("not back").drop("back"), "copies", split_of(["run", "seq"], self.splits))
            self.copies.commit(name, {"change": {0: at}}, {"copies": written}, {"splits": self.splits}, base)
            self.seen.expire([name])
        change = self.copies.read("change")
        signed = [value_counts(change.filter(f"back = {b}"), "collection", "event_ms", "observed_ms", "price_eth", *self.limits).withColumn("n", F.col("n") * n) for b, n in (("false", 1), ("true", -1))]
        latest = change.agg(F.max("observed_ms")).first()[0]
        self.counts.merge(signed[0].unionByName(signed[1]).groupBy("key", "period", "round", "value").agg(F.sum("n").alias("n")), name, None if latest is None else int((latest - self.limits[1]) // HOUR_MS))


def start(events: DataFrame, step, checkpoint: str, seconds: float | None = None) -> DataStreamWriter:
    """Run a step on every batch; without ``seconds`` all there is now, then end."""
    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
