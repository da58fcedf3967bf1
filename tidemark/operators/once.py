"""Exactly one copy of every message that was delivered at least once.

An identifier is (text, long). Its text part is dictionary-encoded exactly, its
long part is a position in a bitmap; bitmaps are cut into shards of 32,768
positions, kept in compressed Parquet in hash buckets, and hold the identifiers
seen so far. A batch meets the shards it touches, one arrival of every unseen bit
is selected, and the new bits are united with the old ones of the buckets they
fall into, in one atomic commit together with the batch's own result; the
dictionary only grows by the new texts. Applying a batch a second time returns
its first result, until ``expire`` gives it up.

Defined cases: rows whose identifier is null in either part have no identity
and are all accepted; of copies that tie in every order column any one is
accepted (they are equal in what decides); an empty batch changes nothing;
further columns pass through untouched unless they begin with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators.store import VersionedStore, split_of, splits_for
from tidemark.session import remove

#: A dictionary of at most this many rows is broadcast (about 100 bytes each); a larger one is joined by shuffle, where
#: adaptive execution splits the rows of a text that holds many of them. The result is the same.
MAX_BROADCAST_CODES = 50_000

ACCEPTED, SEEN, COPY = "__accepted", "__seen", "__copy"


def _bit(bits: Column, pos: Column) -> Column:
    """Whether the bit at ``pos`` is set in a bitmap made by bitmap_construct_agg."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(pos / F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(pos, F.lit(8)).cast("int")) == 1


class SeenBitmaps:
    """The identifiers seen so far, and the batches they came with."""

    CODES, BITS = "__text string, __gen int, __code bigint", "__gen int, __code bigint, __bucket bigint, __bits binary"
    SHARD = ["__gen", "__code", "__bucket"]

    def __init__(self, spark: SparkSession, path: str, text_id: str, long_id: str, splits: int | None = None):
        """``splits``: buckets of the bitmaps; a batch rewrites those that its shards fall into. As many as shuffle partitions if not given; a store keeps the number it began with."""
        self.store, self.spark, self.text_id, self.long_id, self.splits = VersionedStore(spark, path), spark, text_id, long_id, splits

    def _dictionary(self, batch: DataFrame, state: dict) -> tuple[DataFrame, dict[int, str], int]:
        """(dictionary with the batch's new texts, the folder of these, number of texts); a code is a generation and a number within it, and never changes."""
        old = self.store.read("codes", self.CODES)
        texts = batch.select(F.col(self.text_id).alias("__text")).filter("__text is not null").distinct()
        new = texts.join(old, "__text", "left_anti") if state["parts"] else texts
        at = self.store.folder("codes")
        new.select("__text", F.lit(state["version"]).alias("__gen"), F.monotonically_increasing_id().alias("__code")).write.parquet(at)
        added = self.spark.read.schema(self.CODES).parquet(at)
        n = added.count()
        return (old.unionByName(added) if state["parts"] else added), ({0: at} if n else {}), state["meta"].get("codes", 0) + n

    def apply(self, batch: DataFrame, batch_id: str, order: list[str]) -> DataFrame:
        """The batch's rows with flags: __seen (an earlier batch has it), __copy (rank in this batch), __accepted."""
        if self.store.done(batch_id):
            return self.spark.read.parquet(*self._result(batch_id))
        state = self.store.state()
        splits = splits_for(self.spark, self.splits, state)
        codes, new_codes, n_codes = self._dictionary(batch, state)
        if n_codes <= MAX_BROADCAST_CODES:
            codes = F.broadcast(codes)
        keyed = batch.withColumn("__text", F.when(F.col(self.long_id).isNotNull(), F.col(self.text_id))).join(codes, "__text", "left").drop("__text")
        known = keyed.filter("__code is not null").withColumns({"__bucket": F.bitmap_bucket_number(self.long_id), "__pos": F.bitmap_bit_position(self.long_id)})
        bits = self.store.read("bits", self.BITS)
        if state["parts"].get("bits"):
            marked = known.join(bits, self.SHARD, "left").withColumn(SEEN, F.coalesce(_bit(F.col("__bits"), F.col("__pos")), F.lit(False))).drop("__bits")
        else:
            marked = known.withColumn(SEEN, F.lit(False))
        one = W.partitionBy(*self.SHARD, "__pos").orderBy(*order)
        ranked = marked.withColumn(COPY, F.row_number().over(one)).withColumn(ACCEPTED, ~F.col(SEEN) & (F.col(COPY) == 1))
        nameless = keyed.filter("__code is null").withColumns({"__bucket": F.lit(None).cast("bigint"), "__pos": F.lit(None).cast("bigint"), SEEN: F.lit(False), COPY: F.lit(1), ACCEPTED: F.lit(True)})
        result_at = self.store.folder("result")
        flagged = ranked.unionByName(nameless)
        flagged.write.parquet(result_at)
        result = self.spark.read.schema(flagged.schema).parquet(result_at)
        # new bits by bucket; only the buckets they fall into are written again, united with what they held
        fresh = result.filter(f"{ACCEPTED} and __code is not null").groupBy(*self.SHARD).agg(F.bitmap_construct_agg("__pos").alias("__bits"))
        split = split_of(self.SHARD, splits)
        written = self.store.write_split(fresh, "new", split)
        if any(state["parts"].get("bits", {}).get(str(k)) for k in written):
            held = self.store.read("bits", self.BITS, list(written)).unionByName(self.spark.read.schema(self.BITS).parquet(*written.values()))
            united = self.store.write_split(held.groupBy(*self.SHARD).agg(F.bitmap_or_agg("__bits").alias("__bits")), "bits", split)
            for at in written.values():
                remove(self.spark, at)
            written = united
        self.store.commit(batch_id, {"bits": written}, {"codes": new_codes, f"result:{batch_id}": {0: result_at}}, {"codes": n_codes, "splits": splits}, state["version"])
        return result

    def _result(self, batch_id: str) -> list[str]:
        found = self.store.folders(f"result:{batch_id}")
        if not found:
            raise ValueError(f"the result of batch {batch_id} was given up")
        return found

    def expire(self, keep: list[str]) -> None:
        """Give up the results of all batches but some; what was seen stays."""
        for name in self.store.state()["parts"]:
            if name.startswith("result:") and name.removeprefix("result:") not in keep:
                self.store.forget(name)

    def seen_count(self) -> int:
        """Identifiers seen so far."""
        bits = self.store.read("bits", self.BITS)
        return bits.agg(F.sum(F.bitmap_count("__bits"))).first()[0] or 0


def arrival_edges(df: DataFrame, column: str, n: int) -> list:
    """The n - 1 inner borders of ``n`` equal spans of a number; none of an empty table."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    return [] if lo is None else [lo + (hi - lo) * i / n for i in range(1, n)]


def arrival_batches(df: DataFrame, column: str, edges: list) -> list[DataFrame]:
    """The rows in batches between borders of a number, in order; rows without it come last."""
    if not edges:
        return [df]
    c = F.col(column)
    return [df.filter(x) for x in ([c < edges[0]] + [(c >= a) & (c < b) for a, b in zip(edges, edges[1:])] + [(c >= edges[-1]) | c.isNull()])]


def deliver_once(df: DataFrame, path: str, text_id: str, long_id: str, order: list[str], batches: list[DataFrame] | None = None) -> DataFrame:
    """All rows with their flags, after applying the batches one by one."""
    seen = SeenBitmaps(df.sparkSession, path, text_id, long_id)
    parts = [seen.apply(b, f"{i:06d}", order) for i, b in enumerate(batches or [df])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
