"""A versioned, hash-partitioned table in the shared folder that changes in one atomic step.

A part of the store is cut into a fixed number of buckets by a hash of its key;
a commit replaces or extends the buckets it touches and leaves the others where
they are. Versions are a log of small files, ``_log/<version>``: a commit writes
its new folders first and then adds the next file of the log by a rename that
fails if that file is there, so of two writers that began from one version only
one goes through (the other gets ``Conflict``) and a reader sees the old or the
new version, never a mixture. On an object store without such a rename a single
writer is assumed. A batch that was committed already isn't applied again.
Folders that a commit gives up are deleted two commits later, so what was read
from the version before stays readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import add_text, list_names, read_text, remove

#: Versions whose folders stay after they were given up, and log files that stay behind the newest.
KEEP = 2
SPLIT = "__split"


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


def split_of(keys: list[str], n: int) -> Column:
    """The bucket of a row, by a hash of its key."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")


def splits_for(spark: SparkSession, given: int | None, state: dict) -> int:
    """Buckets of a store: as many as it began with, else the given number, else the session's shuffle partitions."""
    return state["meta"].get("splits") or given or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def state(self) -> dict:
        """{"version", "last": id of the last batch, "parts": {part: {bucket: [folders]}}, "gone": [[version, folder]], "meta": {}}."""
        versions = sorted(x for x in list_names(self.spark, f"{self.path}/_log") if x.isdigit())
        if not versions:
            return {"version": 0, "last": None, "parts": {}, "gone": [], "meta": {}}
        return json.loads(read_text(self.spark, f"{self.path}/_log/{versions[-1]}"))

    def folder(self, name: str) -> str:
        """A new folder for the part ``name``; it counts once it is committed."""
        return f"{self.path}/data/{name}-{uuid.uuid4().hex}"

    def folders(self, name: str, splits: list[int] | None = None) -> list[str]:
        part = self.state()["parts"].get(name, {})
        return [f for k, fs in part.items() if splits is None or int(k) in splits for f in fs]

    def read(self, name: str, schema: str | None = None, splits: list[int] | None = None) -> DataFrame | None:
        """A part, or some of its buckets, as of the last commit; empty (with a schema) or None if there is nothing."""
        folders = self.folders(name, splits)
        if folders:  # a given schema saves the job that reads one from the files
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*folders)
        return self.spark.createDataFrame([], schema) if schema else None

    def write_split(self, df: DataFrame, name: str, split: Column) -> dict[int, str]:
        """Write rows by bucket, one task a bucket; gives the folder of each bucket that has any."""
        at = self.folder(name)
        df.withColumn(SPLIT, split).repartition(SPLIT).write.partitionBy(SPLIT).option("compression", "zstd").parquet(at)
        return {int(x.split("=")[1]): f"{at}/{x}" for x in list_names(self.spark, at) if x.startswith(f"{SPLIT}=")}

    def done(self, batch_id: str) -> bool:
        return self.state()["last"] == batch_id or read_text(self.spark, f"{self.path}/_batches/{batch_id}") is not None

    def commit(self, batch_id: str, replaced: dict[str, dict[int, str | None]], added: dict[str, dict[int, str]] | None = None, meta: dict | None = None, base: int | None = None) -> None:
        """Make written folders current: ``replaced`` buckets give up their former folders (None: for nothing), ``added`` ones keep them.

        ``base`` is the version the new content was made from, by default the present one.
        """
        s = self.state()
        if base is not None and s["version"] != base:
            raise Conflict(f"version {s['version']} is in force, not {base}")
        if s["last"] is not None:  # what is done stays known by a file for each batch, however many there are
            add_text(self.spark, f"{self.path}/_batches/{s['last']}", "", over=True)
        s["version"] += 1
        s["last"] = batch_id
        s["meta"] |= meta or {}
        for name, buckets in replaced.items():
            part = s["parts"].setdefault(name, {})
            for k, at in buckets.items():
                s["gone"] += [[s["version"], f] for f in part.pop(str(k), [])]
                if at is not None:
                    part[str(k)] = [at]
        for name, buckets in (added or {}).items():
            part = s["parts"].setdefault(name, {})
            for k, at in buckets.items():
                part.setdefault(str(k), []).append(at)
        due = [f for v, f in s["gone"] if v <= s["version"] - KEEP]
        s["gone"] = [x for x in s["gone"] if x[0] > s["version"] - KEEP]
        if not add_text(self.spark, f"{self.path}/_log/{s['version']:012d}", json.dumps(s)):
            raise Conflict(f"version {s['version']} was committed by another writer")
        for f in due:
            remove(self.spark, f)
        if s["version"] > KEEP:
            remove(self.spark, f"{self.path}/_log/{s['version'] - KEEP:012d}")

    def forget(self, name: str) -> None:
        """Give up a whole part that nobody will ask for again."""
        s = self.state()
        if name in s["parts"]:
            self.commit(f"{s['last']}", {name: {int(k): None for k in s["parts"][name]}})
