"""The landing zone: envelopes in compressed JSON lines by arrival day and hour, with a manifest that is checked and used for pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.times import instant_us
from tidemark.sources.envelopes import CONTROL, ENVELOPE


#: Bytes of envelope text in one task of a busy hour, and in one file.
TASK_BYTES, FILE_ROWS = 256 << 20, 250_000


def write_landing(envelopes: DataFrame, path: str, codec: str = "gzip", max_rows: int = FILE_ROWS) -> None:
    """Append envelopes below dt=/hour= of their arrival; a busy hour is written by as many tasks as its size asks for, files roll after ``max_rows``."""
    at = F.timestamp_micros(instant_us(F.col("_recv")))
    rows = envelopes.withColumns({"dt": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})
    sizes = rows.groupBy("dt", "hour").agg(F.ceil(F.sum(F.length("raw")) / F.lit(TASK_BYTES)).cast("int").alias("__tasks"))  # a row per hour
    key = F.concat_ws("T", F.coalesce("dt", F.lit("")), F.coalesce("hour", F.lit("")))
    placed = rows.withColumn("__hour", key).join(sizes.select(key.alias("__hour"), "__tasks"), "__hour")
    spread = F.pmod(F.xxhash64("_run", "_seq"), F.greatest(F.col("__tasks"), F.lit(1)))
    placed.repartition("dt", "hour", spread).drop("__tasks", "__hour").write.mode("append").partitionBy("dt", "hour").option("compression", codec).option("maxRecordsPerFile", max_rows).json(path)


def read_landing(spark: SparkSession, path: str, tolerant: bool = True, files: list[str] | None = None) -> DataFrame:
    """All envelopes with dt, hour and their file. Tolerant: broken lines and what lies behind the damage of a file are left out, lines before it count; otherwise either ends the job."""
    fields = ENVELOPE + ", dt string, hour string, _corrupt string"
    if not tolerant:
        reader = spark.read.schema(fields).option("mode", "FAILFAST").option("columnNameOfCorruptRecord", "_corrupt").option("basePath", path)
        return reader.json(files or path).withColumn("file", F.col("_metadata.file_path")).drop("_corrupt")
    # lines reach the parser one by one, so a file that breaks off gives all complete lines before its end
    lines = spark.read.option("basePath", path).option("ignoreCorruptFiles", "true").text(files or path).withColumn("file", F.col("_metadata.file_path"))
    read = lines.withColumn("e", F.from_json("value", ENVELOPE)).filter("e._seq is not null")
    day, hour = (F.col(c).cast("string") if c in lines.columns else F.lit(None).cast("string") for c in ("dt", "hour"))
    return read.select("e.*", day.alias("dt"), F.lpad(hour, 2, "0").alias("hour"), "file")


class TornFile:
    """Whether a compressed file breaks off or is damaged, told from its pieces without keeping them."""

    def __init__(self, name: str):
        self.kind = "gz" if name.endswith(".gz") else "zst" if name.endswith((".zst", ".zstd")) else ""
        self.bad, self.open, self.unpack = False, False, None

    def _new(self):
        if self.kind == "gz":
            import zlib

            return zlib.decompressobj(31)
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()

    def feed(self, piece: bytes) -> None:
        while piece and self.kind and not self.bad:
            self.unpack = self.unpack or self._new()
            self.open = True
            try:
                self.unpack.decompress(piece)
            except Exception:  # noqa: BLE001 - every codec raises its own type, and any of them is damage
                self.bad = True
                return
            piece = b""
            if self.unpack.eof:  # the next member or frame begins in what is left
                piece, self.unpack, self.open = self.unpack.unused_data, None, False

    def torn(self) -> bool:
        return self.bad or self.open


def open_stream(path: str):
    """A file of the shared file system as a Python stream, on an executor."""
    from pyarrow import fs as pafs

    where = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
    at, inner = pafs.FileSystem.from_uri(where)
    return at.open_input_stream(inner, compression=None)


def landing_roots(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Several redundant connections' landing zones, each row with its connection label."""
    out = None
    for label, path in roots.items():
        one = read_landing(spark, path).withColumn("conn", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def manifest(rows: DataFrame) -> DataFrame:
    """Per file: counts and the span of event times, as read."""
    control = F.col("_topic") == CONTROL
    ets = instant_us(F.col("_ets"))
    return rows.groupBy("file").agg(
        F.count_if(~F.coalesce(control, F.lit(False))).alias("events"), F.count_if(control).alias("controls"), F.min(ets).alias("first_us"), F.max(ets).alias("last_us"), F.min("_seq").alias("first_seq"), F.max("_seq").alias("last_seq")
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per file on disk: SHA-256, length, and whether it breaks off. Files are hashed where they lie, in pieces, whatever their size."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(path).select("path")
    n = spark.sparkContext.defaultParallelism

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            out = []
            for name in batch["path"]:
                digest, size, whole = hashlib.sha256(), 0, TornFile(name)
                with open_stream(name) as f:
                    while piece := f.read(1 << 22):
                        digest.update(piece)
                        size += len(piece)
                        whole.feed(piece)
                out.append((name, digest.hexdigest(), size, whole.torn()))
            yield pd.DataFrame(out, columns=["file", "sha256", "bytes", "torn"])

    return listed.repartition(n).mapInPandas(scan, "file string, sha256 string, bytes bigint, torn boolean")


def verify_manifest(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """What differs between a recorded manifest (file, events, controls, sha256, closed) and the disk: file, problem."""
    disk = checksums(spark, path).withColumnRenamed("sha256", "__sha")
    found = manifest(read_landing(spark, path)).select("file", F.col("events").alias("__events"), F.col("controls").alias("__controls"))
    both = recorded.select("file", "events", "controls", "sha256", "closed").join(disk, "file", "full").join(found, "file", "left")
    problem = (
        F.when(F.col("bytes").isNull(), "MISSING").when(F.col("sha256").isNull() & F.col("closed").isNull(), "ORPHAN").when(~F.col("closed"), "OPEN")
        .when(F.col("torn"), "UNREADABLE").when(F.col("sha256") != F.col("__sha"), "CHECKSUM MISMATCH").when(F.col("__events").isNull() & (F.col("events") + F.col("controls") > 0), "UNREADABLE")
        .when((F.col("events") != F.coalesce("__events", F.lit(0))) | (F.col("controls") != F.coalesce("__controls", F.lit(0))), "COUNT MISMATCH")
    )
    return both.select("file", problem.alias("problem")).filter("problem is not null")


def files_for_event_range(recorded: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Files that can hold events of [start, end): an unknown span is kept, files of control frames only are skipped."""
    return recorded.filter("events > 0").filter((F.col("first_us").isNull() | (F.col("first_us") < end_us)) & (F.col("last_us").isNull() | (F.col("last_us") >= start_us))).select("file")
