"""The N highest-scoring rows of every group, skipping what statistics rule out.

Layout: files clustered by group. The rows of a group lie in one file (those of
a group that holds a large share of all rows are spread over several by a hash
of the tie key), and a file's rows are ordered by tier, then group, then score
from high to low; the tier grows with the logarithm of a row's rank in its group
and file, so the head of every group lies in the first row groups, however many
groups share one. Statistics: for every row group and every group in it the
number of rows, and the lowest and highest score.

Reading: statistics give each group a score that N of its rows surely reach; a
row group is opened only if it may hold, for at least one of its groups, a score
not strictly below that. Those are read file by file in descending maximum
score, and one that lies strictly below the current N-th score of every group
it contains is skipped as well. What is left is at most N rows a group and file,
ranked once more.

Defined cases: rows with a null group column or a null or NaN score take no
part; equal scores are ordered by the tie key from low to high, a null tie key
first; rows equal in all of these are ranked one after the other; an empty
table gives an empty result; columns that aren't named are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.operators.skew import heavy_keys
from tidemark.session import work_folder

#: Rows of a row group in the clustered layout; small, so that skipping is fine-grained.
ROW_GROUP = 20_000
#: Rank at which the second tier begins, and the factor from there on.
HEAD, STEP = 16, 8
#: A group is spread over all shuffle partitions once it holds this many times the rows of an even partition, or this share of
#: all rows, whichever is less.
HEAVY_TIMES, HEAVY_SHARE = 0.5, 0.02
#: The sketch of 1,000 heavy keys can't tell smaller shares; a group below it is sorted in one task, which spills.
MIN_SHARE = 0.001


def _groups(df: DataFrame, groups: list[str]) -> Column:
    return F.xxhash64(*[F.col(g) for g in groups], *[F.col(g).isNull() for g in groups])


def cluster(df: DataFrame, groups: list[str], score: str, tie: str, path: str) -> None:
    """Write the rows that can be ranked, clustered by group."""
    rows = df.select(*groups, score, tie).filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = reduce(lambda d, g: d.filter(F.col(g).isNotNull()), groups, rows)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # at most skew.MAX_HEAVY hashes; the sketch sees all rows
    heavy = F.broadcast(heavy_keys(rows, groups, max(MIN_SHARE, min(HEAVY_SHARE, HEAVY_TIMES / parts))).withColumn("__heavy", F.lit(True)))
    marked = rows.withColumn("__key_hash", _groups(rows, groups)).join(heavy, "__key_hash", "left")
    salt = F.when(F.col("__heavy"), F.pmod(F.xxhash64(tie, score), F.lit(parts))).otherwise(0)
    place = [*groups, "__salt"]
    # the rows a group brings more than once over many files are only ordered within their file, by a window that streams
    rank = F.row_number().over(W.partitionBy(*place).orderBy(F.col(score).desc(), F.col(tie).asc()))
    tier = F.when(F.col("__rank") <= HEAD, 0).otherwise(1 + F.floor(F.log(float(STEP), (F.col("__rank") - 1) / HEAD))).cast("int")
    ranked = marked.withColumn("__salt", salt.cast("int")).withColumn("__rank", rank).withColumn("__tier", tier)
    placed = ranked.sortWithinPartitions("__tier", *groups, F.col(score).desc(), F.col(tie).asc()).select(*groups, score, tie)
    placed.write.mode("overwrite").option("parquet.block.row.count.limit", ROW_GROUP).option("parquet.bloom.filter.enabled", "false").parquet(path)


def statistics(spark: SparkSession, path: str, groups: list[str], score: str) -> DataFrame:
    """One row per row group and group in it: file, row_group, the group columns, n, lo and hi of the score."""
    rows = spark.read.parquet(path).select(*groups, F.col(score).alias("__s"), F.col("_metadata.file_path").alias("file"), F.expr(f"cast(_metadata.row_index div {ROW_GROUP} as int)").alias("row_group"))
    return rows.groupBy("file", "row_group", *groups).agg(F.count(F.lit(1)).alias("n"), F.min("__s").alias("lo"), F.max("__s").alias("hi"))


def kept_row_groups(stats: DataFrame, groups: list[str], n: int) -> DataFrame:
    """What statistics can't rule out: the rows of ``stats`` whose group may still have one of its N highest scores there.

    A group's floor is the highest score that N of its rows reach for sure. Its
    N row groups of the highest lowest scores are enough to know it, so a group
    of any size sends at most N rows a task over the network.
    """
    down = W.partitionBy(*groups).orderBy(F.desc("lo"), "file", "row_group")
    best = stats.withColumn("__k", F.row_number().over(down)).filter(F.col("__k") <= n)
    reached = best.withColumn("__rows", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("__rows") >= n)
    floor = reached.groupBy(*groups).agg(F.max("lo").alias("__floor"))
    return stats.join(floor.hint("merge"), groups, "left").filter("__floor is null or hi >= __floor").drop("__floor")


def _open(path: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    # the same store under the name it has in Arrow
    for here, there in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        if path.startswith(here):
            path = there + path.removeprefix(here)
    fs, inner = pafs.FileSystem.from_uri(path)
    return pq.ParquetFile(inner, filesystem=fs)


class _Heads:
    """At most N rows of every group of a file, merged when as many new rows have come as there are old ones."""

    def __init__(self, groups: list[str], score: str, tie: str, n: int):
        self.groups, self.score, self.tie, self.n = groups, score, tie, n
        self.best: pd.DataFrame | None = None
        self.new: list[pd.DataFrame] = []
        self.pending = 0
        self.nth: dict[tuple, float] = {}

    def _head(self, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values([self.score, self.tie], ascending=[False, True], kind="stable", na_position="first")
        return ordered.groupby(self.groups, sort=False).head(self.n)

    def add(self, rows: pd.DataFrame) -> None:
        head = self._head(rows)
        self.new.append(head)
        self.pending += len(head)
        if self.best is None or self.pending >= len(self.best):
            self.merge()

    def merge(self) -> None:
        if self.new:
            self.best = self._head(pd.concat([x for x in (self.best, *self.new) if x is not None]))
            self.new, self.pending = [], 0
            by = self.best.groupby(self.groups, sort=False)[self.score]
            full = by.size() >= self.n
            low = by.min()[full]
            self.nth = {k if isinstance(k, tuple) else (k,): v for k, v in low.items()}

    def below(self, names: list[tuple], hi: np.ndarray) -> bool:
        """Whether every group lies strictly below its current N-th score."""
        return all((at := self.nth.get(k)) is not None and h < at for k, h in zip(names, hi))


def top_n(spark: SparkSession, path: str, groups: list[str], score: str, tie: str, n: int) -> DataFrame:
    """Group columns, score, tie key and rank (1..n) of a clustered layout."""
    kept = kept_row_groups(statistics(spark, path, groups, score), groups, n)
    # of each row group that is opened its maximum, and the groups it is opened for: at most ROW_GROUP of them
    work = kept.groupBy("file", "row_group").agg(F.max("hi").alias("top"), F.collect_list(F.struct(*groups, "hi")).alias("held"))
    schema = spark.read.parquet(path).schema
    columns, types = [*groups, score, tie], {f.name: f.dataType for f in schema}
    types = T.StructType([T.StructField(c, types[c]) for c in [*groups, score, tie]])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, file, heads = None, None, None
        for batch in batches:
            for name, k, held in zip(batch["file"], batch["row_group"], batch["held"]):
                if name != at:
                    if heads is not None:
                        heads.merge()
                        yield heads.best[columns]
                        file.close()
                    at, file, heads = name, _open(name), _Heads(groups, score, tie, n)
                if heads.best is not None and heads.below([tuple(h[g] for g in groups) for h in held], [h["hi"] for h in held]):
                    continue
                heads.add(file.read_row_group(k, columns=columns).to_pandas())
        if heads is not None:
            heads.merge()
            yield heads.best[columns]
            file.close()

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = work.repartition(tasks, "file").sortWithinPartitions("file", F.desc("top")).mapInPandas(read, types)
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(tie).asc()))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= n)


def clustered(df: DataFrame, groups: list[str], score: str, tie: str) -> str:
    """Where the rows lie clustered: a layout for this session, written once."""
    path = work_folder(df.sparkSession, "clustered")
    cluster(df, groups, score, tie, path)
    return path
