"""Running values in a global order, without putting a key into one task.

Rows are range-sorted by key and order, so a key with many rows covers many
partitions. Each partition is scanned for itself; per-partition summaries of
every key are combined over the partitions (at most one row per partition and
key), and the partitions are scanned again with what the earlier ones carry in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import cut

PART = "__part"


def range_sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows range-partitioned by key and order, with their partition number, in stable storage."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


def carried(parts: DataFrame, keys: list[str], value: Column, combine) -> DataFrame:
    """Per partition and key: ``combine`` (F.max, F.sum ...) of ``value`` over all earlier partitions of the key, as __carry."""
    summary = parts.groupBy(*keys, PART).agg(combine(value).alias("__summary"))
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return summary.select(*keys, PART, combine("__summary").over(before).alias("__carry"))


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """Each row with the sum of ``weight`` over its key's rows up to it; (keys, order) must be unique and without nulls in keys."""
    parts = range_sorted(df, keys, order)
    local = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = parts.withColumn("__local", F.sum(weight).over(local))
    both = here.join(carried(parts, keys, F.col(weight), F.sum), [*keys, PART])
    return both.withColumn(name, F.col("__local") + F.coalesce("__carry", F.lit(0))).drop("__local", "__carry", PART)


def cumulate(parts: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Range-sorted rows with several running sums, each including its own row; the partition number stays for further ones."""
    local = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = parts.withColumns({f"__w_{n}": c for n, c in sums.items()})
    here = here.withColumns({f"__l_{n}": F.sum(f"__w_{n}").over(local) for n in sums})
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    summary = here.groupBy(*keys, PART).agg(*[F.sum(f"__w_{n}").alias(f"__s_{n}") for n in sums])
    carry = summary.select(*keys, PART, *[F.sum(f"__s_{n}").over(before).alias(f"__c_{n}") for n in sums])
    both = here.join(carry, [*keys, PART])
    both = both.withColumns({n: F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums})
    return both.drop(*[f"__{x}_{n}" for x in "wlc" for n in sums])
