"""Overlapping, nested and gapped intervals per entity as continuous periods and the stretches between them.

Global range sort by (entity, start), maximum-end summaries per partition, a
prefix combination of the summaries, and a second scan with the carried
maximum: a row begins a new period iff its start lies after everything that
began before it. A hot entity is spread over as many partitions as its rows
need, and no step holds more than one row per partition and entity beyond that.

Defined cases: rows with a null entity, start or end, or whose end is not after
the start, take no part; touching intervals are one; repeated rows change
nothing; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.ordered import PART, carried, range_sorted


def periods(df: DataFrame, entity: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(continuous periods, stretches between successive ones), each as (entity, from, to)."""
    spans = df.select(F.col(entity).alias("__e"), F.col(start).alias("__s"), F.col(end).alias("__t")).filter("__e is not null and __t > __s")
    # of spans with one start only the longest matters; this also lets the range sort split any group
    spans = spans.groupBy("__e", "__s").agg(F.max("__t").alias("__t"))
    parts = range_sorted(spans, ["__e"], ["__s"])
    here = W.partitionBy("__e", PART).orderBy("__s")
    before = parts.withColumn("__seen", F.max("__t").over(here.rowsBetween(W.unboundedPreceding, -1)))
    known = before.join(carried(parts, ["__e"], F.col("__t"), F.max), ["__e", PART]).withColumn("__seen", F.greatest("__seen", "__carry")).drop("__carry")
    first = F.col("__seen").isNull() | (F.col("__s") > F.col("__seen"))
    label = F.max(F.when(first, F.col("__s"))).over(here.rowsBetween(W.unboundedPreceding, 0))
    marked = known.withColumn("__label", label)
    between = marked.filter("__s > __seen").select(F.col("__e").alias(entity), F.col("__seen").alias("from"), F.col("__s").alias("to"))
    pieces = marked.groupBy("__e", PART, "__label").agg(F.max("__t").alias("__t"))
    opened = carried(pieces, ["__e"], F.col("__label"), F.max)
    whole = pieces.join(opened, ["__e", PART]).withColumn("__label", F.coalesce("__label", "__carry"))
    merged = whole.groupBy(F.col("__e").alias(entity), F.col("__label").alias("from")).agg(F.max("__t").alias("to"))
    return merged, between
