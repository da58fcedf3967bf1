"""Entity, attribute, value rows as one wide typed row per entity.

A log-structured store: each batch becomes a sparse wide delta (one row per
entity, a map from attribute to the state of that cell, every cell with its own
version), written as a run bucketed and sorted by entity. Compaction merges runs
by joins that need no shuffle: per cell the latest version wins, and all values
of that version stay in the state (smallest and largest canonical text, and
whether one was unreadable), so no value is chosen silently.

Defined cases: rows with a null entity column, attribute or an attribute that
isn't declared take no part; a null or empty value is unreadable; repeated rows
change nothing; an empty table gives an empty result; columns that aren't named
are left out. Versions keep their own type and compare as it does: integers (as
bigint), floats (as double, NaN counts as null), decimals, dates, timestamps, or
texts (as text: '9' is later than '10'). Declared attributes that read alike
(blanks, '_', '-' and case) are one; column names that would clash get a '_'. All versions of a store are of one type,
others are refused; a null version, or a batch without one, is older than any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.typed import attribute_key, strip_blanks, typed_text
from tidemark.operators.store import VersionedStore, splits_for

#: Up to so many declared attributes are broadcast to the rows; more are met by a shuffle join.
BROADCAST_ATTRIBUTES = 5_000

#: Types a version may have besides decimals, and how they are kept.
_VERSIONS = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "string": "string"}

_CAST = {"number": "double", "boolean": "boolean", "date": "date", "text": "string"}


def declared(types: DataFrame) -> list[tuple[str, str]]:
    """(attribute, type) of a table of declarations, in order of name: they become columns, so a plan holds them all."""
    rows = types.select("trait_type", "value_type").filter("trait_type is not null").distinct().orderBy("trait_type").collect()
    return [(r[0], r[1]) for r in rows]


def _fold(cells: DataFrame, entity: list[str], splits: int | None = None) -> DataFrame:
    """One row per entity from rows of entity, __attr, __lo, __hi, __bad and perhaps __ver: per cell the latest version, whole.

    Rows are reduced to cells before they meet by entity (in ``splits`` hash partitions), so an entity with very many rows is no hot task.
    """
    by = [*entity, "__attr"]
    state = [F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.max("__bad").alias("__bad")]
    if "__ver" in cells.columns:
        latest = cells.groupBy(*by, "__ver").agg(*state).groupBy(*by).agg(F.max(F.struct("__ver", "__lo", "__hi", "__bad")).alias("__cell"))
    else:
        latest = cells.groupBy(*by).agg(*state).select(*by, F.struct("__lo", "__hi", "__bad").alias("__cell"))
    if splits:
        latest = latest.repartition(splits, *entity)
    return latest.groupBy(*entity).agg(F.map_from_entries(F.collect_list(F.struct("__attr", "__cell"))).alias("cells"))


def _version(rows: DataFrame, version: str) -> Column:
    """The version column in the type it is kept in."""
    kind = dict(rows.select(F.col(version).alias("v")).dtypes)["v"]
    kept = kind if kind.startswith("decimal(") else _VERSIONS.get(kind)
    if kept is None:
        raise ValueError(f"a version can't be of type {kind}")
    c = F.col(version).cast(kept)
    return F.nanvl(c, F.lit(None).cast("double")) if kept == "double" else c


def _one_version_type(runs: list[DataFrame]) -> None:
    """Refuse runs whose versions don't compare; those without versions go with any."""
    cells = [r.schema["cells"].dataType.valueType for r in runs]
    kinds = {c["__ver"].dataType.simpleString() for c in cells if "__ver" in c.names}
    if len(kinds) > 1:
        raise ValueError(f"versions of several types: {', '.join(sorted(kinds))}")


def wide_delta(rows: DataFrame, types: DataFrame, entity: list[str], attribute: str, value: str, version: str | None = None, splits: int | None = None) -> DataFrame:
    """A batch as a sparse wide delta: one row per entity with its map of cells."""
    kinds = types.select(F.col("trait_type").alias("__attr"), F.col("value_type").alias("__kind")).filter("__attr is not null").distinct()
    # names that read alike are one attribute, known by the first spelling
    kinds = kinds.groupBy(attribute_key(F.col("__attr")).alias("__name")).agg(F.min(F.struct("__attr", "__kind")).alias("__k")).select("__name", "__k.*")
    if kinds.limit(BROADCAST_ATTRIBUTES + 1).count() <= BROADCAST_ATTRIBUTES:
        kinds = F.broadcast(kinds)
    ver = [_version(rows, version).alias("__ver")] if version else []
    slim = rows.select(*entity, attribute_key(F.col(attribute)).alias("__name"), strip_blanks(F.col(value)).alias("__value"), *ver)
    named = reduce(lambda d, c: d.filter(F.col(c).isNotNull()), entity, slim).join(kinds, "__name")
    read = named.select(*entity, "__attr", *(["__ver"] if version else []), typed_text(F.col("__value"), F.col("__kind")).alias("__lo"))
    return _fold(read.select("*", F.col("__lo").alias("__hi"), F.col("__lo").isNull().alias("__bad")), entity, splits)


def _merged(a: Column, b: Column, versioned: tuple[bool, bool]) -> Column:
    """The state of one cell from two runs: the later version, or both together where the versions are equal."""
    both = F.struct(
        *([a["__ver"].alias("__ver")] if any(versioned) else []),
        F.least(a["__lo"], b["__lo"]).alias("__lo"), F.greatest(a["__hi"], b["__hi"]).alias("__hi"), (a["__bad"] | b["__bad"]).alias("__bad"),
    )
    if not any(versioned):
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
    va, vb = a["__ver"], b["__ver"]
    first = va.isNull() & vb.isNotNull() | F.coalesce(va < vb, F.lit(False))
    second = vb.isNull() & va.isNotNull() | F.coalesce(vb < va, F.lit(False))
    return F.when(a.isNull(), b).when(b.isNull(), a).when(first, b).when(second, a).otherwise(both)


def compact(runs: list[DataFrame], entity: list[str]) -> DataFrame:
    """Several runs as one, by latest version per cell: a merge of the runs, each sorted by entity, two at a time.

    A run holds one row per entity, so the merge is a full outer join whose sides
    are already partitioned and sorted by entity where both are bucketed runs.
    """
    _one_version_type(runs)
    kinds = [r.schema["cells"].dataType for r in runs]
    with_version = next((k for k in kinds if "__ver" in k.valueType.names), None)
    if with_version is not None:  # a run without versions is older than any
        runs = [r if "__ver" in k.valueType.names else r.withColumn("cells", F.transform_values("cells", lambda _, c: F.struct(F.lit(None).cast(with_version.valueType["__ver"].dataType).alias("__ver"), c["__lo"].alias("__lo"), c["__hi"].alias("__hi"), c["__bad"].alias("__bad")))) for r, k in zip(runs, kinds)]
    empty = F.map_filter("cells", lambda k, v: F.lit(False))
    while len(runs) > 1:
        pairs = []
        for a, b in zip(runs[::2], runs[1::2]):
            left, right = a.withColumnRenamed("cells", "__a"), b.withColumnRenamed("cells", "__b")
            both = left.hint("merge").join(right, entity, "full")
            cells = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull(), F.col("__b")).otherwise(F.map_zip_with("__a", "__b", lambda k, x, y: _merged(x, y, (with_version is not None,) * 2)))
            pairs.append(both.select(*entity, cells.alias("cells")))
        runs = pairs + (runs[-1:] if len(runs) % 2 else [])
    return runs[0]


class WideStore:
    """Runs of an entity-attribute-value log; a batch is one upsert, compaction keeps the number of runs low.

    Runs are bucketed and sorted by entity, so that merging them takes no
    shuffle. They have levels: a batch is a run of level 0, and where a level has
    more than ``fan_out`` runs these become one of the next, so a cell is written
    again a logarithmic number of times. A store keeps the number of buckets it
    began with.
    """

    def __init__(self, spark: SparkSession, path: str, types: DataFrame, entity: list[str], fan_out: int = 4, splits: int | None = None):
        self.store, self.types, self.entity, self.fan_out, self.spark, self.splits = VersionedStore(spark, path), types, entity, fan_out, spark, splits

    def upsert(self, rows: DataFrame, batch_id: str, attribute: str, value: str, version: str | None = None) -> None:
        if self.store.done(batch_id):
            return
        splits = splits_for(self.spark, self.splits, self.store.state())
        delta = wide_delta(rows, self.types, self.entity, attribute, value, version, splits)
        if version:  # a batch of another version type mustn't get into the store
            _one_version_type([*self._read_runs(), delta])
        base = self.store.state()["version"]
        self.store.commit(batch_id, {}, {"runs:0": {0: self._write(delta, splits)}}, {"splits": splits}, base)
        level = 0
        while len(self._runs(level)) > self.fan_out:
            self.compact(level)
            level += 1

    def compact(self, level: int | None = None) -> None:
        """Make the runs of a level (or all) one run of the next level."""
        levels = self._levels() if level is None else [level]
        old = [r for n in levels for r in self._runs(n)]
        if len(old) < 2:
            return
        state = self.store.state()
        at = self._write(compact([self._read(r) for r in old], self.entity), state["meta"]["splits"])
        to = f"runs:{max(levels) + 1}"
        self.store.commit(f"compaction-{state['version']}", {f"runs:{n}": {0: None} for n in levels}, {to: {0: at}}, base=state["version"])

    def read(self) -> DataFrame:
        """One row per entity with its map of cells."""
        return compact(self._read_runs(), self.entity)

    def _levels(self) -> list[int]:
        return sorted(int(x.split(":")[1]) for x, part in self.store.state()["parts"].items() if part)

    def _runs(self, level: int | None = None) -> list[str]:
        return [f for n in (self._levels() if level is None else [level]) for f in self.store.folders(f"runs:{n}")]

    def _read_runs(self) -> list[DataFrame]:
        return [self._read(r) for r in self._runs()]

    def _write(self, wide: DataFrame, splits: int) -> str:
        at = self.store.folder("run")
        name = f"tidemark_{at.rsplit('-', 1)[1]}"
        wide.write.bucketBy(splits, *self.entity).sortBy(*self.entity).option("path", at).format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # only the catalog's entry: the files are the store's
        return at

    def _read(self, at: str) -> DataFrame:
        """A run as a bucketed table of this session, so that joins know how it lies."""
        name = f"tidemark_{at.rsplit('-', 1)[1]}"
        schema = self.spark.read.parquet(at).schema
        by = ", ".join(f"`{e}`" for e in self.entity)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        splits = splits_for(self.spark, self.splits, self.store.state())
        self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {splits} BUCKETS LOCATION '{at}'")
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the frame knows its files; the catalog keeps nothing
        return run


def _single(cell: Column) -> Column:
    return ~cell["__bad"] & (cell["__lo"] == cell["__hi"])


def wide_table(wide: DataFrame, attributes: list[tuple[str, str]], entity: list[str]) -> DataFrame:
    """Typed columns, one per attribute; null where a cell is absent or has no single value. ``unclear`` names the latter, sorted."""
    cols, taken = [], {*(e.lower() for e in entity), "cells", "unclear"}
    for name, kind in attributes:
        cell = F.col("cells")[name]
        out = name.lower().replace(" ", "_").replace("-", "_")
        while out in taken:
            out += "_"
        taken.add(out)
        cols.append(F.when(_single(cell), cell["__lo"].try_cast(_CAST[kind])).alias(out))
    unclear = F.array_join(F.array_sort(F.map_keys(F.map_filter("cells", lambda _, c: ~_single(c)))), "|")
    return wide.select(*entity, *cols, unclear.alias("unclear"))


def unclear_cells(wide: DataFrame, entity: list[str], attribute: str) -> DataFrame:
    """Cells that have rows but no single typed value."""
    cells = wide.select(*entity, F.explode("cells").alias(attribute, "__cell"))
    return cells.filter(~_single(F.col("__cell"))).select(*entity, attribute)
