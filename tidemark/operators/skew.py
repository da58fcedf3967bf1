"""Per-key work when a handful of keys holds most rows.

Heavy keys are found by a mergeable frequent-items sketch over one pass, then
the rows split in two: rows of heavy keys are marked by a broadcast join with
the (at most ``MAX_HEAVY``) heavy keys and spread over salts, all other rows
take the ordinary shuffle; the two results are united.

Defined cases: a null key is a key of its own; null measures are ignored, a key
with only null measures gets null (counts get 0); repeated rows all count; an
empty table gives an empty result; columns that aren't named are left out, so
clashing names can't occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Heavy keys at most; with 8-byte key hashes the broadcast side stays under 100 KB whatever the data.
MAX_HEAVY = 1_000
#: Counters of the sketch: an item with more than about rows / SKETCH_ITEMS occurrences can't be missed.
SKETCH_ITEMS = 16_384

_KEY, _SALT = "__key_hash", "__salt"
_MERGE = {"sum": F.sum, "count": F.sum, "rows": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], *[F.col(k).isNull() for k in keys])


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Hashes of the keys that hold at least ``share`` of the rows, MAX_HEAVY at most.

    The hash only routes rows: a light key that collides with a heavy one is
    handled on the heavy side, with the same result. The sketch's counts never
    fall below the true ones, so no heavy key is missed.
    """
    found = df.select(_hash(keys).alias(_KEY)).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({_KEY}, {MAX_HEAVY}, {SKETCH_ITEMS})").alias("top")
    ).first()
    heavy = [x["item"] for x in found["top"] or [] if x["count"] >= max(2.0, share * found["n"])]
    return df.sparkSession.createDataFrame([(h,) for h in heavy], f"{_KEY} bigint")


def split_heavy(df: DataFrame, keys: list[str], share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of heavy keys, rows of the other keys, heavy key hashes); the first two carry the key hash."""
    hashed = df.withColumn(_KEY, _hash(keys))
    heavy = heavy_keys(df, keys, share)
    return hashed.join(F.broadcast(heavy), _KEY, "left_semi"), hashed.join(F.broadcast(heavy), _KEY, "left_anti"), heavy


def _apply(df: DataFrame, by: list[str], aggs: list[tuple[str, str, str | None]], merge: bool) -> DataFrame:
    cols = []
    for name, op, column in aggs:
        if op == "rows" and not merge:
            cols.append(F.count(F.lit(1)).alias(name))
        else:
            cols.append((_MERGE if merge else _FIRST)[op](F.col(name if merge else column)).alias(name))
    return df.groupBy(*by).agg(*cols)


def skew_aggregate(df: DataFrame, keys: list[str], aggs: list[tuple[str, str, str | None]], share: float = 0.01, salts: int = 64) -> DataFrame:
    """Aggregates per key in balanced work.

    ``aggs`` holds (result name, one of sum/count/rows/min/max, column).
    """
    need = list(dict.fromkeys([*keys, *[c for _, _, c in aggs if c]]))
    heavy, light, _ = split_heavy(df.select(*need), keys, share)
    salted = heavy.withColumn(_SALT, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    partial = _apply(salted, [*keys, _SALT], aggs, merge=False)
    return _apply(partial, keys, aggs, merge=True).unionByName(_apply(light, keys, aggs, merge=False))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], share: float = 0.01, max_broadcast: int = 100_000, salts: int = 32) -> DataFrame:
    """Inner join on ``keys`` whose left side is dominated by a few keys.

    The right side's rows of heavy keys are broadcast if they are at most
    ``max_broadcast`` (counted first); otherwise the heavy rows of the left side are
    spread over salts, those of the right side repeated for every salt, and both
    meet by an ordinary shuffle. The other keys meet by an ordinary shuffle
    anyway. Null keys don't join; clashing columns of the right side get ``_right``.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    heavy_left, light_left, heavy = split_heavy(left, keys, share)
    hashed = right.withColumn(_KEY, _hash(keys))
    few = hashed.join(F.broadcast(heavy), _KEY, "left_semi").drop(_KEY)
    light = light_left.drop(_KEY).join(hashed.join(F.broadcast(heavy), _KEY, "left_anti").drop(_KEY), keys)
    if few.limit(max_broadcast + 1).count() <= max_broadcast:
        return heavy_left.drop(_KEY).join(F.broadcast(few), keys).unionByName(light)
    spread = heavy_left.drop(_KEY).withColumn(_SALT, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = few.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [*keys, _SALT]).drop(_SALT).unionByName(light)
