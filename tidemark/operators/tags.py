"""Entities filtered, compared and summarised by their attribute-value tags.

``tags`` has an entity (collection, token_id) and rows of (trait_type, value);
several values of one attribute and repeated rows are allowed. A filter maps an
attribute to its allowed values: AND across attributes, OR within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Filter = dict[str, list[str]]
TOKEN = ["collection", "token_id"]


def parse_filter(text: str) -> Filter:
    """'A:x|y;B:z' as a filter."""
    out: Filter = {}
    for clause in filter(None, (c.strip() for c in text.split(";"))):
        name, _, values = clause.partition(":")
        if not values:
            raise ValueError(f"no values in {clause!r}")
        out.setdefault(name.strip(), []).extend(v.strip() for v in values.split("|") if v.strip())
    return out


def parse_token_range(text: str) -> tuple[int | None, int | None]:
    """'4-500', '#7', '4-' or '-9' as bounds of a canonical token number."""
    body = text.strip().lstrip("#").replace("–", "-")
    lo, dash, hi = body.partition("-")
    if not (lo or hi) or any(x and not x.isdecimal() for x in (lo, hi)):
        raise ValueError(f"unreadable token range {text!r}")
    a, b = (int(lo) if lo else None), (int(hi) if hi else None) if dash else int(lo)
    if a is not None and b is not None and a > b:
        raise ValueError(f"empty token range {text!r}")
    return a, b


def token_number(token: Column) -> Column:
    """The number a token id is the canonical text of, else null."""
    n = token.try_cast("bigint")
    return F.when(n.cast("string") == token, n)


def tokens_matching(tags: DataFrame, flt: Filter) -> DataFrame:
    """The entities that have an allowed value for every attribute of the filter."""
    hit = None
    for name, values in flt.items():
        one = (F.col("trait_type") == name) & F.col("value").isin(values)
        hit = one if hit is None else hit | one
    if hit is None:
        return tags.select(*TOKEN).distinct()
    return tags.filter(hit).groupBy(*TOKEN).agg(F.count_distinct("trait_type").alias("k")).filter(F.col("k") == len(flt)).select(*TOKEN)


def covers(criteria: Column, n: Column, numeric: Column, flt: Filter) -> Column:
    """Whether an AND-list of criteria holds for every entity the filter can select: each one is pinned by a single-valued clause."""
    pins = F.array(*[F.struct(F.lit(a).alias("trait_type"), F.lit(v[0]).alias("value")) for a, v in flt.items() if len(v) == 1] or [F.struct(F.lit("").alias("trait_type"), F.lit("").alias("value"))])
    return F.coalesce((n > 0) & (F.coalesce(numeric, F.lit(0)) == 0) & F.forall(criteria, lambda c: F.array_contains(pins, c)), F.lit(False))


def offer_verdicts(offers: DataFrame, tags: DataFrame, flt: Filter) -> DataFrame:
    """Each offer (order_hash, collection, criteria, criteria_n, criteria_numeric_n) as covers, partial, disjoint, unknown or unparsed."""
    mine = tokens_matching(tags, flt)
    explicit = offers.filter((F.col("criteria_n") > 0) & (F.coalesce("criteria_numeric_n", F.lit(0)) == 0))
    wanted = explicit.select("order_hash", "collection", F.explode(F.array_distinct("criteria")).alias("c")).select("order_hash", "collection", "c.trait_type", "c.value")
    pairs = wanted.select("collection", "trait_type", "value").distinct()
    # only entities of the filter's own set can overlap, so the tags are cut to them and to wanted pairs first
    near = tags.join(mine, TOKEN, "left_semi").join(pairs, ["collection", "trait_type", "value"], "left_semi").distinct()
    need = wanted.groupBy("order_hash").agg(F.count(F.lit(1)).alias("k"))
    met = wanted.join(near, ["collection", "trait_type", "value"]).groupBy("order_hash", "token_id").agg(F.count(F.lit(1)).alias("k"))
    overlap = met.join(need, ["order_hash", "k"]).groupBy("order_hash").agg(F.count(F.lit(1)).alias("overlap"))
    n, numeric = F.col("criteria_n"), F.col("criteria_numeric_n")
    verdict = F.when(n.isNull() | (n == 0), "unparsed").when(numeric > 0, "unknown").when(covers(F.col("criteria"), n, numeric, flt), "covers").when(F.col("overlap") > 0, "partial").otherwise("disjoint")
    return offers.join(overlap, "order_hash", "left").select("order_hash", "collection", verdict.alias("verdict"), F.when(verdict == "partial", F.col("overlap")).alias("overlap"))


def value_census(tags: DataFrame) -> DataFrame:
    """Entities per collection, attribute and value."""
    return tags.groupBy("collection", "trait_type", "value").agg(F.count_distinct("token_id").alias("tokens"))


def case_near_misses(tags: DataFrame) -> DataFrame:
    """Values of one attribute that differ in letter case or outer blanks only."""
    folded = tags.select("collection", "trait_type", F.lower(F.trim("value")).alias("folded"), "value").distinct()
    return folded.groupBy("collection", "trait_type", "folded").agg(F.count(F.lit(1)).alias("variants"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("spellings")).filter("variants > 1")


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two versions of tags per entity and attribute: same, conflict, left_only or right_only, by their sets of values."""
    sets = lambda d, n: d.groupBy(*TOKEN, "trait_type").agg(F.array_sort(F.collect_set("value")).alias(n))
    both = sets(left, "l").join(sets(right, "r"), [*TOKEN, "trait_type"], "full")
    status = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("l") == F.col("r"), "same").otherwise("conflict")
    return both.withColumn("status", status)
