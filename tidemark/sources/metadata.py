"""Token metadata as delivered (JSON) into attribute-value pairs, in any of its shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_PAIR = "array<struct<trait_type:string,name:string,value:variant>>"


def _scalar(v: Column) -> Column:
    """A scalar as text; null for null, arrays and objects."""
    kind = F.schema_of_variant(v)
    flat = ~(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")))
    return F.when(v.isNotNull() & flat & ~F.is_variant_null(v), F.trim(F.try_variant_get(v, "$", "string")))


def attributes(text: Column) -> Column:
    """Array of (trait_type, value, ok) from ``attributes`` or ``traits``, each a list of pairs or a map; or from the bare list or map itself.

    A pair without name is left out; ``ok`` is false where the value is no scalar or empty.
    """
    v = F.try_parse_json(text)
    lists = F.coalesce(*[F.try_variant_get(v, p, _PAIR) for p in ("$.attributes", "$.traits", "$")])
    maps = F.coalesce(*[F.try_variant_get(v, p, "map<string,variant>") for p in ("$.attributes", "$.traits")])
    from_list = F.transform(lists, lambda x: F.struct(F.coalesce(x["trait_type"], x["name"]).alias("trait_type"), x["value"].alias("value")))
    from_map = F.transform(F.map_entries(maps), lambda x: F.struct(x["key"].alias("trait_type"), x["value"].alias("value")))
    pairs = F.filter(F.coalesce(from_list, from_map), lambda x: x["trait_type"].isNotNull())
    read = F.transform(pairs, lambda x: F.struct(F.trim(x["trait_type"]).alias("trait_type"), _scalar(x["value"]).alias("value")))
    return F.transform(read, lambda x: F.struct(x["trait_type"].alias("trait_type"), x["value"].alias("value"), F.coalesce(x["value"] != "", F.lit(False)).alias("ok")))


def explode_attributes(tokens: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(keys, trait_type, value) of all readable pairs, and per key the number of malformed ones."""
    pairs = tokens.select(*keys, F.explode(attributes(F.col(text))).alias("a")).select(*keys, "a.*")
    return pairs.filter("ok").drop("ok"), pairs.filter("not ok").groupBy(*keys).agg(F.count(F.lit(1)).alias("malformed"))
