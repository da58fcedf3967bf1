"""Data-quality rules: each is a DataFrame of findings (code, severity, place, message), united at the end."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut

SCHEMA = "code string, severity string, place string, message string"


def _findings(df: DataFrame, code: str, place: Column, message: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), place.cast("string").alias("place"), message.cast("string").alias("message"))


def duplicate_id(df: DataFrame, key: str) -> DataFrame:
    return _findings(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate-id", F.col(key), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def dangling(df: DataFrame, key: str, ref: str, target: DataFrame, target_key: str, code: str = "dangling-reference") -> DataFrame:
    known = target.select(F.col(target_key).alias("__known"))
    lost = df.filter(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("__known"), "left_anti")
    return _findings(lost, code, F.col(key), F.col(ref))


def unused(df: DataFrame, key: str, users: DataFrame, ref: str, code: str = "unused") -> DataFrame:
    used = users.select(F.col(ref).alias("__used"))
    return _findings(df.join(used, F.col(key) == F.col("__used"), "left_anti"), code, F.col(key), F.lit("never cited"), "warn")


def range_rule(df: DataFrame, key: str, value: str, lo: Column, hi: Column) -> DataFrame:
    """Bounds in the wrong order, and values outside of them."""
    wrong = F.when(lo > hi, "range-order").when((F.col(value) < lo) | (F.col(value) > hi) | F.isnan(F.col(value).cast("double")), "value-outside-range")
    return df.withColumn("__code", wrong).filter("__code is not null").select(F.col("__code").alias("code"), F.lit("error").alias("severity"), F.col(key).cast("string").alias("place"), F.col(value).cast("string").alias("message"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def word_limit(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    return _findings(df.withColumn("__n", word_count(F.col(text))).filter(F.col("__n") > most), "too-long", F.col(key), F.col("__n"))


def pattern(df: DataFrame, key: str, text: str, regex: str, code: str = "pattern-mismatch") -> DataFrame:
    return _findings(df.filter(F.col(text).isNotNull() & ~F.col(text).rlike(regex)), code, F.col(key), F.col(text))


def ceiling(claims: DataFrame, key: str, rank: str, cited: DataFrame, cited_key: str, cited_rank: str) -> DataFrame:
    """Claims graded better (lower rank) than the best record they cite."""
    best = cited.groupBy(cited_key).agg(F.min(cited_rank).alias("__best"))
    over = claims.join(best, claims[key] == best[cited_key]).filter(F.col(rank) < F.col("__best"))
    return _findings(over, "grade-ceiling", claims[key], F.col("__best"))


def latest_governs(log: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """The last record of each key by position."""
    return log.groupBy(key).agg(F.max(F.struct(position, *columns)).alias("__l")).select(key, *[F.col(f"__l.{c}").alias(c) for c in (position, *columns)])


def mirror(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields in which two versions of a table differ, and keys that only one has."""
    r = right.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__r_{c}") for c in columns])
    both = left.select(key, *columns).join(r, F.col(key) == F.col("__k"), "full")
    differs = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    where = F.when(F.col(key).isNull(), F.lit("only right")).when(F.col("__k").isNull(), F.lit("only left")).when(F.size(differs) > 0, F.array_join(differs, ","))
    return _findings(both.withColumn("__w", where).filter("__w is not null"), "mirror", F.coalesce(key, "__k"), F.col("__w"))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Every (child, ancestor, least depth) of parent edges, however deep; a cycle shows as child = ancestor.

    All pairs up to a depth are extended by those of just that depth, which
    doubles it; when none has that depth, none is deeper.
    """
    pairs = cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).filter("child is not null and ancestor is not null").distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while not (far := pairs.filter(F.col("depth") == reach)).isEmpty():
        onward = far.select(F.col("child").alias("__via"), F.col("ancestor").alias("__to"))
        longer = pairs.join(onward, F.col("ancestor") == F.col("__via")).select("child", F.col("__to").alias("ancestor"), (F.col("depth") + reach).alias("depth"))
        pairs = cut(pairs.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
    return pairs


def cycles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    return _findings(closure(edges, child, parent).filter("child = ancestor"), "parent-cycle", F.col("child"), F.col("depth"), "warn")


def report(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts per severity, zeros kept."""
    levels = findings.sparkSession.createDataFrame([("error",), ("warn",), ("info",)], "severity string")
    return levels.join(findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").fillna(0)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, (int, float)) and not isinstance(value, bool) and float(value).is_integer()
    return isinstance(value, _TYPES[kind])


def _canonical(value: object) -> str:
    """Equal JSON values give equal texts: 1 and 1.0 do, true and 1 don't."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_canonical(v)}" for k, v in sorted(value.items())) + "}"
    return json.dumps(value)


def check_json(value: object, schema: dict | bool, root: dict, at: str = "") -> Iterator[tuple[str, str, str]]:
    """(pointer, keyword, detail) for every violation of a draft-07 schema."""
    if schema is True or schema is False:
        if schema is False:
            yield at, "false", "nothing is allowed here"
        return
    if "$ref" in schema:
        target: object = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        yield from check_json(value, target, root, at)
        return
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield at, "type", str(kinds)
        return
    if "enum" in schema and _canonical(value) not in map(_canonical, schema["enum"]):
        yield at, "enum", _canonical(value)
    if "const" in schema and _canonical(value) != _canonical(schema["const"]):
        yield at, "const", _canonical(value)
    if _is(value, "number"):
        for word, bad in (("minimum", lambda x: value < x), ("maximum", lambda x: value > x), ("exclusiveMinimum", lambda x: value <= x), ("exclusiveMaximum", lambda x: value >= x)):
            if word in schema and bad(schema[word]):
                yield at, word, str(value)
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield at, "pattern", value
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            yield at, "length", str(len(value))
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            yield at, "count", str(len(value))
        if schema.get("uniqueItems") and len(set(map(_canonical, value))) < len(value):
            yield at, "uniqueItems", str(len(value))
        items = schema.get("items", True)
        for i, x in enumerate(value):
            sub = (items[i] if i < len(items) else schema.get("additionalItems", True)) if isinstance(items, list) else items
            yield from check_json(x, sub, root, f"{at}/{i}")
    if isinstance(value, dict):
        for k in schema.get("required", []):
            if k not in value:
                yield at, "required", k
        known, shapes = schema.get("properties", {}), schema.get("patternProperties", {})
        for k, x in value.items():
            subs = [known[k]] if k in known else []
            subs += [s for p, s in shapes.items() if re.search(p, k)]
            for s in subs or [schema.get("additionalProperties", True)]:
                if s is False:
                    yield at, "unknown-key", k
                else:
                    yield from check_json(x, s, root, f"{at}/{k}")
    fits = lambda s: next(check_json(value, s, root, at), None) is None
    for s in schema.get("allOf", []):
        yield from check_json(value, s, root, at)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        yield at, "anyOf", "no branch fits"
    if "oneOf" in schema and (n := sum(map(fits, schema["oneOf"]))) != 1:
        yield at, "oneOf", f"{n} branches fit"
    if "not" in schema and fits(schema["not"]):
        yield at, "not", "must not fit"
    if "if" in schema:
        branch = schema.get("then" if fits(schema["if"]) else "else")
        if branch is not None:
            yield from check_json(value, branch, root, at)


def json_schema(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """Findings of JSON texts against a schema; a text that isn't strict JSON (NaN and Infinity included) is 'unreadable'."""

    def strict(x: str) -> object:
        raise ValueError(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                try:
                    value = json.loads(t, parse_constant=strict)
                except (TypeError, ValueError):
                    out.append(("unreadable", "error", k, ""))
                    continue
                out += [(f"schema-{word}", "error", f"{k}{at}", detail) for at, word, detail in check_json(value, schema, schema)]
            yield pd.DataFrame(out, columns=["code", "severity", "place", "message"])

    return df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, SCHEMA)
