"""Data-quality rules over the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.quality import by_severity, ceiling, closure, cycles, dangling, duplicate_id, json_schema, latest_governs, mirror, pattern, range_rule, report, unused, word_limit
from tidemark.session import table

PROPS = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 95}}}


def dq_duplicate_id(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_id(table(spark, d, "traits").select(F.concat_ws("/", "collection", "token_id", "trait_type").alias("k")), "k")


def dq_dangling_ref(spark: SparkSession, d: str) -> DataFrame:
    return dangling(table(spark, d, "gap_register"), "id", "conn_label", table(spark, d, "market_events"), "conn")


def dq_unused(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", "collection", "token_id").alias("k")
    return unused(table(spark, d, "tokens").select(key), "k", table(spark, d, "traits").select(key), "k")


def dq_range(spark: SparkSession, d: str) -> DataFrame:
    return range_rule(table(spark, d, "lineitem").withColumn("k", F.concat_ws("/", "l_orderkey", "l_linenumber")), "k", "l_discount", F.lit(0.01), F.lit(0.09))


def dq_word_limit(spark: SparkSession, d: str) -> DataFrame:
    return word_limit(table(spark, d, "documents"), "doc_id", "text", 250)


def dq_pattern(spark: SparkSession, d: str) -> DataFrame:
    return pattern(table(spark, d, "tokens").withColumn("k", F.concat_ws("/", "collection", "token_id")), "k", "token_id", "^[0-9]+$")


def dq_grade_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose priority is better than the best ship mode rank they cite (by line number)."""
    claims = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    return ceiling(claims, "o_orderkey", "rank", table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") % 5).cast("int").alias("r")), "l_orderkey", "r")


def dq_latest_governs(spark: SparkSession, d: str) -> DataFrame:
    return latest_governs(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"])


def dq_mirror(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "nation")
    right = left.filter("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") == 5, "?").otherwise(F.col("n_name")))
    return mirror(left, right, "n_nationkey", ["n_name", "n_regionkey"])


def dq_json_schema(spark: SparkSession, d: str) -> DataFrame:
    return json_schema(table(spark, d, "events"), "event_id", "props", PROPS)


def dq_severity(spark: SparkSession, d: str) -> DataFrame:
    return by_severity(report([dq_unused(spark, d), dq_range(spark, d), dq_word_limit(spark, d), dq_pattern(spark, d)]))


def dep_closure(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of parts whose parent is a third of their number."""
    edges = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 3").alias("parent")).filter("parent > 0")
    return closure(edges, "p_partkey", "parent")


def dq_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose parent is the next one of their region, which closes a ring."""
    return cycles(table(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") + 5) % 25).alias("parent")), "n_nationkey", "parent")


def kb_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and area, zero groups kept, with their share of the source."""
    docs = table(spark, d, "documents")
    counts = docs.groupBy("source", "area").agg(F.count(F.lit(1)).alias("n"))
    areas = docs.agg(F.collect_set("area")).scalar()
    groups = docs.groupBy("source").agg(F.count(F.lit(1)).alias("of")).withColumn("area", F.explode(areas))
    return groups.join(counts, ["source", "area"], "left").fillna(0, ["n"]).withColumn("pct", F.try_divide(F.col("n") * 100.0, F.col("of")))


QUERIES = {
    "dq_duplicate_id": (
        dq_duplicate_id,
        "SELECT 'duplicate-id' AS code, 'error' AS severity, k AS place, count(*) || ' rows' AS message FROM (SELECT concat_ws('/', collection, token_id, trait_type) AS k FROM traits) GROUP BY k HAVING count(*) > 1",
    ),
    "dq_dangling_ref": (
        dq_dangling_ref,
        "SELECT 'dangling-reference' AS code, 'error' AS severity, CAST(id AS VARCHAR) AS place, conn_label AS message FROM gap_register WHERE conn_label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM market_events WHERE conn = conn_label)",
    ),
    "dq_unused": (dq_unused, "SELECT 'unused' AS code, 'warn' AS severity, collection || '/' || token_id AS place, 'never cited' AS message FROM tokens WHERE (collection, token_id) NOT IN (SELECT (collection, token_id) FROM traits)"),
    "dq_range": (
        dq_range,
        "SELECT 'value-outside-range' AS code, 'error' AS severity, l_orderkey || '/' || l_linenumber AS place, CAST(l_discount AS VARCHAR) AS message FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09",
    ),
    "dq_word_limit": (
        dq_word_limit,
        r"SELECT 'too-long' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS place, CAST(n AS VARCHAR) AS message FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents) WHERE n > 250",
    ),
    "dq_pattern": (dq_pattern, "SELECT 'pattern-mismatch' AS code, 'error' AS severity, collection || '/' || token_id AS place, token_id AS message FROM tokens WHERE NOT regexp_full_match(token_id, '[0-9]+')"),
    "dq_grade_ceiling": (
        dq_grade_ceiling,
        "SELECT 'grade-ceiling' AS code, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS place, CAST(b AS VARCHAR) AS message FROM orders JOIN (SELECT l_orderkey, min(CAST(l_quantity AS INTEGER) % 5) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE CAST(left(o_orderpriority, 1) AS INTEGER) < b",
    ),
    "dq_latest_governs": (dq_latest_governs, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "dq_mirror": (dq_mirror, "SELECT 'mirror' AS code, 'error' AS severity, '3' AS place, 'only left' AS message UNION ALL SELECT 'mirror', 'error', '5', 'n_name'"),
    "dq_json_schema": (
        dq_json_schema,
        "SELECT CASE WHEN k < 5 THEN 'schema-minimum' ELSE 'schema-maximum' END AS code, 'error' AS severity, event_id || '/k' AS place, CAST(k AS VARCHAR) AS message FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k < 5 OR k > 95",
    ),
    "dq_severity": (
        dq_severity,
        r"SELECT 'error' AS severity, (SELECT count(*) FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09) + (SELECT count(*) FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 250) + (SELECT count(*) FROM tokens WHERE NOT regexp_full_match(token_id, '[0-9]+')) AS n"
        " UNION ALL SELECT 'warn', (SELECT count(*) FROM tokens WHERE (collection, token_id) NOT IN (SELECT (collection, token_id) FROM traits)) UNION ALL SELECT 'info', 0",
    ),
    "dep_closure": (
        dep_closure,
        "WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part WHERE p_partkey // 3 > 0), up AS (SELECT c AS child, p AS ancestor, 1 AS depth FROM e UNION ALL SELECT child, e.p, depth + 1 FROM up JOIN e ON e.c = ancestor) SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY ALL",
    ),
    "dq_cycle": (dq_cycle, "SELECT 'parent-cycle' AS code, 'warn' AS severity, CAST(n_nationkey AS VARCHAR) AS place, '5' AS message FROM nation"),
    "kb_summary": (
        kb_summary,
        "WITH g AS (SELECT source, count(*) AS of FROM documents GROUP BY 1), a AS (SELECT DISTINCT area FROM documents WHERE area IS NOT NULL), n AS (SELECT source, area, count(*) AS n FROM documents GROUP BY ALL)"
        " SELECT source, area, of, coalesce(n, 0) AS n, 100.0::DOUBLE * coalesce(n, 0) / of AS pct FROM g CROSS JOIN a LEFT JOIN n USING (source, area)",
    ),
}
