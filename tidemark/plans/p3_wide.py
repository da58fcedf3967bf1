"""Problem 3: traits as one wide, typed row per token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.wide import WideStore, declared, unclear_cells, wide_table
from tidemark.session import table, work_folder

TOKEN = ["collection", "token_id"]
BATCHES = 3


def _store(spark: SparkSession, d: str) -> WideStore:
    """The table in batches by a hash of whole rows, so that a cell's rows come in several; all are of one version, as the table has none."""
    store = WideStore(spark, work_folder(spark, "wide"), table(spark, d, "trait_types"), TOKEN, fan_out=BATCHES - 1)
    rows = table(spark, d, "traits").select(*TOKEN, "trait_type", "value").withColumn("version", F.lit(1).cast("bigint"))
    part = F.pmod(F.xxhash64(*TOKEN, "trait_type", "value"), F.lit(BATCHES))
    for i in range(BATCHES):  # the last one makes more runs than fan_out and is followed by a compaction
        store.upsert(rows.filter(part == i), f"{i:06d}", "trait_type", "value", "version")
    return store


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).read()


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Batches of different versions (a row's version is the length of its value modulo 3): later ones replace cells of earlier ones, in whatever order they come."""
    store = WideStore(spark, work_folder(spark, "wide"), table(spark, d, "trait_types"), TOKEN, fan_out=2)
    rows = table(spark, d, "traits").select(*TOKEN, "trait_type", "value").withColumn("version", F.pmod(F.coalesce(F.length("value"), F.lit(0)), F.lit(3)))
    for i, v in enumerate((1, 2, 0)):
        store.upsert(rows.filter(F.col("version") == v), f"{i:06d}", "trait_type", "value", "version")
    cells = store.read().select(*TOKEN, F.explode("cells").alias("trait_type", "c"))
    return cells.select(*TOKEN, "trait_type", F.col("c.__ver").alias("version"), F.when(~F.col("c.__bad") & F.col("c.__lo").eqNullSafe(F.col("c.__hi")), "clear").otherwise("unclear").alias("state"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return unclear_cells(_wide(spark, d), TOKEN, "trait_type")


def traits_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(_wide(spark, d), declared(table(spark, d, "trait_types")), TOKEN)


_KEY = "regexp_replace(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '[\\s_-]+', ' ', 'g')"
_NUM = r"regexp_matches(v, '^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$')"
CELLS = rf"""
WITH r AS (SELECT t.collection, t.token_id, y.trait_type, y.value_type, regexp_replace(t.value, '^\s+|\s+$', '', 'g') AS v
  FROM traits t JOIN trait_types y ON {_KEY.format("t.trait_type")} = {_KEY.format("y.trait_type")}
  WHERE t.collection IS NOT NULL AND t.token_id IS NOT NULL),
read AS (SELECT *, CASE WHEN v = '' THEN NULL
  WHEN value_type = 'text' THEN v
  WHEN value_type = 'number' THEN CASE WHEN {_NUM} THEN CAST(CAST(replace(replace(v, ',', ''), '+', '') AS DECIMAL(30, 8)) AS VARCHAR) END
  WHEN value_type = 'boolean' THEN CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', '0') THEN 'false' END
  WHEN value_type = 'date' THEN CASE
    WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(TRY_CAST(v AS DATE) AS VARCHAR)
    WHEN regexp_matches(v, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') THEN CAST(TRY_CAST(replace(v, '/', '-') AS DATE) AS VARCHAR)
    WHEN regexp_matches(v, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$') THEN CAST(TRY_CAST(substr(v, 7, 4) || '-' || substr(v, 4, 2) || '-' || substr(v, 1, 2) AS DATE) AS VARCHAR)
    WHEN regexp_matches(v, '^[0-9]{{10}}$') THEN CAST(CAST(make_timestamp(CAST(v AS BIGINT) * 1000000) AS DATE) AS VARCHAR) END END AS x FROM r),
cell AS (SELECT collection, token_id, trait_type, value_type, count(*) = count(x) AND min(x) = max(x) AS single, min(x) AS x FROM read GROUP BY ALL)
"""
LATEST = CELLS.replace("t.collection, t.token_id, y.trait_type", "t.collection, t.token_id, length(coalesce(t.value, '')) % 3 AS version, y.trait_type")
_NAMES = [("Aura Score", "DOUBLE"), ("Awakened", "BOOLEAN"), ("Banner", "VARCHAR"), ("Companion", "VARCHAR"), ("Crest", "VARCHAR"), ("Edition Size", "DOUBLE"), ("Forged On", "DATE"), ("Hull", "VARCHAR"), ("Last Voyage", "DATE"), ("Level", "DOUBLE"), ("Rune", "VARCHAR"), ("Season", "VARCHAR"), ("Soul Bound", "BOOLEAN"), ("Weight Kg", "DOUBLE")]
_COLS = ", ".join(f"CAST(max(CASE WHEN single AND trait_type = '{n}' THEN x END) AS {t}) AS {n.lower().replace(' ', '_')}" for n, t in _NAMES)

QUERIES = {
    "p3_latest": (
        latest,
        LATEST + "SELECT collection, token_id, trait_type, version, CASE WHEN count(*) = count(x) AND min(x) = max(x) THEN 'clear' ELSE 'unclear' END AS state FROM"
        " (SELECT *, rank() OVER (PARTITION BY collection, token_id, trait_type ORDER BY version DESC) AS k FROM read) WHERE k = 1 GROUP BY ALL",
    ),
    "p3_found": (found, CELLS + "SELECT collection, token_id, trait_type FROM cell WHERE single IS DISTINCT FROM true"),
    "p3_traits_wide": (
        traits_wide,
        CELLS + f"SELECT collection, token_id, {_COLS}, coalesce(string_agg(CASE WHEN single IS DISTINCT FROM true THEN trait_type END, '|' ORDER BY trait_type), '') AS unclear FROM cell GROUP BY collection, token_id",
    ),
}
