"""Problem 2: exactly one copy of every message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.once import arrival_batches, arrival_edges, deliver_once
from tidemark.session import table, work_folder

BATCHES = 3


def _flagged(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return deliver_once(rows, work_folder(spark, "seen"), "run", "seq", ["observed_ts", "file"], arrival_batches(rows, "observed_ts", arrival_edges(rows, "observed_ts", BATCHES)))


def found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").select("run", "seq", "observed_ts", "file")
    return _flagged(spark, rows).filter("not __accepted").select("run", "seq").distinct()


def once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_events").select("run", "seq", "observed_ts", "file", "event_type", "collection", "maker", "price_eth")
    return _flagged(spark, rows).filter("__accepted").select(*rows.columns)


QUERIES = {
    "p2_found": (found, "SELECT run, seq FROM market_events WHERE run IS NOT NULL AND seq IS NOT NULL GROUP BY run, seq HAVING count(*) > 1"),
    "p2_messages_once": (
        once,
        "SELECT run, seq, observed_ts, file, event_type, collection, maker, price_eth FROM market_events"
        " QUALIFY row_number() OVER (PARTITION BY run, seq ORDER BY observed_ts NULLS FIRST, file NULLS FIRST) = 1",
    ),
}
