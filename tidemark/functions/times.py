"""Time texts: ISO-8601 with a full date and time, read without any UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHAPE = r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}(:?\d{2})?)?$"


def instant_us(text: Column) -> Column:
    """Epoch microseconds of a time text; null for null, any other shape, and instants that don't exist.

    No zone means UTC. Month lengths, hours, minutes and seconds are checked by the cast.
    """
    zoned = F.when(F.regexp_like(text, F.lit(r"(Z|[+-]\d{2}(:?\d{2})?)$")) & F.regexp_like(F.substring(text, 20, 40), F.lit(r"(Z|[+-])")), text).otherwise(F.concat(text, F.lit("Z")))
    full = F.regexp_replace(F.regexp_replace(zoned, r"([+-]\d{2})$", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(F.regexp_like(text, F.lit(SHAPE)), F.unix_micros(full.try_cast("timestamp")))


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of a time text, rounded down."""
    return F.floor(instant_us(text) / F.lit(1000)).cast("bigint")


def seconds(text: Column) -> Column:
    """Epoch seconds (double) of a time text."""
    return instant_us(text) / F.lit(1e6)


#: The same reading as a DuckDB expression over a text ``{c}``, in microseconds.
DUCK_US = (
    "(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]{{1,6}})?(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)?$') AND left({c}, 4) <> '0000'"
    " AND substr({c}, 12, 2) < '24' AND substr({c}, 15, 2) < '60' AND substr({c}, 18, 2) < '60'"
    " THEN epoch_us(TRY_CAST(substr({c}, 1, 10) || ' ' || regexp_extract({c}, '^.{{11}}([0-9:.]+)', 1) AS TIMESTAMP))"
    " - CASE WHEN regexp_matches(substr({c}, 20), '[+-]') THEN (CASE WHEN regexp_matches(substr({c}, 20), '[-]') THEN -1 ELSE 1 END)"
    " * (60 * CAST(regexp_extract(substr({c}, 20), '[+-]([0-9]{{2}})', 1) AS BIGINT)"
    " + COALESCE(TRY_CAST(NULLIF(regexp_extract(substr({c}, 20), '[+-][0-9]{{2}}:?([0-9]{{2}})', 1), '') AS BIGINT), 0)) * 60000000 ELSE 0 END END)"
)


def duck_us(column: str) -> str:
    """DuckDB text for :func:`instant_us` of a column."""
    return DUCK_US.format(c=column)
