"""Reading texts as typed values: one canonical text per value, so that equal values compare equal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that count as blanks.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_blanks(c: Column) -> Column:
    """Without outer blanks."""
    return F.trim(c, F.lit(BLANKS))


def attribute_key(c: Column) -> Column:
    """An attribute name as it is compared: no letter case, no outer blanks, one blank for runs of blanks, _ and -."""
    return F.regexp_replace(F.translate(F.lower(strip_blanks(c)), BLANKS + "_-", " " * (len(BLANKS) + 2)), " {2,}", " ")


def number_text(v: Column) -> Column:
    """Canonical text of a decimal number with optional sign, fraction and thousands commas; exact at any length."""
    bare = F.regexp_replace(F.regexp_replace(v, "[+,]", ""), "^(-?)0+(?=[0-9])", "$1")
    short = F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.regexp_like(v, F.lit(r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$")), F.regexp_replace(short, "^-0$", "0"))


def boolean_text(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")


def date_text(v: Column) -> Column:
    """YYYY-MM-DD of a real day written in one of four ways."""
    day = (
        F.when(F.regexp_like(v, F.lit(r"^(?!0000)[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}$")), F.translate(v, "/", "-"))
        .when(F.regexp_like(v, F.lit(r"^[0-9]{2}\.[0-9]{2}\.(?!0000)[0-9]{4}$")), F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))
    )
    epoch = F.when(F.regexp_like(v, F.lit("^[0-9]{10}$")), F.date_format(F.timestamp_seconds(v.try_cast("bigint")), "yyyy-MM-dd"))
    return F.coalesce(day.try_cast("date").cast("string"), epoch)


def typed_text(v: Column, kind: Column) -> Column:
    """Canonical text of ``v`` (without outer blanks) read as ``kind`` (text, number, boolean or date); null if it can't be read."""
    read = F.when(kind == "number", number_text(v)).when(kind == "boolean", boolean_text(v)).when(kind == "date", date_text(v)).when(kind == "text", v)
    return F.when(v != "", read)
