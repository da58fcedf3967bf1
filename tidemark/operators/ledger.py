"""Listings that are read page by page: filters, a few permitted orders, marks that say where the next page begins, bounded counts.

The order of a listing is one struct, (sorted column, run, seq); structs compare
field by field with nulls lowest, so "behind a row" is a single comparison with
that row's struct, in either direction. A mark is the struct of a page's last
row in a typed JSON form, sealed with a digest of the listing it belongs to.
"""

from __future__ import annotations

import hashlib
import re
from binascii import Error as Base64Error
from base64 import b32decode, b32encode
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.tags import TOKEN, Filter, token_number, tokens_matching

#: Columns a listing may be ordered by.
SORTS = ("valid_ts", "observed_ts", "token_num", "maker", "event_type", "price_eth")
#: Columns it may not be ordered by, and why.
REFUSED = {
    "price_usd": "rows were converted at different rates, so this isn't the order of prices; order by price_eth",
    "token_id": "a text order puts 10 before 9; order by token_num",
    "taker": "hardly any row has one; filter by it",
    "lag": "computed for each row; order by observed_ts or valid_ts",
    "exit_reason": "belongs to an order's life, not to the event; filter by it",
    "order_hash": "its order means nothing",
    "name": "belongs to the token, not to the event",
}
TIE = ["run", "seq"]
MAX_PAGE = 500


def where(
    *, collection: str | None = None, start: float | None = None, end: float | None = None, types: list[str] | None = None, token: str | None = None, tokens: tuple[int | None, int | None] | None = None,
    maker: str | None = None, taker: str | None = None, price_min: float | None = None, price_max: float | None = None, order_hash: str | None = None, has_price: bool | None = None,
) -> Column:
    """All given conditions as one column that reaches the scan; ``tokens`` are bounds of the token number."""
    out = F.lit(True)
    for name, value in (("collection", collection), ("token_id", token), ("maker", maker), ("taker", taker), ("order_hash", order_hash)):
        if value is not None:
            out &= F.col(name) == value
    for name, low, value in (("valid_ts", True, start), ("valid_ts", False, end), ("price_eth", True, price_min), ("price_eth", None, price_max)):
        if value is not None:
            out &= F.col(name) >= value if low else F.col(name) < value if low is False else F.col(name) <= value
    if types:
        out &= F.col("event_type").isin(types)
    for bound, value in zip(("lo", "hi"), tokens or ()):
        if value is not None:
            out &= token_number(F.col("token_id")) >= value if bound == "lo" else token_number(F.col("token_id")) <= value
    if has_price is not None:
        priced = F.col("price_eth").isNotNull() & ~F.isnan("price_eth")
        out &= priced if has_price else ~priced
    return out


@dataclass(frozen=True)
class Listing:
    """Rows (unique in TIE) under filters in one order; ``traits`` keeps the rows of tokens that match them in ``tags``."""

    rows: DataFrame
    sort: str
    descending: bool
    filters: dict = field(default_factory=dict)
    traits: Filter | None = None
    tags: DataFrame | None = None

    def __post_init__(self):
        if self.sort not in SORTS:
            raise ValueError(f"a listing can't be ordered by {self.sort}: {REFUSED.get(self.sort, 'there is no such order')}")

    def chosen(self) -> DataFrame:
        out = self.rows.filter(where(**self.filters))
        if "token_num" not in out.columns:
            out = out.withColumn("token_num", token_number(F.col("token_id"))) if "token_id" in out.columns else out
        return out.join(tokens_matching(self.tags, self.traits), TOKEN, "left_semi") if self.traits else out

    def _place(self) -> Column:
        return F.struct(self.sort, *TIE)

    def _seal(self) -> str:
        said = "\n".join([self.sort, str(self.descending), repr(sorted(self.filters.items())), repr(sorted((self.traits or {}).items()))])
        return hashlib.blake2s(said.encode(), digest_size=8).hexdigest()

    def page(self, size: int, after: str | None = None) -> DataFrame:
        """``size`` rows, from the beginning or behind a mark."""
        if not 0 < size <= MAX_PAGE:
            raise ValueError(f"a page holds 1 to {MAX_PAGE} rows")
        out, place = self.chosen(), self._place()
        if after is not None:
            last = self._read(after, out)
            out = out.filter(place < last if self.descending else place > last)
        return out.orderBy(place.desc() if self.descending else place.asc()).limit(size)

    def mark(self, shown: DataFrame) -> str | None:
        """The mark behind a page's last row; None behind an empty page."""
        place = self._place()
        end = F.min(place) if self.descending else F.max(place)
        text = shown.agg(F.to_json(end, {"ignoreNullFields": "false"}).alias("m")).first()["m"]
        return b32encode(f"{self._seal()}{text}".encode()).decode().rstrip("=").lower() if text else None

    def _read(self, mark: str, rows: DataFrame) -> Column:
        try:
            text = b32decode(mark.upper() + "=" * (-len(mark) % 8)).decode()
        except (Base64Error, ValueError) as e:
            raise ValueError("this isn't a mark of a listing") from e
        if text[:16] != self._seal():
            raise ValueError("the mark belongs to another listing")
        shape = T.StructType([rows.schema[c] for c in (self.sort, *TIE)])
        return F.from_json(F.lit(text[16:]), shape)


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """n and whether it is exact, counting cap + 1 rows at most."""
    return rows.limit(cap + 1).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n"), (F.count(F.lit(1)) <= cap).alias("exact"))


def detail_and_count(rows: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows in an order, and the number of all of them."""
    return rows.orderBy(*order).limit(most), rows.agg(F.count(F.lit(1)).alias("n"))


def plan_facts(df: DataFrame) -> dict[str, object]:
    """What a query's physical plan does: scans with their columns and pushed filters, shuffles, full sorts, top-n sorts."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    body = text[text.index("== Physical Plan ==") :]
    scans = [{"columns": re.findall(r"(\w+):", read), "pushed": pushed} for pushed, read in re.findall(r"PushedFilters: \[(.*?)\].*?ReadSchema: struct<(.*?)>\s*$", body, re.M)]
    count = lambda name: len(re.findall(rf"(?:\+-|:-|^|\s)\s*(?:\*\(\d+\) )?{name}\b", body, re.M))
    return {"scans": scans, "exchanges": count("Exchange"), "sorts": count("Sort"), "top_n": count("TakeOrderedAndProject")}
