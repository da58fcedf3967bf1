"""Problems 5 and 7 to 9; SQL can't express the operators over documents, tests/llm/ has their brute-force versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.leakage import find_leaks
from tidemark.llm.mixing import mix, mix_plan, mix_report, sized
from tidemark.llm.residue import find_residue
from tidemark.llm.topn import clustered, top_n
from tidemark.session import cut, table


GROUP, N = ["collection", "event_type"], 5


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 5 lives with the highest price of every collection and event type."""
    return top_n(spark, clustered(table(spark, d, "order_lives"), GROUP, "price_eth", "order_hash"), GROUP, "price_eth", "order_hash", N)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_ranked(spark, d).select(*GROUP, "order_hash")


_TOP = (
    "FROM order_lives WHERE collection IS NOT NULL AND event_type IS NOT NULL AND price_eth IS NOT NULL AND NOT isnan(price_eth)"
    f" QUALIFY row_number() OVER (PARTITION BY collection, event_type ORDER BY price_eth DESC, order_hash) <= {N}"
)
_SQL = {
    "p5_found": f"SELECT collection, event_type, order_hash {_TOP}",
    "p5_ranked": "SELECT collection, event_type, price_eth, order_hash, CAST(row_number() OVER (PARTITION BY collection, event_type ORDER BY price_eth DESC, order_hash) AS INTEGER) AS rank " + _TOP,
}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("exact").select("item_id", "doc_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that show a passage of an item with an edit or two, or with its words divided otherwise."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("not exact").drop("exact")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per suite: its items, how many leaked word by word or nearly so, and how many documents show one."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).join(items, "item_id")
    when = lambda c, on: F.when(on, F.col(c))
    exact = F.col("exact")
    per = leaks.groupBy("suite").agg(
        F.count_distinct(when("item_id", exact)).alias("items_leaked"), F.count_distinct(when("doc_id", exact)).alias("documents_leaking"), F.count_if(exact).alias("leaks"),
        F.count_distinct(when("item_id", ~exact)).alias("items_near"), F.count_distinct(when("doc_id", ~exact)).alias("documents_near"), F.count_if(~exact).alias("near_leaks"),
    )
    return items.groupBy("suite").agg(F.count(F.lit(1)).alias("items")).join(per, "suite", "left").fillna(0)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    # sizes are used several times: they are kept, the texts aren't
    return cut(sized(table(spark, d, "documents").select("doc_id", "source", "text"), "text").drop("text"))


def _mixed(spark: SparkSession, d: str, budget: str = "all") -> tuple[DataFrame, DataFrame]:
    """(the mix, its plan)"""
    sizes = _sizes(spark, d)
    plan = cut(mix_plan(sizes, table(spark, d, "mix_targets"), budget))
    return mix(sizes, plan, "doc_id"), plan


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(*_mixed(spark, d))


def p8_reachable(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix that is no larger than every source can bear, so that all shares are met."""
    return mix_report(*_mixed(spark, d, "reachable"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).filter("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].select("doc_id", "source", "n_tokens", "copy", "position")


def p9_residue(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).filter("holds_residue").drop("holds_residue")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).filter("holds_residue").select("doc_id")


QUERIES = {f.__name__: (f, _SQL.get(f.__name__)) for f in (p5_found, p5_ranked, p7_found, p7_near, p7_report, p8_found, p8_report, p8_reachable, p8_mix, p9_found, p9_residue)}
