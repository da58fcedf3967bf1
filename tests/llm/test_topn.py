"""Top N of every group against brute force, and what statistics let be skipped."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import topn
from tidemark.llm.queries import QUERIES
from tidemark.llm.topn import cluster, kept_row_groups, statistics, top_n
from tidemark.session import work_folder


def brute(rows, n):
    """rows: (g, k, score, tie)"""
    want, groups = [], {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and r[2] == r[2]:
            groups.setdefault(r[:2], []).append(r)
    for g, mine in groups.items():
        best = sorted(mine, key=lambda r: (-r[2], r[3] is not None, r[3] or ""))[:n]
        want += [(*g, r[2], r[3], i + 1) for i, r in enumerate(best)]
    return sorted(want, key=str)


@pytest.mark.parametrize(("seed", "row_group", "groups"), [(5, 20_000, 2), (6, 100, 2), (7, 50, 300), (8, 20, 5)])
def test_top_n_brute_force(spark, monkeypatch, seed, row_group, groups):
    monkeypatch.setattr(topn, "ROW_GROUP", row_group)
    rnd = random.Random(seed)
    name = lambda: rnd.choice(["hot"] * 8 + [f"g{rnd.randrange(groups)}"] * 5 + [None])
    rows = [(name(), rnd.choice(["x", "y", None]), rnd.choice([None, float("nan"), 1.0, 2.0, 2.0, rnd.random() * 3, -1.0]), f"h{i:05d}" if rnd.random() > 0.02 else None, "clash") for i in range(4_000)]
    df = spark.createDataFrame(rows + rows[:30], "g string, k string, s double, h string, rank string")
    path = work_folder(spark, "t")
    cluster(df, ["g", "k"], "s", "h", path)
    for n in (1, 5):
        got = sorted(((r["g"], r["k"], r["s"], r["h"], r["rank"]) for r in top_n(spark, path, ["g", "k"], "s", "h", n).collect()), key=str)
        assert got == brute(rows + rows[:30], n)


def test_skips_row_groups_of_one_hot_group(spark):
    df = spark.range(400_000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("s"), F.format_string("%064d", "id").alias("h"))
    path = work_folder(spark, "t")
    cluster(df, ["g"], "s", "h", path)
    stats = statistics(spark, path, ["g"], "s").cache()
    whole = stats.select("file", "row_group").distinct().count()
    assert whole > 8 and kept_row_groups(stats, ["g"], 5).select("file", "row_group").distinct().count() <= 4
    assert [r["s"] for r in top_n(spark, path, ["g"], "s", "h", 3).orderBy("rank").collect()] == [399_999.0, 399_998.0, 399_997.0]


def test_skips_row_groups_that_many_groups_share(spark, monkeypatch):
    """2,000 small groups: none has a row group of its own, and yet most row groups are never opened."""
    monkeypatch.setattr(topn, "ROW_GROUP", 2_000)
    df = spark.range(200_000).select(F.format_string("g%04d", F.pmod(F.xxhash64("id"), F.lit(2_000))).alias("g"), F.rand(3).alias("s"), F.format_string("%08d", "id").alias("h"))
    path = work_folder(spark, "t")
    cluster(df, ["g"], "s", "h", path)
    stats = statistics(spark, path, ["g"], "s").cache()
    per = stats.groupBy("file", "row_group").count()
    assert per.agg(F.min("count")).first()[0] > 1
    whole, kept = per.count(), kept_row_groups(stats, ["g"], 5).select("file", "row_group").distinct().count()
    assert kept < whole / 3
    assert top_n(spark, path, ["g"], "s", "h", 5).count() == 10_000


def test_top_n_empty(spark):
    path = work_folder(spark, "t")
    cluster(spark.createDataFrame([], "g string, s double, h string"), ["g"], "s", "h", path)
    assert top_n(spark, path, ["g"], "s", "h", 5).count() == 0


@pytest.mark.parametrize("name", ["p5_found", "p5_ranked"])
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    run, sql = QUERIES[name]
    con = duckdb.connect()
    con.execute(f"create view order_lives as select * from '{sf}/order_lives.parquet'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(map(tuple, run(spark, sf).select(*names).collect())) == sorted(got.fetchall())
