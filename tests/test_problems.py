"""The general problems' operators on small fixtures: brute force, and every defined edge case."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import instant_us
from tidemark.functions.typed import attribute_key, typed_text
from tidemark.operators.late import PeriodCounts, first_copies, issue, marks, value_counts, weighted_median
from tidemark.operators.once import SeenBitmaps, arrival_batches, arrival_edges, deliver_once
from tidemark.operators.skew import heavy_keys, skew_aggregate, skew_join
from tidemark.operators.spans import periods
from tidemark.operators.wide import WideStore, declared, unclear_cells, wide_delta, wide_table
from tidemark.session import work_folder


# 1 ------------------------------------------------------------------------------------------------
def test_skew_aggregate_brute_force(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.4 else None if rnd.random() < 0.1 else f"k{rnd.randrange(300)}", rnd.choice([None, 1, 2, 3]), "x") for _ in range(4_000)]
    df = spark.createDataFrame(rows, "k string, n long, __salt string")  # a clashing extra column
    got = {r["k"]: (r["rows"], r["s"], r["c"], r["lo"]) for r in skew_aggregate(df, ["k"], [("rows", "rows", None), ("s", "sum", "n"), ("c", "count", "n"), ("lo", "min", "n")]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        ns = [n for kk, n, _ in rows if kk == k]
        vs = [n for n in ns if n is not None]
        want[k] = (len(ns), sum(vs) if vs else None, len(vs), min(vs) if vs else None)
    assert got == want


def test_skew_heavy_keys_and_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(500)] + [(None, 0)], "k string, v int")
    assert heavy_keys(left, ["k"], 0.1).count() == 1
    right = spark.createDataFrame([("hot", "H"), *[(f"k{i}", "c") for i in range(0, 500, 2)], (None, "n")], "k string, v string")
    out = skew_join(left, right, ["k"], share=0.1)
    assert out.columns == ["k", "v", "v_right"] and out.count() == 750
    # too many rows of heavy keys for a broadcast: the salted way gives the same
    twice = right.unionByName(right)
    rows = [sorted(map(str, skew_join(left, twice, ["k"], share=0.1, max_broadcast=n, salts=4).collect())) for n in (10, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 1_500


def test_skew_empty(spark):
    df = spark.createDataFrame([], "k string, n long")
    assert skew_aggregate(df, ["k"], [("s", "sum", "n")]).count() == 0


# 2 ------------------------------------------------------------------------------------------------
def test_once_over_batches(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(-5, 40), 1 << 40]), float(i), f"f{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "run string, seq long, o double, file string")
    out = deliver_once(df, work_folder(spark, "t"), "run", "seq", ["o", "file"], arrival_batches(df, "o", arrival_edges(df, "o", 3))).collect()
    assert len(out) == len(rows)
    kept = [r for r in out if r["__accepted"]]
    named = [r for r in kept if r["run"] is not None and r["seq"] is not None]
    first = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            first.setdefault((r[0], r[1]), r[2])
    assert {(r["run"], r["seq"]): r["o"] for r in named} == first and len(named) == len(first)
    assert len(kept) - len(named) == sum(r[0] is None or r[1] is None for r in rows)


def test_once_replay_and_state(spark):
    path = work_folder(spark, "t")
    df = spark.createDataFrame([("r", 1, 0.0), ("r", 1, 1.0), ("r", 2, 0.5)], "run string, seq long, o double")
    seen = SeenBitmaps(spark, path, "run", "seq")
    a = sorted(map(tuple, seen.apply(df, "b1", ["o"]).select("seq", "o", "__accepted").collect()))
    again = sorted(map(tuple, SeenBitmaps(spark, path, "run", "seq").apply(df, "b1", ["o"]).select("seq", "o", "__accepted").collect()))
    assert a == again == [(1, 0.0, True), (1, 1.0, False), (2, 0.5, True)]
    assert seen.seen_count() == 2
    assert seen.apply(df, "b2", ["o"]).filter("__accepted").count() == 0
    assert seen.apply(df.limit(0), "b3", ["o"]).count() == 0 and seen.seen_count() == 2


# 3 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        ("1,000", "number", "1000"), ("+1000.00", "number", "1000"), ("-0", "number", "0"), ("007.50", "number", "7.5"), ("1,00", "number", None), ("0x1F", "number", None), ("NaN", "number", None), ("9" * 60, "number", "9" * 60),
        (" Yes ", "boolean", "true"), ("0", "boolean", "false"), ("maybe", "boolean", None), ("2024/02/29", "date", "2024-02-29"), ("2023-02-29", "date", None), ("31.12.2021", "date", "2021-12-31"), ("1614599348", "date", "2021-03-01"),
        ("2021-03/01", "date", None), ("", "text", None), ("   ", "text", None), ("Blue", "text", "Blue"), (None, "text", None), ("x" * 100_000, "text", "x" * 100_000),
    ],
)
def test_typed_text(spark, value, kind, want):
    from tidemark.functions.typed import strip_blanks

    assert spark.createDataFrame([(value,)], "v string").select(typed_text(strip_blanks(F.col("v")), F.lit(kind))).first()[0] == want


def test_attribute_key(spark):
    rows = [(" Soul  Bound",), ("soul_bound",), ("SOUL-BOUND ",), ("Soul -_Bound",)]
    assert {r[0] for r in spark.createDataFrame(rows, "a string").select(attribute_key(F.col("a"))).collect()} == {"soul bound"}


TYPES = [("Level", "number"), ("Hull", "text"), ("Born", "date")]


def test_wide_conflicts_and_versions(spark, tmp_path):
    types = spark.createDataFrame(TYPES, "trait_type string, value_type string")
    rows = spark.createDataFrame(
        [("c", "1", "level ", "1,000"), ("c", "1", "LEVEL", "1000.0"), ("c", "1", "Hull", "Oak"), ("c", "1", "Hull", "oak"), ("c", "2", "Level", "x"), ("c", "2", "Born", "2021-03-01"), ("c", "2", "Born", "01.03.2021"), ("c", None, "Level", "1"), ("c", "3", None, "1"), ("c", "3", "Other", "1"), ("c", "4", "Hull", None)],
        "collection string, token_id string, trait_type string, value string",
    )
    e = ["collection", "token_id"]
    wide = wide_delta(rows, types, e, "trait_type", "value")
    assert sorted(map(tuple, unclear_cells(wide, e, "trait_type").collect())) == [("c", "1", "Hull"), ("c", "2", "Level"), ("c", "4", "Hull")]
    out = {r["token_id"]: r for r in wide_table(wide, declared(types), e).collect()}
    assert out["1"]["level"] == 1000.0 and out["1"]["hull"] is None and out["1"]["unclear"] == "Hull" and str(out["2"]["born"]) == "2021-03-01"
    # upserts: a later version of a cell replaces the earlier one, other cells stay
    store = WideStore(spark, work_folder(spark, "w"), types, e, fan_out=2)
    schema = "collection string, token_id string, trait_type string, value string, v string"
    for i, batch in enumerate([[("c", "1", "Hull", "Oak", "1"), ("c", "1", "Level", "5", "1")], [("c", "1", "Hull", "Elm", "3")], [("c", "1", "Hull", "Ash", "2"), ("c", "9", "Hull", "Fir", "1")]]):
        store.upsert(spark.createDataFrame(batch, schema), f"b{i}", "trait_type", "value", "v")
        store.upsert(spark.createDataFrame(batch, schema), f"b{i}", "trait_type", "value", "v")  # again: nothing changes
    assert len(store._runs()) == 1
    out = {r["token_id"]: r for r in wide_table(store.read(), declared(types), e).collect()}
    assert out["1"]["hull"] == "Elm" and out["1"]["level"] == 5.0 and out["9"]["hull"] == "Fir"
    assert wide_delta(rows.limit(0), types, e, "trait_type", "value").count() == 0


@pytest.mark.parametrize(
    ("kind", "versions"),
    [("int", [9, 10, 11]), ("bigint", [-10, -9, 0]), ("double", [5.0, 1e10, 1e20]), ("decimal(20,2)", ["9", "10.5", "11"]), ("date", ["2023-12-31", "2024-01-01", "2024-01-02"])],
)
def test_wide_versions_in_their_own_type(spark, kind, versions):
    e, types = ["collection", "token_id"], spark.createDataFrame(TYPES, "trait_type string, value_type string")
    for order in ([0, 1, 2], [1, 2, 0]):
        store = WideStore(spark, work_folder(spark, "w"), types, e, fan_out=2)
        store.upsert(spark.createDataFrame([("c", "2", "Hull", "Old")], "collection string, token_id string, trait_type string, value string"), "plain", "trait_type", "value")
        for i in order:
            rows = [("c", "1", "Hull", f"at {i}", versions[i]), ("c", "1", "Level", str(i), versions[i])] + [("c", "2", "Hull", "New", versions[i])] * (i == 0)
            df = spark.createDataFrame([(*r[:4], str(r[4])) for r in rows], "collection string, token_id string, trait_type string, value string, v string")
            store.upsert(df.withColumn("v", F.col("v").cast(kind)), f"b{i}", "trait_type", "value", "v")
        store.compact()
        assert len(store._runs()) == 1
        out = {r["token_id"]: r for r in wide_table(store.read(), declared(types), e).collect()}
        assert (out["1"]["hull"], out["1"]["level"], out["1"]["unclear"]) == ("at 2", 2.0, "") and out["2"]["hull"] == "New"


def test_wide_refuses_other_version_types(spark):
    types = spark.createDataFrame(TYPES, "trait_type string, value_type string")
    store = WideStore(spark, work_folder(spark, "w"), types, ["token_id"])
    batch = lambda v, kind: spark.createDataFrame([("1", "Hull", "Oak")], "token_id string, trait_type string, value string").withColumn("v", F.lit(v).cast(kind))
    store.upsert(batch(9, "int"), "b0", "trait_type", "value", "v")
    store.upsert(batch(10, "bigint"), "b1", "trait_type", "value", "v")
    for v, kind in (("10", "string"), (10, "double"), (True, "boolean")):
        with pytest.raises(ValueError):
            store.upsert(batch(v, kind), "b2", "trait_type", "value", "v")
    assert len(store._runs()) == 2 and store.read().count() == 1


def test_wide_query_goes_through_compaction(spark, sf):
    from tidemark.plans.p3_wide import BATCHES, _store

    store = _store(spark, sf)
    state = store.store.state()
    assert BATCHES > 1 and state["version"] == BATCHES + 1 and state["last"].startswith("compaction-") and len(store._runs()) == 1
    assert store.read().schema["cells"].dataType.valueType["__ver"].dataType.simpleString() == "bigint"


# 4 ------------------------------------------------------------------------------------------------
def brute_periods(rows):
    blind, clear = set(), set()
    for e in {r[0] for r in rows if r[0] is not None}:
        merged = []
        for s, t in sorted((s, t) for k, s, t in rows if k == e and s is not None and t is not None and t > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        blind |= {(e, a, b) for a, b in merged}
        clear |= {(e, x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return blind, clear


@pytest.mark.parametrize("seed", range(4))
def test_periods_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(0, 600)]), None) for _ in range(500)]
    rows = [(e, s, None if s is None or rnd.random() < 0.05 else s + rnd.choice([-3, 0, 1, 2, 5, 30, 200 if rnd.random() < 0.05 else 1])) for e, s, _ in rows]
    df = spark.createDataFrame(rows + rows[:50], "who string, s long, t long").withColumn("from", F.lit("clash"))
    blind, clear = periods(df, "who", "s", "t")
    want = brute_periods(rows)
    assert {tuple(r) for r in blind.collect()} == want[0] and blind.count() == len(want[0])
    assert {tuple(r) for r in clear.collect()} == want[1]


def test_periods_empty(spark):
    blind, clear = periods(spark.createDataFrame([], "e string, s long, t long"), "e", "s", "t")
    assert blind.count() == clear.count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-02-01T00:00:00Z", 1706745600000000), ("2024-02-01 00:00:00.5-05:00", 1706763600500000), ("2024-02-30T00:00:00Z", None), ("2024-02-01T24:00:00Z", None), ("T12:00", None), ("", None), (None, None), ("2024-02-01T00:00:00.1234567Z", None), ("0000-01-01T00:00:00Z", None), ("x" * 50_000, None)],
)
def test_instants(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(instant_us(F.col("t"))).first()[0] == want


# 6 ------------------------------------------------------------------------------------------------
def test_late_corrections(spark):
    h = 3_600_000
    rows = [("c", 10, h, 1.0), ("c", 20, h + 120_000, 3.0), ("c", 30, h + 120_001, 5.0), ("c", 40, 7 * h, 7.0), ("c", 50, 7 * h + 1, 9.0), ("c", 60, h, None), ("c", 70, h, float("nan")), (None, 10, h, 1.0), ("c", None, h, 1.0), ("d", h, h, 2.0)]
    df = spark.createDataFrame(rows, "k string, e long, o long, v double")
    counts = value_counts(df, "k", "e", "o", "v", 120_000, 6 * h)
    state = PeriodCounts(spark, work_folder(spark, "t"))
    state.merge(counts, "b0")
    state.merge(counts, "b0")  # a repeated batch changes nothing
    assert sorted(map(tuple, marks(state.read()).collect())) == [("c", 0, "corrected"), ("c", 0, "refused")]
    first = {r["key"]: r for r in issue(state.read(), 0).collect()}
    final = {r["key"]: r for r in issue(state.read(), 1).collect()}
    assert (first["c"]["n"], first["c"]["n_values"], first["c"]["median"]) == (4, 2, 2.0)
    assert (final["c"]["n"], final["c"]["n_distinct"], final["c"]["median"], final["c"]["highest"]) == (6, 4, 4.0, 7.0)
    assert final["d"]["median"] == 2.0
    assert value_counts(df.limit(0), "k", "e", "o", "v", 1, 2).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_late_batches_equal_one(spark, seed):
    """Five batches, late records in each of them, hours closed on the way: the same counts as in one batch."""
    rnd, h = random.Random(seed), 3_600_000
    rows = []
    for _ in range(2_000):
        e = rnd.randrange(0, 120 * h)
        rows.append((rnd.choice(["hot", "hot", "b", "c"]), e, e + rnd.choice([0, 60_000, 3 * h, 8 * h, 50 * h]), rnd.choice([None, 1.0, 2.0, rnd.random()])))
    df = spark.createDataFrame(rows, "k string, e long, o long, v double")
    counts = lambda x: value_counts(x, "k", "e", "o", "v", 120_000, 6 * h)
    many, one = PeriodCounts(spark, work_folder(spark, "t"), splits=8), PeriodCounts(spark, work_folder(spark, "t"))
    edges = arrival_edges(df, "o", 5)
    for i, batch in enumerate(arrival_batches(df, "o", edges)):
        many.merge(counts(batch), f"{i:06d}", int((edges[i] - 6 * h) // h) if i < len(edges) else None)
    one.merge(counts(df), "b0")
    assert sorted(map(str, many.read().collect())) == sorted(map(str, one.read().collect())) and many.store.folders("closed")
    for upto in (0, 1):
        assert sorted(map(str, issue(many.read(), upto).collect())) == sorted(map(str, issue(one.read(), upto).collect()))


def test_period_counts_write_what_changes(spark):
    """Over 20 batches of new hours, each with a late record, what a batch writes doesn't grow."""
    from tidemark.session import folder_bytes

    h, path, wrote = 3_600_000, work_folder(spark, "t"), []
    state = PeriodCounts(spark, path, splits=16)
    for b in range(20):
        rows = [("c", b * 24 + i % 24, 0, float(i), 1) for i in range(600)] + [("c", max(0, b * 24 - 3), 1, -1.0, 1)]
        before = set(state.store.folders("open"))
        state.merge(spark.createDataFrame(rows, PeriodCounts.SCHEMA).coalesce(1), f"{b:06d}", b * 24 - 6)
        wrote.append(sum(folder_bytes(spark, f) for f in set(state.store.folders("open")) - before))
    assert max(wrote[10:]) < 2 * max(wrote[2:10]) and state.read().agg(F.sum("n")).first()[0] == 20 * 601
    assert len(state.store.state()["parts"]["open"]) <= 16 and PeriodCounts(spark, path).store.done("000003")


def test_seen_bitmaps_write_what_changes(spark):
    """What a batch of new identifiers writes doesn't grow, and what is given up goes away."""
    from tidemark.session import folder_bytes

    path, wrote, kept = work_folder(spark, "t"), [], []
    seen = SeenBitmaps(spark, path, "run", "seq", splits=16)
    for b in range(8):
        df = spark.range(b * 40_000, b * 40_000 + 600).select(F.lit("run").alias("run"), F.col("id").alias("seq"))
        before = set(seen.store.folders("bits"))
        seen.apply(df, f"{b:06d}", ["seq"])
        seen.expire([f"{b:06d}"])
        wrote.append(sum(folder_bytes(spark, f) for f in set(seen.store.folders("bits")) - before))
        kept.append(folder_bytes(spark, f"{path}/data"))
    assert max(wrote[4:]) < 2 * max(wrote[:4]) and max(kept[4:]) < 3 * max(kept[:4]) and seen.seen_count() == 8 * 600


def test_two_writers(spark):
    from tidemark.operators.store import Conflict, VersionedStore

    a, b = (VersionedStore(spark, p) for p in [work_folder(spark, "t")] * 2)
    base = a.state()["version"]
    a.commit("x", {}, {}, base=base)
    with pytest.raises(Conflict):
        b.commit("y", {}, {}, base=base)
    assert a.done("x") and not a.done("y")


def test_late_query_merges_several_batches(spark, sf):
    from tidemark.plans.p6_late import BATCHES, _state

    assert BATCHES > 1 and _state(spark, sf).store.state()["version"] == BATCHES


def test_weighted_median(spark):
    rnd = random.Random(6)
    rows = [(f"g{i % 7}" if i % 3 else "hot", float(rnd.randrange(60)), rnd.randrange(1, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, n long").groupBy("g", "v").agg(F.sum("n").alias("n"))
    import statistics

    want = {}
    for g, v, n in rows:
        want.setdefault(g, []).extend([v] * n)
    assert {r["g"]: r["median"] for r in weighted_median(df, ["g"], "v", "n").collect()} == {g: statistics.median(x) for g, x in want.items()}


def test_first_copies(spark):
    rows = [("r", 1, 5, "late"), ("r", 1, 2, "early"), ("r", 1, None, "unseen"), ("r", None, 1, "x"), ("r", None, 1, "x")]
    out = first_copies(spark.createDataFrame(rows, "run string, seq long, o long, c string"), ["run", "seq"], "o", ["c"])
    assert sorted((r["seq"] or 0, r["c"]) for r in out.collect()) == [(0, "x"), (0, "x"), (1, "early")]
