"""Reference semantics of the domain operators on hand-made cases and against brute force."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.grid import ZONE, bucket_floor, bucket_grid, bucket_start, range_start, transform
from tidemark.operators.intervals import asof_join, covered_whole, silences, subtract
from tidemark.operators.ledger import Listing, detail_and_count, plan_facts
from tidemark.operators.lives import fold_lives
from tidemark.operators.quality import check_json, closure, cycles, json_schema
from tidemark.operators.simulate import Model, mulberry32, rk4
from tidemark.operators.standing import segments, standing_series
from tidemark.operators.survival import CAUSES, episodes, km_curve, rmst
from tidemark.operators.tags import parse_filter, parse_token_range
from tidemark.sources.envelopes import ENVELOPE, frame_counts, order_criteria, parse_envelopes, unparsed
from tidemark.sources.landing import checksums, files_for_event_range, manifest, read_landing, verify_manifest, write_landing
from tidemark.streaming.fold import HourlyRollup, LatePeriods, LiveFold, read_envelopes, start

EVENT = "order_hash string, event_type string, valid_ts double, expiration_ts double, observed_ts double, run string, seq long, conn string, dedup_key string, collection string, token_id string, maker string, quantity long, price_eth double"


def events(spark, rows):
    """rows: (hash, type, valid_ts, expiration, [conn, key])"""
    full = [(r[0], r[1], r[2], r[3], float(i), "r", i, r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else f"k{i}", "c", "1", "m", 1, 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def test_life_cases(spark):
    n = None
    rows = [
        *[("A", t, x, n) for x, t in enumerate(["item_listed", "item_cancelled", "order_invalidate", "order_revalidate"])],
        *[("B", t, float(x), n) for x, t in enumerate(["item_listed", "order_invalidate", "order_revalidate", "order_invalidate"])],
        *[("C", t, float(x), n) for x, t in enumerate(["item_listed", "item_sold", "order_revalidate"])],
        ("D", "item_listed", 0.0, n), ("D", "order_invalidate", 5.0, n), ("D", "order_revalidate", 5.0, n),
        *[("E", t, float(x), n) for x, t in enumerate(["item_listed", "order_revalidate", "order_invalidate"])],
        ("F", "item_listed", 0.0, n),
        ("G", "item_listed", 3.0, n), ("G", "item_cancelled", 3.0, n),
        ("H", "item_listed", 0.0, 50.0),
        ("H2", "item_listed", 0.0, 150.0),
        ("I", "item_cancelled", 1.0, n),
        ("J", "item_listed", 0.0, n), ("J", "item_cancelled", None, n),
        ("K", "item_listed", 9.0, n), ("K", "item_cancelled", 1.0, n),
        ("L", "item_listed", 0.0, n, None, "p"), ("L", "item_cancelled", 4.0, n, None, "q"), ("L", "item_cancelled", 4.0, n, "b", "q"), ("L", "item_cancelled", 4.0, n, "b", "q"),
        (None, "item_listed", 0.0, n),
    ]
    rows = [(a, b, None if c is None else float(c), *d) for a, b, c, *d in rows]
    out = {r["order_hash"]: r for r in fold_lives(events(spark, rows), 100.0).collect()}
    want = {"A": ("cancelled", 1.0), "B": ("invalidated", 3.0), "C": ("filled", 1.0), "D": ("invalidated", 5.0), "E": ("invalidated", 2.0), "F": ("censored", None), "G": ("cancelled", 3.0), "H": ("expired", 50.0), "H2": ("censored", None), "I": ("cancelled", 1.0), "J": ("unknown", None), "K": ("unknown", None), "L": ("cancelled", 4.0)}
    assert {k: (r["exit_reason"], r["t_term"]) for k, r in out.items()} == want
    assert out["I"]["placement_seen"] == 0 and out["H"]["exit_source"] == "derived"
    assert (out["L"]["duplicates_merged"], out["L"]["deliveries_b"], out["L"]["multiplicity_disagreements"], out["L"]["terminations_seen"]) == (2, 2, 1, 1)


@pytest.mark.parametrize("interval", ["1h", "6h", "1d", "2d", "1w", "1mo", "3mo", "1y"])
def test_buckets_agree_with_the_driver(spark, interval):
    rnd = random.Random(3)
    ts = [1_710_000_000 + rnd.random() * 2e7 for _ in range(200)] + [1_710_057_599.0, 1_710_057_600.0, 1_710_144_000.0]
    got = spark.createDataFrame([(t,) for t in ts], "t double").select("t", bucket_start(F.col("t"), interval).alias("b")).collect()
    assert all(r["b"] == bucket_floor(r["t"], interval) for r in got)
    grid = bucket_grid(spark, ts[0], ts[0] + 86_400 * 120, interval).orderBy("bucket").collect()
    assert grid[0]["bucket"] <= ts[0] and all(a["bucket_end"] == b["bucket"] for a, b in zip(grid, grid[1:]))


def test_grid_guards(spark):
    with pytest.raises(ValueError):
        bucket_grid(spark, 0, 3e9, "1m")
    assert range_start("DTD", 1_710_120_661.0, ZONE) == 1_710_050_400.0
    with pytest.raises(ValueError):
        range_start("7y", 0.0)


def test_transform_starts_at_first_value(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, 3.0), (4, 0.0)], "bucket long, value double")
    vals = lambda k: [r["value"] for r in transform(df, k).orderBy("bucket").collect()]
    assert vals("DIFF") == [None, 0.0, None, 1.0, -2.0] and vals("PCT")[3] == 50.0 and vals("LOG")[4] is None


def brute_best(intervals, want, t):
    live = [p for a, z, p in intervals if a <= t < z]
    return (min if want == "min" else max)(live) if live else None


@pytest.mark.parametrize("seed", range(3))
def test_standing_segments_brute_force(spark, seed):
    rnd = random.Random(seed)
    ask = [(a := rnd.randrange(0, 5_000), a + rnd.choice([1, 7, 300, 2_500]), float(rnd.randrange(1, 30))) for _ in range(120)]
    bid = [(a := rnd.randrange(0, 5_000), a + rnd.choice([1, 7, 300, 2_500]), float(rnd.randrange(1, 30))) for _ in range(60)]
    frame = lambda x: spark.createDataFrame([("k", str(i), *r) for i, r in enumerate(x)], "key string, id string, a long, z long, price double")
    out = segments({"ask": (frame(ask), "min"), "bid": (frame(bid), "max")}, 1_000).collect()
    assert sum(r["t1"] - r["t0"] for r in out) == 1_000 * len({r["bucket"] for r in out})
    for r in out:
        assert r["ask"] == brute_best(ask, "min", r["t0"]) and r["bid"] == brute_best(bid, "max", r["t0"])
        assert r["ask"] == brute_best(ask, "min", r["t1"] - 1)
    s = {r["bucket"]: r for r in standing_series(frame(ask), "min", 1_000, min_n=1).collect()}
    for b, r in s.items():
        per = sorted(p for t in range(b * 1000, b * 1000 + 1000) if (p := brute_best(ask, "min", t)) is not None)
        assert r["live_s"] == len(per) / 1000
        assert r["median"] == per[math.ceil(len(per) * 0.5) - 1] and r["p90"] == per[math.ceil(len(per) * 0.9 - 1e-9) - 1]


def test_km_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [("g", float(rnd.randrange(1, 40)), c := rnd.choice([None, *CAUSES]), c is not None) for _ in range(300)]
    obs = spark.createDataFrame(rows, "g string, duration double, cause string, ended boolean")
    curve = km_curve(obs, ["g"]).orderBy("t").collect()
    s, cif = 1.0, dict.fromkeys(CAUSES, 0.0)
    at = {r["t"]: r for r in curve}
    for t in sorted({d for _, d, _, e in rows if e}):
        n = sum(d >= t for _, d, _, _ in rows)
        dead = [c for _, d, c, e in rows if e and d == t]
        for c in dead:
            cif[c] += s / n
        s *= 1 - len(dead) / n
        r = at[t]
        assert r["at_risk"] == n and r["s"] == pytest.approx(s, abs=1e-12) and sum(r[f"cif_{c}"] for c in CAUSES) == pytest.approx(1 - s, abs=1e-9)
        assert all(r[f"cif_{c}"] == pytest.approx(cif[c], abs=1e-9) for c in CAUSES)
    area, prev, level = 0.0, 0.0, 1.0
    for r in [*[r for r in curve if r["t"] <= 20], {"t": 20.0, "s": 0}]:
        area, prev, level = area + level * (r["t"] - prev), r["t"], r["s"]
    assert rmst(km_curve(obs, ["g"]), obs, ["g"], 20.0).first()["rmst"] == pytest.approx(area, abs=1e-9)
    assert rmst(km_curve(obs, ["g"]), obs, ["g"], 99.0).first()["rmst"] is None


def test_episodes_part_at_exactly_eps(spark):
    rows = [("1", "m", "item", "1", 0.0), ("2", "m", "item", "1", 59.0), ("3", "m", "item", "1", 119.0), ("4", "m", "item", "2", 119.0), ("5", None, "item", "1", 0.0), ("6", None, "x", "9", 900.0)]
    out = {r["order_hash"]: r["episode"] for r in episodes(spark.createDataFrame(rows, "order_hash string, maker string, scope_kind string, token_id string, t_place double"), 60.0).collect()}
    assert out == {"1": 1, "2": 1, "3": 2, "4": 1, "5": 0, "6": 0}


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra_brute_force(spark, seed):
    rnd = random.Random(seed)
    make = lambda n: [("e", a := rnd.randrange(300), a + rnd.randrange(0, 40)) for _ in range(n)]
    cover, blind = make(25), make(15)
    frame = lambda x: spark.createDataFrame(x, "e string, `from` long, `to` long")
    on = [any(a <= t < b for _, a, b in cover) and not any(a <= t < b for _, a, b in blind) for t in range(400)]
    want = {(i, next(j for j in range(i, 400) if not on[j])) for i in range(400) if on[i] and not (i and on[i - 1])}
    assert {(r["from"], r["to"]) for r in subtract(frame(cover), frame(blind), "e").collect()} == want
    spans = frame(make(30)).filter("to > from")
    got = {tuple(r) for r in covered_whole(spans, frame(cover), "e").collect()}
    held = lambda a, b: all(any(x <= t < y for _, x, y in cover) for t in range(a, b))
    assert got == {tuple(r) for r in spans.collect() if held(r["from"], r["to"])}


def test_asof_join_brute_force(spark):
    rnd = random.Random(8)
    left = [(rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *range(50)]), i) for i in range(300)]
    right = [(rnd.choice(["hot", "b", None]), rnd.choice([None, *range(50)]), float(rnd.randrange(9))) for _ in range(80)]
    out = asof_join(spark.createDataFrame(left, "k string, t long, v int"), spark.createDataFrame(right, "k string, u long, v double"), ["k"], "t", "u", ["v"]).collect()
    assert len(out) == len(left)
    for k, t, v, w in map(tuple, out):
        best = max(((u, x) for kk, u, x in right if kk == k and k is not None and u is not None and t is not None and u <= t), default=(None, None))
        assert w == best[1]


def test_silences(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 5.0), ("a", 20.0), ("b", 100.0)], "c string, t double")
    assert [tuple(r) for r in silences(df, ["c"], "t", 10.0).collect()] == [("a", 5.0, 20.0)]


@pytest.mark.parametrize("sort", ["price_eth", "token_num", "maker"])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_walk_everything_once(spark, sort, descending):
    rnd = random.Random(8)
    rows = [(rnd.choice(["r1", "r2"]), i, rnd.choice([None, 1.0, 2.5, 0.1 + 0.2, rnd.random()]), rnd.choice([None, "9", "10", "007", "x"]), rnd.choice([None, "m", "n", 'o"{'])) for i in range(95)]
    df = spark.createDataFrame(rows, "run string, seq long, price_eth double, token_id string, maker string")
    listing, seen, mark = Listing(df, sort, descending), [], None
    while True:
        shown = listing.page(20, mark)
        got = [(r[sort], r["run"], r["seq"]) for r in shown.collect()]
        seen += got
        mark = listing.mark(shown)
        if mark is None:
            break
        last = mark
    low = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert len(seen) == 95 and seen == sorted(seen, key=low, reverse=descending)
    for other in (Listing(df, sort, not descending), Listing(df, sort, descending, {"maker": "m"})):
        with pytest.raises(ValueError):
            other.page(10, last)
    for call in (lambda: listing.page(10, "not a mark"), lambda: listing.page(501), lambda: Listing(df, "token_id", True), lambda: Listing(df, "nothing", True)):
        with pytest.raises(ValueError):
            call()


def test_listing_filters_and_plan(spark, tmp_path):
    rows = spark.createDataFrame([("r", i, float(i), "c", str(i), 0.5) for i in range(40)], "run string, seq long, valid_ts double, collection string, token_id string, price_eth double")
    tags = spark.createDataFrame([("c", str(i), "Hull", "Oak" if i % 2 else "Elm") for i in range(40)], "collection string, token_id string, trait_type string, value string")
    listing = Listing(rows, "valid_ts", True, {"collection": "c", "tokens": (5, 20)}, {"Hull": ["Oak"]}, tags)
    assert [r["seq"] for r in listing.page(100).collect()] == [19, 17, 15, 13, 11, 9, 7, 5]
    rows.write.parquet(f"file://{tmp_path}/p")
    facts = plan_facts(Listing(spark.read.parquet(f"file://{tmp_path}/p"), "valid_ts", True, {"collection": "c"}).page(10).select("run", "seq", "valid_ts"))
    assert facts["top_n"] == 1 and facts["sorts"] == 0 and len(facts["scans"]) == 1 and "EqualTo(collection,c)" in facts["scans"][0]["pushed"] and "price_eth" not in facts["scans"][0]["columns"]
    shown, n = detail_and_count(rows, [F.desc("seq")], 3)
    assert [r["seq"] for r in shown.collect()] == [39, 38, 37] and n.first()[0] == 40


def test_filters():
    assert parse_filter("A:x|y;B:z") == {"A": ["x", "y"], "B": ["z"]}
    assert parse_token_range("4-500") == (4, 500) and parse_token_range("#7") == (7, 7) and parse_token_range("4–") == (4, None)
    for bad in ("", "9-4", "x"):
        with pytest.raises(ValueError):
            parse_token_range(bad)
    with pytest.raises(ValueError):
        parse_filter("A:")


def test_envelopes(spark, tmp_path):
    ok = '{"event":"trait_offer","payload":{"sent_at":"2024-02-01T00:00:05Z","payload":{"event_timestamp":"2024-02-01T00:00:00Z","collection":{"slug":"c"},"item":{"nft_id":"ethereum/0xc/7"},"order_hash":"h","maker":{"address":"m"},"base_price":"123456789012345678901234567890","quantity":2,"trait_criteria_list":[{"trait_type":"A","value":"x"}],"numeric_trait_criteria_list":[{"trait_type":"L","min":1,"max":5}]}}}'
    array = '["1","2","t","item_sold",{"sent_at":"2024-02-01T00:00:09Z","payload":{"order_hash":"h2"}}]'
    raw = [(1, ok, None), (2, array, None), (3, "not json", None), (4, '{"event":"odd","payload":{}}', None), (5, ok, "__control__"), (6, "[1]", None)]
    df = spark.createDataFrame([(i, "r", f"2024-02-01T0{i % 3}:00:10Z", t, "2024-02-01T00:00:00Z", x) for i, x, t in raw], ENVELOPE)
    out = {r["seq"]: r for r in parse_envelopes(df).collect()}
    assert set(out) == {1, 2} and out[1]["token_id"] == "7" and out[1]["price_wei"] == "123456789012345678901234567890" and out[1]["quantity"] == 2
    assert out[2]["valid_at"] == "2024-02-01T00:00:09Z" and out[2]["dedup_key"] is None and len(out[1]["dedup_key"]) == 64
    assert {r["_seq"]: r["reason"] for r in unparsed(df).collect()} == {3: "not JSON", 4: "unknown event", 6: "no event"}
    assert [(r["idx"], r["kind"], r["trait_type"]) for r in order_criteria(parse_envelopes(df)).collect()] == [(0, "string", "A"), (1, "numeric", "L")]
    # the landing zone: what is written is read again, the manifest agrees, a damaged file is named
    path = f"file://{tmp_path}/landing"
    write_landing(df, path)
    rows = read_landing(spark, path)
    assert rows.count() == 6 and {r[0] for r in rows.select("hour").distinct().collect()} == {"00", "01", "02"}
    recorded = manifest(rows).join(checksums(spark, path), "file").withColumn("closed", F.lit(True)).cache()
    recorded.count()
    assert verify_manifest(spark, path, recorded).count() == 0
    assert files_for_event_range(recorded, 0, 1).count() == 0 and files_for_event_range(recorded, 1706745600000000, 1706745600000001).count() == recorded.count()
    wrong = recorded.withColumn("sha256", F.when(F.col("first_seq") == 1, F.lit("0")).otherwise(F.col("sha256")))
    assert [r["problem"] for r in verify_manifest(spark, path, wrong).collect()] == ["CHECKSUM MISMATCH"]


@pytest.mark.parametrize("codec", ["gzip", "none"])
def test_torn_files_give_what_is_whole(spark, tmp_path, codec):
    import glob

    df = spark.range(20_000).select(F.col("id").alias("_seq"), F.lit("r").alias("_run"), F.lit("2024-02-01T00:00:10Z").alias("_recv"), F.lit("t").alias("_topic"), F.lit(None).cast("string").alias("_ets"), F.sha2(F.col("id").cast("string"), 256).alias("raw")).coalesce(1)
    path = f"file://{tmp_path}/landing"
    write_landing(df, path, codec)
    recorded = manifest(read_landing(spark, path)).join(checksums(spark, path), "file").withColumn("closed", F.lit(True)).cache()
    assert recorded.count() == 1 and verify_manifest(spark, path, recorded).count() == 0
    name = glob.glob(f"{tmp_path}/landing/*/*/*.json*")[0]
    with open(name, "r+b") as f:
        f.truncate(os.path.getsize(name) // 2)
    for crc in glob.glob(f"{tmp_path}/landing/*/*/.*.crc"):
        os.remove(crc)
    n = read_landing(spark, path).count()
    assert 1_000 < n < 19_000
    assert [r["problem"] for r in verify_manifest(spark, path, recorded).collect()] == ["CHECKSUM MISMATCH" if codec == "none" else "UNREADABLE"]
    if codec != "none":
        with pytest.raises(Exception):  # noqa: B017 - whatever the codec throws
            read_landing(spark, path, tolerant=False).count()


def test_token_ids_of_received_bids(spark):
    import json

    items = lambda *x: [{"itemType": k, "identifierOrCriteria": i, "token": t} for k, i, t in x]
    payloads = [
        {"item": {"nft_id": "ethereum/0xa/7"}, "protocol_data": {"parameters": {"consideration": items((2, "9", "0xb"))}}},
        {"protocol_data": {"parameters": {"consideration": items((1, "0", "0xm"), (2, "9", "0xb")), "offer": items((3, "8", "0xc"))}}},
        {"item": {"nft_id": "ethereum/0xa"}, "protocol_data": {"parameters": {"consideration": items((1, "5", "0xm")), "offer": items((3, "8", "0xc"))}}},
        {"asset_contract_criteria": {"address": "0xd"}},
    ]
    df = spark.createDataFrame([(i, "r", "2024-02-01T00:00:10Z", "t", "2024-02-01T00:00:0%dZ" % (9 - i if i == 2 else i), json.dumps({"event": "item_received_bid", "payload": {"payload": p}})) for i, p in enumerate(payloads)], ENVELOPE)
    assert [(r["contract"], r["token_id"]) for r in parse_envelopes(df).orderBy("seq").collect()] == [("0xa", "7"), ("0xb", "9"), ("0xa", "8"), ("0xd", None)]
    one = frame_counts(df).first()
    assert (one["frames"], one["events"], one["without_time"], one["controls"], one["out_of_order"]) == (4, 4, 0, 0, 1)


def test_streams_equal_batch(spark, tmp_path, sf):
    """Envelopes in several files through the streaming folds give what the batch operators give."""
    from tidemark.operators.late import first_copies, value_counts
    from tidemark.operators.rollup import hourly
    from tidemark.session import table
    from tidemark.sources.envelopes import to_envelopes

    rows = table(spark, sf, "market_events").filter("observed_ts < 1706900000")
    landing, now = f"file://{tmp_path}/in", 1_709_251_200.0
    to_envelopes(rows).repartition(2).withColumn("dt", F.lit("d")).write.partitionBy("dt").json(landing)
    stream = lambda n=1: parse_for_fold(read_envelopes(spark, landing, n))

    def parse_for_fold(df):
        return df.withColumns({"conn": F.lit(None).cast("string"), "price_eth": F.col("price_wei").try_cast("double") / 1e18})

    fold = LiveFold(spark, f"file://{tmp_path}/fold", lambda: now)
    start(stream(), fold, f"file://{tmp_path}/c1").awaitTermination(120)
    whole = parse_for_fold(parse_envelopes(read_landing(spark, landing).drop("file")))
    once = first_copies(whole, ["run", "seq"], "observed_ts", [c for c in whole.columns if c not in ("run", "seq", "observed_ts")])
    cols = ["order_hash", "event_type", "t_place", "t_term", "exit_reason", "terminations_seen"]
    got, want = (sorted(map(str, x.select(*cols).collect())) for x in (fold.lives.read("lives"), fold_lives(once, now)))
    assert got == want and len(got) > 10
    roll = HourlyRollup(spark, f"file://{tmp_path}/roll")
    start(stream(), roll, f"file://{tmp_path}/c2").awaitTermination(120)
    assert sorted(map(str, roll.read().select("collection", "hour", "maker", "event_type", "n").collect())) == sorted(map(str, hourly(once).select("collection", "hour", "maker", "event_type", "n").collect()))
    assert not fold.refold_if_stale() and sorted(map(str, fold.lives.read("lives").select(*cols).collect())) == want
    newer = LiveFold(spark, f"file://{tmp_path}/fold", lambda: now, method=2)
    assert newer.refold_if_stale() and not newer.refold_if_stale() and sorted(map(str, newer.lives.read("lives").select(*cols).collect())) == want
    late = LatePeriods(spark, f"file://{tmp_path}/late", 120_000, 21_600_000)
    start(stream(9), late, f"file://{tmp_path}/c3").awaitTermination(120)
    assert late.counts.read().agg(F.sum("n")).first()[0] == once.filter("collection is not null and valid_ts is not null").count()


def test_lives_expire_while_the_fold_runs(spark, tmp_path):
    clock = [50.0]
    fold = LiveFold(spark, f"file://{tmp_path}/fold", lambda: clock[0], splits=4)
    fold(events(spark, [("A", "item_listed", 0.0, 100.0), ("B", "item_listed", 0.0, None)]), 0)
    reasons = lambda: {r["order_hash"]: r["exit_reason"] for r in fold.lives.read("lives").collect()}
    assert reasons() == {"A": "censored", "B": "censored"}
    clock[0] = 200.0
    fold(events(spark, [("C", "item_listed", 150.0, None)]).withColumn("run", F.lit("s")), 1)
    assert reasons() == {"A": "expired", "B": "censored", "C": "censored"}
    fold(events(spark, [("C", "item_listed", 150.0, None)]).withColumn("run", F.lit("s")), 1)  # the same batch again
    assert reasons() == {"A": "expired", "B": "censored", "C": "censored"} and fold.events.read("events").count() == 3


def test_late_stream_takes_the_first_observed_copy(spark, tmp_path):
    h = 3_600.0
    rows = lambda x: spark.createDataFrame(x, "run string, seq long, observed_ts double, valid_ts double, collection string, price_eth double")
    late = LatePeriods(spark, f"file://{tmp_path}/late", 120_000, 21_600_000, splits=4)
    late(rows([("r", 1, 8 * h, 10.0, "c", 5.0), ("r", 2, h, 20.0, "c", 1.0)]), 0)
    counts = lambda: sorted((r["round"], r["value"], r["n"]) for r in late.counts.read().collect())
    assert counts() == [(0, 1.0, 1), (2, 5.0, 1)]
    late(rows([("r", 1, h, 10.0, "c", 7.0), ("r", 2, 2 * h, 20.0, "c", 9.0)]), 1)  # message 1 was observed earlier by this copy
    assert counts() == [(0, 1.0, 1), (0, 7.0, 1)]
    late(rows([("r", 1, 0.5 * h, 10.0, "c", 8.0)]), 2)
    assert counts() == [(0, 1.0, 1), (0, 8.0, 1)]


def test_package_reaches_the_workers(tmp_path):
    """Started from elsewhere, with the package on the driver's path only."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tidemark.session import build_session, table
from tidemark.operators.simulate import simulate
from tidemark.plans import simulation
spark = build_session("t", "local[2]")
table(spark, {os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")!r}, "region")
print("rows", simulation.baseline(spark, "").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 148" in out.stdout, out.stderr[-2000:]


def test_json_schema(spark):
    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^[a-z]+$"}, "n": {"type": "integer", "minimum": 0}, "t": {"type": "array", "uniqueItems": True, "items": {"enum": [1, True]}}, "u": {"oneOf": [{"type": "string"}, {"type": "number"}]}}, "if": {"required": ["n"]}, "then": {"required": ["t"]}}
    bad = lambda v: sorted(w for _, w, _ in check_json(v, schema, schema))
    assert bad({"id": "a"}) == [] and bad({"id": "A", "x": 1}) == ["pattern", "unknown-key"] and bad({"id": "a", "n": -1}) == ["minimum", "required"]
    assert bad({"id": "a", "t": [1, 1.0]}) == ["uniqueItems"] and bad({"id": "a", "t": [1, True]}) == [] and bad({"id": "a", "u": []}) == ["oneOf"] and bad([]) == ["required"] * 0 + ["type"]
    df = spark.createDataFrame([(1, '{"id":"a"}'), (2, '{"id":NaN}'), (3, None), (4, '{"id":"B"}')], "k int, t string")
    assert sorted((r["place"].split("/")[0], r["code"]) for r in json_schema(df, "k", "t", schema).collect()) == [("2", "unreadable"), ("3", "unreadable"), ("4", "schema-pattern")]


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", None)], "c string, p string")
    assert {r["place"] for r in cycles(edges, "c", "p").collect()} == {"a", "b"}


def test_closure_of_any_depth(spark):
    chain = [(i, i + 1) for i in range(100)]
    ring = [(1_000 + i, 1_000 + (i + 1) % 40) for i in range(40)]
    edges = spark.createDataFrame([*chain, *ring, (0, 50), (500, 1_000), (None, 1), (1, None)], "c int, p int")
    got = {(r["child"], r["ancestor"]): r["depth"] for r in closure(edges, "c", "p").collect()}
    up = {}
    for c, p in [*chain, *ring, (0, 50), (500, 1_000)]:
        up.setdefault(c, []).append(p)
    want = {}
    for c in up:
        front, depth = set(up[c]), 1
        while front:
            want |= {(c, p): depth for p in front}
            front, depth = {q for p in front for q in up.get(p, []) if (c, q) not in want}, depth + 1
    assert got == want and want[(0, 100)] == 51
    assert {r["place"]: r["message"] for r in cycles(edges, "c", "p").collect()} == {str(c): "40" for c, _ in ring}


def test_solver_converges_and_boluses_are_exact():
    import numpy as np

    decay = Model(("x",), lambda t, y, p, u: -p["k"] * y + u, lambda p: [np.ones_like(p["k"])])
    p = {"k": np.array([0.1, 0.5])}
    _, y = rk4(decay, p, [], 10.0, 0.1, 1.0)
    assert np.allclose(y[0, -1], np.exp(-p["k"] * 10), rtol=1e-6)
    tank = Model(("x",), lambda t, y, p, u: y * 0 + u, lambda p: [np.zeros_like(p["k"])])
    t, y = rk4(tank, p, [(3.3, 1.7, np.array([2.0, 5.0]))], 10.0, 1.0, 2.0)
    assert np.allclose(y[0, -1], [2.0, 5.0]) and np.allclose(y[0, list(t).index(2.0)], 0)
    draw = mulberry32(1)
    assert all(0 <= draw() < 1 for _ in range(100))
