"""Leakage, mixing and residue against brute force, and every defined edge case."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import leakage
from tidemark.llm.leakage import ItemIndex, find_leaks, leaks, shown, visible_words
from tidemark.llm.mixing import capped_mean, mix, mix_plan, mix_report, poisson_rate, replicas, sized, thresholds
from tidemark.llm.queries import QUERIES
from tidemark.llm.residue import find_residue, residue
from tidemark.llm.tokens import token_count

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "zu", "pe") for b in ("ren", "sil", "tor", "vak") for c in ("a", "is", "um")]


def passage(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def disguise(rnd, words):
    out = []
    for w in words:
        w = rnd.choice([w, w.upper(), w.title(), f"<b>{w}</b>", f"**{w}**", f"{w[:2]}​{w[2:]}", "".join(chr(ord(c) + 0xFEE0) for c in w), w.replace("a", "á"), f"{w[:2]}-\n{w[2:]}", f"{w[:2]}­{w[2:]}"])
        out.append(w)
    return "".join(w + rnd.choice([" ", ", ", "\n> ", " ", " — "]) for w in out)


@pytest.mark.parametrize("seed", range(3))
def test_leaks_brute_force(seed):
    leaked = lambda index, texts: [(d, index.ids[k]) for d, k, _, exact in leaks(index, [shown(t) for t in texts]) if exact]
    rnd = random.Random(seed)
    items = [passage(rnd, rnd.choice([5, 12, 20, 40])) for _ in range(30)]
    index = ItemIndex(list(range(30)), [" ".join(i) for i in items], 12)
    texts, want = [], set()
    for d in range(60):
        k = rnd.randrange(30)
        n = rnd.choice([8, 11, 12, 13, 30])
        a = rnd.randrange(max(1, len(items[k]) - n + 1))
        part = items[k][a : a + n]
        texts.append(" ".join(passage(rnd, 30)) + " " + disguise(rnd, part) + " " + " ".join(passage(rnd, 30)))
        if len(part) >= 12:
            want.add((d, k))
    got = set(leaked(index, texts))
    assert want <= got
    # whatever else is found must hold 12 successive words, compared without blanks
    for d, k in got - want:
        flat = "".join(visible_words(texts[d])[0])
        assert any("".join(items[k][i : i + 12]) in flat for i in range(len(items[k]) - 11))


def edit_distance(passage, text):
    """Of a passage to the nearest stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, s, n):
    for _ in range(n):
        i = rnd.randrange(len(s))
        s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + "q" + s[i:], s[:i] + "q" + s[i + 1 :]])
    return s


@pytest.mark.parametrize("seed", range(4))
def test_near_leaks_against_edit_distance(seed):
    rnd = random.Random(seed)
    items = [passage(rnd, rnd.choice([12, 14, 20])) for _ in range(8)]
    index = ItemIndex(list(range(8)), [" ".join(i) for i in items], 12)
    texts = []
    for _ in range(25):
        k = rnd.randrange(8)
        a = rnd.randrange(len(items[k]) - 11)
        texts.append(" ".join(passage(rnd, 8)) + " " + edited(rnd, " ".join(items[k][a : a + 12]), rnd.choice([0, 1, 2, 3, 5])) + " " + " ".join(passage(rnd, 8)))
    got = {(d, k): c for d, k, c, _ in leaks(index, [shown(t) for t in texts])}
    want = {}
    for d, t in enumerate(texts):
        flat = "".join(visible_words(t)[0])
        for k, words in enumerate(items):
            c = min(edit_distance("".join(words[a : a + 12]), flat) for a in range(len(words) - 11))
            if c <= leakage.EDITS:
                want[d, k] = c
    assert got == want and len(set(want.values())) > 1


def test_one_letter_left_out_is_a_near_leak():
    rnd = random.Random(3)
    words = passage(rnd, 16)
    index = ItemIndex([7], [" ".join(words)], 12)
    text = " ".join(words[:8] + [words[8][:-1]] + words[9:])
    assert leaks(index, [shown(text)]) == [(0, 0, 1, False)]


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, " ".join(passage(rnd, 15))) for i in range(12)]
    docs = spark.createDataFrame([(d, " ".join(passage(rnd, 20)) + " " + edited(rnd, items[d % 12][1], d % 3)) for d in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, find_leaks(docs, queries).collect()))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, find_leaks(docs, queries).collect())) == one and len(one) >= 40


def test_leak_edges(spark):
    rnd = random.Random(9)
    item = passage(rnd, 15)
    broken = " ".join(item[:7]) + " uh " + " ".join(item[7:])
    long = " ".join(passage(rnd, 60_000)) + " " + " ".join(item) + " " + " ".join(passage(rnd, 1_000))
    docs = spark.createDataFrame([(1, " ".join(item), "x"), (2, " ".join(item[:11]), "x"), (3, None, "x"), (4, "", "x"), (5, broken, "x"), (6, long, "x"), (7, " ".join(item), "x"), (8, "x" + " ".join(item[:12]) + "x", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    found = find_leaks(docs, items).collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in found if r["exact"]) == [(i, d) for i in (1, 2) for d in (1, 6, 7)]
    assert sorted((r["item_id"], r["doc_id"], r["edits"]) for r in found if not r["exact"]) == [(i, d, c) for i in (1, 2) for d, c in ((5, 2), (8, 0))]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    tiny = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    short = spark.createDataFrame([(1, "z a b c d z"), (2, "zab cd")], "doc_id long, text string")
    assert [r["doc_id"] for r in find_leaks(short, tiny, min_words=4).filter("exact").collect()] == [1]


def test_token_count_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello  world's\n\n café <|endoftext|> 12345", "", "a" * 20_000, "日本語 текст​", " lead"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select(token_count(F.col("t"))).collect()]
    assert got == [len(t.encode(x, add_special_tokens=False).ids) for x in texts] + [0]


def test_capped_poisson():
    for mean, cap in ((0.3, 1), (1.7, 4), (2.9, 3), (0.01, 2)):
        assert capped_mean(poisson_rate(mean, cap), cap) == pytest.approx(mean, abs=1e-6)
    assert thresholds(5.0, 3) == (3, []) and thresholds(0.0, 3) == (0, []) and thresholds(1.0, 0) == (0, [])


@pytest.mark.parametrize(("mean", "cap"), [(1_000.0, 2_000), (1_990.0, 2_000), (699.0, 2_000), (0.3, 2_000), (760.0, 800), (3e5, 1_000_000)])
def test_high_rates_are_reached(mean, cap):
    base, cuts = thresholds(mean, cap)
    assert base + len(cuts) <= cap and base + sum(1.0 - c for c in cuts) == pytest.approx(mean, rel=1e-6) and cuts == sorted(cuts)


def test_mix_of_a_small_source(spark):
    sizes = spark.createDataFrame([(f"s{i}", "small", 1) for i in range(50)] + [("b", "big", 99_950)], "doc_id string, source string, n_tokens long")
    targets = spark.createDataFrame([("small", 0.5, 2_000), ("big", 0.5, 2)], "source string, target_share double, max_repeats int")
    plan = mix_plan(sizes, targets)
    got = {r["source"]: r for r in mix_report(mix(sizes, plan, "doc_id"), plan).collect()}
    assert got["small"]["mixed_tokens"] == pytest.approx(50_000, rel=0.02) and not got["small"]["short"]


def test_mix_shares_and_caps(spark):
    rows = [(i, "big" if i % 10 else "small", "word " * (1 + i % 7), "x") for i in range(6_000)] + [(9_000, "other", "not in the mix", "x"), (9_001, None, "nor this", "x"), (9_002, "small", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    sizes = sized(docs, "text").drop("text").cache()
    plan = mix_plan(sizes, targets)
    out = {r["source"]: r for r in mix_report(mix(sizes, plan, "doc_id"), plan).collect()}
    budget = sum(r["n_tokens"] for r in sizes.collect())
    assert out["big"]["mixed_tokens"] == pytest.approx(0.7 * budget, rel=0.05) and out["small"]["mixed_tokens"] == pytest.approx(0.25 * budget, rel=0.1)
    assert out["none"]["short"] and not out["big"]["short"] and not out["small"]["short"] and out["none"]["actual_share"] == 0
    copies = replicas(sizes, plan, "doc_id")
    assert copies.filter("source = 'big'").agg(F.max("copies")).first()[0] == 1 and copies.filter("source = 'small'").agg(F.max("copies")).first()[0] <= 4
    reach = mix_plan(sizes, targets, "reachable")
    full = {r["source"]: r for r in mix_report(mix(sizes, reach, "doc_id"), reach).collect()}
    assert full["big"]["actual_share"] / full["small"]["actual_share"] == pytest.approx(0.7 / 0.25, rel=0.1) and not full["small"]["short"]
    mixed = mix(sizes, plan, "doc_id")
    places = [r[0] for r in mixed.select("position").collect()]
    assert places == sorted(places)
    assert mixed.agg(F.sum("n_tokens")).first()[0] == sum(r["mixed_tokens"] for r in out.values())
    assert mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert sorted(map(tuple, mixed.select("doc_id", "copy").collect())) == sorted(map(tuple, mix(sizes, plan, "doc_id").select("doc_id", "copy").collect()))
    assert mix(sizes.limit(0), mix_plan(sizes.limit(0), targets), "doc_id").count() == 0


CONTENT = "The floor was 2.29 and the best offer 0.4. Nothing else moved in cobalt-moths during that time."
RESIDUE = [
    "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Veuillez activer JavaScript pour afficher cette page.", "Active JavaScript en su navegador para ver esta página.",
    "Скрипты отключены. Включите JavaScript и обновите страницу.", "404 Not Found", "Error 502. Bad Gateway.", '{"error": {"status": 404, "message": "not found", "trace": "12"}}', "<html><head><title>403 Forbidden</title></head><body><center><h1>403 Forbidden</h1></center></body></html>",
    "Access denied. Your request was blocked by the gate. Incident 273f2d47.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "asdf qwer foo bar test blah xxx asdf", "Your text here ... Your text here ...", "undefined undefined undefined", "[object Object]",
    "This page is down for maintenance. We will be back shortly.", "Seite nicht gefunden (404). Die Adresse wurde verschoben oder gelöscht.",
]
FIELDS = ["{{ slug }}", "${collection}", "%(owner)s", "<%= title %>", "[[started_at]]", "<<owner>>", "@@slug@@", "%TITLE%", "$OWNER$", "__PANEL__", "{floor_price}", "[your slug]", "[INSERT PANEL]", "[owner goes here]", "(TBD: panel)", "XXXX", "<PANEL>", "{{#if panel}}"]
HARMLESS = [
    CONTENT, "In base.yaml a label such as `{{slug}}` is replaced before the spread chart is drawn.", "Set `export STORE=${HOME}/store` before you start the fold.", "The script prints `rows=%d late=%d` for every file.",
    "The spread chart needs JavaScript to draw its bands, which is why the printed version of ember-beetles shows the table only.", "A reader asked why the page not found notice was in English; the operator now translates it along with the live book.",
    "The legend used filler text in the first draft, which the reviewer replaced by the real wording on 2024-02-11.", "Rule 14 rejects a summary that still holds the word TODO; 9 were sent back and rewritten by the operator.",
    "Between 10:00 and 11:00 the upstream returned 502 to 9 of 80 requests; the fold backed off and recovered.", "Something went wrong in the rollup after a long gap, and this is the account of it: it counted one order twice.",
    "Access to cobalt-moths was denied to the old key at noon, so the fold took the second one and carried on.", "It happened because a null was read as an empty string.", "```\n{{ slug }} ${x}\n```\nAs shown above.", 'The banner "Please enable JavaScript" was shown to 4 readers on Monday, and the operator wrote it down.', "", None,
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_alone_and_within_content(text):
    assert sum(residue(text)[:3]) and sum(residue(f"{CONTENT}\n\n{text}\n\n{CONTENT}")[:3])


@pytest.mark.parametrize("field", FIELDS)
def test_fields(field):
    assert residue(f"Most bids in {field} come from one maker.")[0] == 1
    assert not sum(residue(f"A label such as `{field}` is replaced before drawing.")[:3])


# public notices, and sentences of other domains that use the same words
HELD_OUT = [
    "JavaScript seems to be disabled in your browser. For the best experience on our site, be sure to turn on Javascript in your browser.", "Sorry, you have been blocked", "Please turn on JS and disable any ad blocker",
    "Vous devez activer JavaScript pour exécuter cette application.", "Necesitas habilitar JavaScript para ejecutar esta aplicación.", "Error establishing a database connection", "You need to enable JavaScript to run this app.",
    "Sie müssen JavaScript aktivieren, um diese App auszuführen.", "This site requires Javascript in order to view all its content. Please enable Javascript.", "Cookies are disabled in your browser. Please enable cookies and reload the page.",
    "Checking if the site connection is secure", "Attention Required! | Cloudflare", "Just a moment...", "You are being rate limited.", "Our systems have detected unusual traffic from your computer network.", "503 Service Temporarily Unavailable",
    "This site can't be reached", "Please complete the security check to access", "The server encountered an internal error and was unable to complete your request.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
    "You must be signed in to view this page.", "Zu viele Anfragen. Bitte versuchen Sie es später erneut.", "Abilita JavaScript per continuare", "Este site requer JavaScript. Ative o JavaScript no navegador.",
]
HELD_OUT_CONTENT = [
    "Our team compared three browsers and found that scripts loaded fastest in the second one.", "The court blocked the request on Tuesday, and the company said it would appeal within a month.", "To enable JavaScript modules in the bundler, the build now emits one file for each entry point and a map beside it.",
    "The database connection pool is sized at twice the number of cores, which kept the median latency at 4 ms during the test.", "When cookies are baked at a lower heat they spread more slowly and stay soft in the middle.", "Moments later the server brought the bill, and we left for the station.",
    "The review found that access was denied to 14 of 300 applicants, most of them for want of a second document.", "Unusual traffic patterns on the bridge were traced to the closure of the tunnel two miles north.", "He signed in at the front desk and continued to the third floor, where the page was waiting for him.",
    "Researchers disabled the gene in mice and saw no change in weight over twelve weeks.", "La page de garde porte le nom de l'auteur et la date de la première édition.", "Die Seite des Hauses, die zur Straße liegt, wurde im Frühjahr neu gestrichen.",
]


def test_held_out_notices():
    """Notices as the web has them, beside the planted ones. The lists were written with such notices in mind, so this is no independent estimate of recall."""
    hit, wrong = [t for t in HELD_OUT if residue(t)[2]], [t for t in HELD_OUT_CONTENT if sum(residue(t)[:3])]
    assert len(hit) >= 0.8 * len(HELD_OUT) and not wrong, (set(HELD_OUT) - set(hit), wrong)


def test_fields_and_quotations_of_any_length():
    assert residue(f"Most bids in {{{{ {'owner_' * 30}name }}}} come from one maker.")[0] == 1
    assert residue(f"It said \"{'so it goes on ' * 30}{{{{slug}}}} and so on\" in the first line.")[0] == 0


def test_exclusion_is_by_coverage():
    assert residue(RESIDUE[0])[3] > 0.9 and 0 < residue(f"{CONTENT}\n{CONTENT}\n{RESIDUE[5]}")[3] < 0.4 and 0 < residue(f"{CONTENT} {{{{slug}}}}")[3] < 0.2


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert not sum(residue(text)[:3])


@pytest.mark.parametrize(
    "text",
    [
        "p < 0.05\nPlease enable JavaScript to continue.\nx > 3", "<td>undefined</td>", "The log follows. ValueError: bad input", "好。undefined", "null5", "ündefined",
        "See <x. Please enable> <b>JavaScript</b> to continue",
    ],
)
def test_prefilter_keeps_notices(text):
    assert residue(text)[2] >= 1


def test_prefilter_is_a_superset(monkeypatch):
    rnd = random.Random(9)
    bits = ["Please enable JavaScript to continue", "undefined", "null", "lorem ipsum dolor sit amet consectetur", "asdf qwerty", "ValueError: x", "[object Object]", "the river", "<", ">", "<b>", "</b>", ". ", "! ", "。", "\n", " ", " ", "5", "x"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 9))) for _ in range(4_000)]
    got = [residue(t) for t in texts]
    monkeypatch.setattr("tidemark.llm.residue._suspect", lambda _: True)
    assert got == [residue(t) for t in texts]


def test_residue_frame(spark):
    rows = [(1, RESIDUE[0], 1.0), (1, RESIDUE[0], 1.0), (2, CONTENT * 3_000, 1.0), (3, CONTENT * 3_000 + "\n" + RESIDUE[0], 1.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    out = sorted((r["doc_id"], r["holds_residue"], r["excluded"], r["coverage"] > 0.9) for r in find_residue(df).collect())
    assert out == [(1, True, True, True), (1, True, True, True), (2, False, False, False), (3, True, False, False), (4, False, False, False)]
    assert find_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, sf, name):
    df = QUERIES[name][0](spark, sf)
    rows = df.collect()
    assert len(rows) == len(set(map(tuple, rows)))
