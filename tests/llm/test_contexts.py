import time
import math
import itertools
import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F
from reelmill.llm import contexts as cx
from reelmill.llm.queries import op5_contexts

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    n = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))]
        return 16 <= len(n) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 8 <= len(n) <= 15


def base_by_hand(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = cx.find(df).collect()
    return {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings if f.base] for r in rows}


def test_base_patterns(spark):
    rng = random.Random(11)
    texts = ["a@b.c_d@e.f", "a@b@c.de", "x@a.b.", "1.2.3.4.5.6.7.8", "00255.1.1.1 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (017) 555-7713.", "+1((((((", "é\U0001f600 a.b@c.d +49 30 1234567", " a@b.c", "0" * 16, "4111111111111111" * 2]
    for alphabet in ("a.@-_ ", "12. -", "+1() .-", "a1@.+ -(é"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    for _ in range(200):
        n = [rng.randrange(10) for _ in range(rng.choice([15, 16, 17, 19, 20]))]
        texts.append(rng.choice(["", " ", "7 ", "x"]) + "".join(str(c) + rng.choice(["", "", "", " ", "-"]) for c in n) + rng.choice(["", ".", " x"]))
    got = base_of(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == base_by_hand(t), repr(t)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_contexts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_by_hand(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in cx.KINDS)
        spans = [x for x in r.spans.split(",") if x]
        assert set(joined.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_discovered


def taught():
    """Phones after 'call me', e-mails after 'write to'; unseen forms in the same places, and elsewhere."""
    texts = [f"please call me +1 (200) 555-{1000 + i} today" for i in range(8)] + [f"you may write to user{i}@mail.example.com soon" for i in range(8)]
    return texts + ["please call me 555 123 4567 today", "you may write to root@localhost soon", "it costs 555 123 4567 units", "please call me 12 today"]


def test_discovers_unseen_identifiers(spark):
    texts = taught()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {(f.kind, texts[r.doc_id][f.start : f.end]) for r in cx.find(df).collect() for f in r.findings if not f.base}
    assert more == {("phone", "555 123 4567"), ("email", "root@localhost")}
    where = {r.doc_id for r in cx.find(df).collect() for f in r.findings if not f.base}
    assert where == {16, 17}


def test_turns_reach_further(spark):
    # The seeds teach 'call me'; the unseen form in it teaches 'ring us', which no seed has but one.
    texts = taught()[:8] + [f"please call me 555 000 {i}{i}{i}{i} now" for i in range(1, 3)]
    edges = cx.occurrences(cx.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    first = {r.pattern: r.confidence for r in cx.confident_patterns(edges, 1).collect()}
    third = {r.pattern: r.confidence for r in cx.confident_patterns(edges, 3).collect()}
    assert third["call me _"] > first.get("call me _", 0) and third["call me _"] >= cx.CONFIDENCE


def test_redacts(spark):
    texts = ["mail a.b@c.de, now", None, "", "nothing", "é\U0001f600 1.2.3.4 and 4111 1111 1111 1111", "+4111 1111 1111 111a@b.cd", "a@b.cd", "nothing"]
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, findings string")
    out = cx.redact(df)
    assert out.columns == df.columns and out.schema == df.schema or [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "mail <EMAIL>, now", 1: None, 2: "", 3: "nothing", 4: "é\U0001f600 <IP> and <CARD>", 5: "<PHONE>", 6: "<EMAIL>", 7: "nothing"}
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a@b.cd", 1), (None, None, 2), (3, "a@b.cd", 3), (3, "a@b.cd", 3), (4, "9" * 50000, 4), (5, "x" * 50000 + "@", 5), (6, "((((" * 5000, 6)], "doc_id long, text string, email int")
    rows = cx.find(df).collect()
    assert sorted(len([f for f in r.findings if f.kind == "email"]) for r in rows) == [0, 0, 0, 0, 1, 1, 1]
    assert cx.find(df.limit(0)).count() == 0 and cx.redact(df.limit(0)).count() == 0
    assert sorted(r.text or "" for r in cx.redact(df).collect())[1] == "((((" * 5000


def test_no_python_in_the_plan(spark):
    plan = op5_contexts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_identifiers_in_a_row_are_several(spark):
    texts = taught()[:8] + ["please call me 020 7946 0001 / 020 7946 1001 today", "please call me 020 7946 0958 2024-01-01", "please call me 020 7946 0959 10.0.0.1 or so"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = {r.doc_id: [c["value"] for c in r.candidate] for r in cx.scan(df).collect()}
    assert listed[8] == ["020 7946 0001", "020 7946 1001"] and listed[9][0] == "020 7946 0958" and listed[10] == ["020 7946 0959"]
    more = {(r.doc_id, texts[r.doc_id][f.start : f.end]) for r in cx.find(df).collect() for f in r.findings if not f.base}
    assert {(8, "020 7946 0001"), (9, "020 7946 0958"), (10, "020 7946 0959")} <= more


def scores_by_hand(edges, turns):
    """(pattern, kind) -> confidence; ``edges``: (pattern, value, kind or None), one for each pattern and value."""
    kinds = {v: k for _, v, k in edges if k}
    patterns = {}
    for p, v, _ in edges:
        patterns.setdefault(p, set()).add(v)
    known = {(p, k) for p, vs in patterns.items() for k in cx.KINDS if sum(kinds.get(v) == k for v in vs) >= cx.SUPPORT}
    trust = {(v, k): 1.0 for v, k in kinds.items()}
    for turn in range(turns):
        scores = {(p, k): sum(trust.get((v, k), 0.0) for v in patterns[p]) / (len(patterns[p]) + cx.SMOOTHING) for p, k in known}
        if turn + 1 < turns:
            trust = {(v, k): 1.0 for v, k in kinds.items()}
            for v in {v for vs in patterns.values() for v in vs} - set(kinds):
                for k in cx.KINDS:
                    doubts = [1 - min(c, 0.99) for (p, q), c in scores.items() if q == k and v in patterns[p]]
                    if doubts and re.search(cx.FORMS[k], v):
                        trust[v, k] = 1 - math.prod(doubts)
    return scores


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_scores_as_by_hand(spark, seed):
    rng = random.Random(seed)
    seeds = [(f"+1 200 555 {i:04d}", "phone") for i in range(12)] + [(f"u{i}@mail.example.com", "email") for i in range(12)]
    others = [(f"555 000 {i:04d}", None) for i in range(12)] + [(f"root{i}@local", None) for i in range(6)]
    edges = sorted({(f"p{rng.randrange(6)} _", *rng.choice(seeds + others)) for _ in range(90)}, key=str)
    df = spark.createDataFrame([("k", k, v, p, 0, 1) for p, v, k in edges], "_key string, kind string, value string, pattern string, start long, end long")
    expected = {x: c for x, c in scores_by_hand(edges, cx.TURNS).items() if c >= cx.CONFIDENCE}
    got = {(r.pattern, r.kind): r.confidence for r in cx.confident_patterns(df).collect()}
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-9 for x in got)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 1000])
def test_running_totals(spark, n):
    values = [(i * 37) % 101 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    row = df.select(cx.running(F.col("v"), lambda a, b: a + b).alias("s"), cx.running(F.col("v"), F.greatest).alias("m")).first()
    assert row.s == list(itertools.accumulate(values)) and row.m == list(itertools.accumulate(values, max))


def test_time_does_not_grow_with_the_square_of_matches(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "a@b.cd 1.2.3.4 " * n)], "doc_id long, text string")
        start = time.time()
        assert cx.redact(df).first().text == "<EMAIL> <IP> " * n
        return time.time() - start

    seconds(10)
    assert seconds(20_000) < 3 * seconds(10_000) + 2


def test_many_findings_as_few(spark, monkeypatch):
    rng = random.Random(3)
    pieces = ["a@b.cd", "10.0.0.1", "020 7946 0001", "+1 200 555 1000", "4111 1111 1111 1111", "word", "7 8 9 10 11 12", "x@y", "1.2.3.4 555 000 1111"]
    df = spark.createDataFrame([(i, " ".join(rng.choice(pieces) for _ in range(40))) for i in range(40)], "doc_id long, text string")
    few = sorted(map(str, cx.scan(df).collect()))
    monkeypatch.setattr(cx, "COMPARED", 0)
    assert sorted(map(str, cx.scan(df).collect())) == few


def test_own_columns_keep_their_values(spark):
    names = ["_key", "_spans", "_sizes", "_reached", "_chars", "__key", "__found", "KEY"]
    df = spark.createDataFrame([(1, "a@b.cd", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = cx.redact(df)
    assert out.columns == df.columns and out.first()[2:] == tuple(names) and out.first().text == "<EMAIL>"
