import random
import zlib

import pytest
from pyspark.sql import functions as F

from reelmill.llm import toxicity as X
from reelmill.llm.queries import op13_toxicity

SF = "/root/testdata/sf0.1"


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(left[-1] + 1, line[j] + 1, line[j - 1] + (x != y)))
        line = left
    return line[-1]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_against_all_distances(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = sorted({(word(rng.randint(4, 9)), rng.random() < 0.3, 1.0) for _ in range(6)})
    automaton = X.Automaton(entries)
    for _ in range(1500):
        w = word(rng.randint(0, 12))
        least = []
        for n, (entry, stem, _) in enumerate(entries):
            beginnings = [w[:i] for i in range(len(w) + 1)] if stem else [w]
            d = min(edits(entry, b) for b in beginnings)
            if d <= X.errors_for(len(entry)):
                least.append((d, n))
        got = automaton.match(w)
        assert (got is not None) == bool(least), (w, entries)
        if least:
            assert got[1] == min(least)[0] and (got[1], got[0]) in least


def test_automaton_starts_anew(monkeypatch):
    monkeypatch.setattr(X, "STATES", 5)
    automaton = X.Automaton([("worthless", False, 1.0)])
    assert [automaton.match(w) for w in ("worthless", "wortless", "w0rthles", "worth", "worthlessly")] == [(0, 0), (0, 1), (0, 2), None, (0, 2)]


@pytest.mark.parametrize("text, expected", [
    ('he said "you idiot" to her', True), ("“idiot” is a word", True), ("such an idiot, really", False), ('"fine", you idiot, "go"', False),
    ("the word 'idiot' appears", True), ("idiot", False), ('he is an "old idiot" they think', True),
])
def test_quotation(text, expected):
    memory = X.Memory(X.Automaton([("idiot", False, 1.0)]))
    found = X.matches(text, memory)
    assert [q for *_, q in found] == [expected]


def corpus(n=600):
    """Toxic texts hold an insult or a word of the stem, some in quotation marks are clean."""
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(5, len(words)), rng.choice(["blockhead", "zzgork" + rng.choice(["en", "ish", "ou", "a"])]))
        elif i % 4 == 1:
            words.insert(rng.randrange(5, len(words)), '"blockhead"')
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"))


def scores(spark, model, listed):
    df = spark.createDataFrame(list(enumerate(listed)), "doc_id long, text string")
    return [r.score for r in X.score(df, model).orderBy("doc_id").collect()]


def test_learned_words_stems_and_contexts(spark, model):
    letters = {e: stem for e, stem, _ in model.entries}
    assert "blockhead" in letters and letters.get("zzgork") is True
    got = scores(spark, model, [
        "you are a blockhead and a blockhead", "look at the zzgorkhaft zzgorky one", 'they wrote "blockhead" in it', "nothing to see here",
        "you blokhead you blockhaed", "", "x" * 50_000, None,
    ])
    assert min(got[:2]) >= X.THRESHOLD and got[4] >= X.THRESHOLD
    assert max(got[2], got[3], *got[5:]) < X.THRESHOLD and got[3] == got[5] == got[7] == 0.0


def test_held_out_documents(spark):
    rows = {r.doc_id: r for r in op13_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    toxic = [rows[d].predicted for d, t in labels.items() if t == 1 and rows[d].held_out]
    clean = [rows[d].predicted for d, t in labels.items() if t == 0 and rows[d].held_out]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.005 * len(clean)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = corpus(200)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t, 0) for d, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [X.fit(docs, X.learnable(spark.createDataFrame(x, "doc_id long, toxic int, quality int"))) for x in (flipped, [(d, t, 1) for d, t in labels])]
    assert models[0].entries == models[1].entries and (models[0].shares == models[1].shares).all()


def test_odd_rows(spark, model):
    df = spark.createDataFrame([(None, None, "l", 1), (1, "", None, 2), (1, "blockhead blockhead", "x", 3), (1, "blockhead blockhead", "x", 3)], "doc_id long, text string, label string, _n int")
    got = X.score(df, model)
    assert got.columns == [*df.columns, "score"]
    values = [r.score for r in got.orderBy("_n").collect()]
    assert values[:2] == [0.0, 0.0] and values[2] == values[3] >= 0.7
    with pytest.raises(ValueError, match="exists"):
        X.score(df.withColumn("score", F.lit(1)), model)
    assert X.score(df.limit(0), model).count() == 0
    empty = X.fit(df.limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert [r.score for r in X.score(df, empty).collect()] == [0.0] * 4
    one_kind = X.fit(df, spark.createDataFrame([(1, 1), (None, None), (None, 1)], "doc_id long, label int"))
    assert [r.score for r in X.score(df, one_kind).collect()] == [0.0] * 4
