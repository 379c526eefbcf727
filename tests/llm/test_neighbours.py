import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.llm import neighbours as nb
from reelmill.llm.batches import buffer
from reelmill.llm.queries import op1_neighbours
from reelmill.llm.words import Powers, windows, word_hashes


def terms_of(texts):
    return nb.term_matrix(*buffer(pa.array(texts)), Powers())


def test_words_and_windows():
    texts = ["The cat's  THE", "", "the", "a-b é", "the cat s the"]
    hashes, before = word_hashes(*buffer(pa.array(texts)), Powers())
    assert np.diff(before).tolist() == [4, 0, 1, 3, 4]
    assert hashes[0] == hashes[3] == hashes[4] and hashes[0] != hashes[1]
    assert hashes[:4].tolist() == hashes[-4:].tolist()
    runs, owner = windows(hashes, before, 3)
    assert owner.tolist() == [0, 0, 3, 4, 4] and runs[0] == runs[3]


def test_terms_do_not_depend_on_neighbours():
    texts = ["Some text, here.", "", "More & more text text text text", "é" * 20, "x", "a b c a b c a b c"]
    together = terms_of(texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], terms_of([t])[0])
    assert not together[1].any()


def test_scores_as_brute_force():
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    good = [" ".join(rng.choice(words, 30)) for _ in range(40)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 30)) for _ in range(40)]
    labels = np.asarray([1] * 40 + [0] * 40)
    model = nb.Model(terms_of(good + bad), labels)
    tested = terms_of([" ".join(rng.choice(words, 20)), "ALPHA!! BETA!! GAMMA!!"])
    vectors = nb.unit(nb.weigh(tested, model.idf) @ model.basis)
    for v, got in zip(vectors, model.score(tested)):
        cosine = [float(v @ r) for r in model.references]
        least = sorted(cosine)[-nb.NEIGHBOURS]
        votes = [(max(c, 0) ** nb.SHARPNESS, y) for c, y in zip(cosine, labels) if c >= least - 1e-6]
        assert got == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-5)
    assert model.score(tested)[0] > 0.9 and model.score(tested)[1] < 0.1


def test_basis_as_numpy():
    rows = np.random.default_rng(2).standard_normal((60, 30)).astype(np.float32) * np.linspace(5, 0.1, 30, dtype=np.float32)
    basis = nb.latent_basis(rows, 5, passes=30)
    _, _, v = np.linalg.svd(rows)
    assert np.allclose(np.abs(np.sum(basis.T * v[:5], axis=1)), 1, atol=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op1_neighbours(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.95
    assert sum(r.predicted == 1 for r in good) / len(good) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good words in a row " * 5, b"x") for i in range(30)] + [(100 + i, "BAD!! WORDS!! " * 9, b"x") for i in range(30)] + [(None, None, None), (200, "", None), (200, "", None), (201, " \n", None)], "doc_id long, text string, label binary")
    labels = spark.range(0, 30).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).union(spark.range(100, 130).select("id", F.lit(0))).union(spark.createDataFrame([(None, 1), (1, None), (5, 7)], "id long, quality int"))
    model = nb.fit(docs, nb.learnable(labels), 10)
    rows = nb.score(docs, model).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score > 0.9 for r in rows if r.text and r.text[0] == "g") and all(r.score < 0.1 for r in rows if r.text and r.text[0] == "B")
    assert {r.score for r in rows if not r.text or not r.text.strip()} == {0.0}
    assert nb.score(docs.limit(0), model).count() == 0
    only = nb.fit(docs, nb.learnable(labels.where("quality = 1")))
    assert {r.score for r in nb.score(docs, only).collect() if r.text} <= {0.0, 1.0}
    assert nb.fit(docs, nb.learnable(labels.limit(0))).fixed == 1.0


def test_nothing_is_defined_twice():
    import ast
    import inspect

    from reelmill.llm import neighbours

    names = [x.name for x in ast.parse(inspect.getsource(neighbours)).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
    assert len(names) == len(set(names))
