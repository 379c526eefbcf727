import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from reelmill.operators import factors as FA
from reelmill.operators import keywords as KW
from reelmill.operators import models as MO
from reelmill.operators import recommend as RC
from reelmill.operators import similarity as SI
from reelmill.operators import svm as SV
from reelmill.operators.ranking import minmax
from reelmill.params import FIRST
from reelmill.session import small_side


def sparse(spark, matrix, key):
    rows = [(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v]
    return SI.pack_vectors(spark.createDataFrame(rows, f"{key} long, term_id int, weight double"), key)


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(1)
    left = rng.random((23, 40)) * (rng.random((23, 40)) < 0.3)
    right = rng.random((31, 40)) * (rng.random((31, 40)) < 0.2)
    left[:, 0] = 1.0  # one term that everything has
    right[:20, 0] = 1.0
    return left, right


def cosines(a, b):
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    return np.round((a @ b.T) / np.outer(np.where(na > 0, na, 1), np.where(nb > 0, nb, 1)), 9)


@pytest.mark.parametrize("blocks", [(1 << 20, 1 << 20), (40, 30)])
def test_top_cosine_against_brute_force(spark, matrices, blocks):
    left, right = matrices
    got = SI.top_cosine(sparse(spark, left, "a"), sparse(spark, right, "b"), 5, "a", "b", *blocks).collect()
    c = cosines(left, right)
    expected = {(a, int(b), r + 1) for a in range(len(left)) for r, b in enumerate([b for b in np.lexsort((np.arange(len(right)), -c[a])) if c[a, b] > 0][:5])}
    assert {(r["a"], r["b"], r["rank"]) for r in got} == expected
    assert all(abs(r["cos"] - c[r["a"], r["b"]]) < 1e-8 for r in got)
    everything = SI.cosine_pairs(sparse(spark, left, "a"), sparse(spark, right, "b"), "a", "b")
    assert everything.count() == int((c > 0).sum())


@pytest.mark.parametrize("blocks", [(1 << 20, 1 << 20), (40, 30)])
def test_complete_lists_have_k_rows(spark, blocks):
    rng = np.random.default_rng(2)
    left, right = rng.standard_normal((9, 12)), rng.standard_normal((20, 12))
    left[0], right[3], left[1, 4:], right[5:12, :4] = 0, 0, 0, 0

    def packed(m, key):
        return SI.dense_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{key} long, v array<double>"), key, "v")

    got = SI.top_cosine(packed(left, "a"), packed(right, "b"), 15, "a", "b", *blocks, complete=True).collect()
    c = cosines(left, right) + 0.0
    expected = {(a, int(b), r + 1) for a in range(9) for r, b in enumerate(np.lexsort((np.arange(20), -c[a]))[:15])}
    assert {(r["a"], r["b"], r["rank"]) for r in got} == expected and len(got) == 9 * 15


def test_bounds_pass_over_blocks_and_lose_nothing():
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 20, 4000)
    right = np.zeros((4000, 400))
    for i, t in enumerate(topic):  # heavy words of a topic, light words of all
        right[i, t * 20 + rng.choice(20, 8, replace=False)] = rng.random(8) + 0.5
        right[i, rng.choice(400, 4, replace=False)] += 0.05
    left = right[rng.choice(4000, 60, replace=False)]

    def frame(m, key):
        idx = [np.flatnonzero(r) for r in m]
        return pd.DataFrame({key: np.arange(len(m)), "idx": idx, "val": [r[i] for r, i in zip(m, idx)], "norm": np.linalg.norm(m, axis=1)})

    matches = SI.Matches(frame(left, "a").assign(k=10), "a", "b", False)
    found = [part for first in range(0, 4000, 2000) for part in matches.among(frame(right, "b").iloc[first : first + 2000])]
    found = pd.concat(found).sort_values(["a", "cos", "b"], ascending=[True, False, True]).groupby("a").head(10)
    c = cosines(left, right)
    expected = [(a, int(b)) for a in range(60) for b in np.lexsort((np.arange(4000), -c[a]))[:10]]
    assert list(zip(found["a"], found["b"])) == expected
    assert matches.passed / (matches.met + matches.passed) > 0.5


@pytest.mark.parametrize("arrow", ["true", "false"])
def test_no_result_hangs_on_the_arrow_setting(spark, matrices, arrow):
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow)
    try:
        left, right = matrices
        c = cosines(left, right)
        assert SI.cosine_pairs(sparse(spark, left, "a"), sparse(spark, right, "b"), "a", "b").count() == int((c > 0).sum())
        members = spark.createDataFrame([(1, 0), (1, 1), (2, 3)], "g long, b long")
        assert SI.mean_vectors(members, sparse(spark, right, "b"), "g", "b").count() == 2
        assert __spark_entry__.entry(spark).count() > 0
    finally:
        spark.conf.set(name, before)


def test_kinds_are_packed_by_executors(spark):
    size = KW.KIND_BLOCK + 100
    kinds = spark.range(0, size, 3).selectExpr("cast(id as int) AS term_id", "cast(id % 2 as tinyint) AS kind")
    table = KW.packed_kinds(kinds, size)
    ids = np.arange(size)
    assert (KW.kinds_of(table, ids) == np.where(ids % 3 == 0, ids % 2, 2)).all()
    assert 4 * len(table) < size + KW.KIND_BLOCK


@pytest.mark.parametrize("rows, part", [(1 << 16, 256), (3, 256), (1 << 16, 2), (3, 2)])
def test_taste_and_mean_by_every_path(spark, matrices, monkeypatch, rows, part):
    monkeypatch.setattr(SI, "SLICE_ROWS", rows)
    monkeypatch.setattr(SI, "PART", part)
    monkeypatch.setattr(SI, "LEVEL", 2)
    _, right = matrices
    vectors = sparse(spark, right, "item")
    seeds = [(u, i, None if i % 2 else (i % 10) + 1) for u in range(4) for i in range(u, 31, 3)] + [(9, 999, 5), (8, 3, 0), (8, 4, 0)]
    df = spark.createDataFrame(seeds, "user long, item long, rating int")
    got = {r["user"]: r for r in SI.taste_vectors(df, vectors, "user").collect()}
    assert set(got) == {0, 1, 2, 3, 8}
    for u, r in got.items():
        mine = [(i, 1.0 if s is None else s / 10) for v, i, s in seeds if v == u and i < 31]
        w = np.array([x for _, x in mine]) if sum(x for _, x in mine) else np.ones(len(mine))
        expected = (w @ right[[i for i, _ in mine]]) / w.sum()
        dense = np.zeros(right.shape[1])
        dense[r["idx"]] = r["val"]
        assert np.allclose(dense, expected)
    twice = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "user long, item long")
    r = SI.mean_vectors(twice, vectors, "user").first()
    dense = np.zeros(right.shape[1])
    dense[r["idx"]] = r["val"]
    assert np.allclose(dense, (2 * right[2] + right[3]) / 3)


def test_diversity(spark, matrices):
    _, right = matrices
    vectors = sparse(spark, right, "item")
    lists = spark.createDataFrame([(1, i) for i in (0, 3, 5, 7)] + [(2, 4), (3, 999)], "g long, item long")
    got = {r["g"]: r["ild"] for r in SI.intra_list_diversity(lists, vectors, "g").collect()}
    c = cosines(right[[0, 3, 5, 7]], right[[0, 3, 5, 7]])
    assert got[1] == pytest.approx(1 - c[np.triu_indices(4, 1)].mean(), abs=1e-8)
    assert got[2] == got[3] == 0.0


@pytest.mark.parametrize("limit", [1 << 27, -1])
def test_mmr_against_brute_force(spark, matrices, monkeypatch, limit):
    monkeypatch.setattr(RC, "small_side", lambda df: df if limit < 0 else small_side(df, limit))
    _, right = matrices
    rng = np.random.default_rng(2)
    scores = {(g, i): round(float(x), 6) for g in range(3) for i, x in enumerate(rng.random(31))}
    rows = [(g, i, s) for (g, i), s in scores.items()] + [(7, 1, .5), (7, 2, .9)]
    cands = spark.createDataFrame(rows, "query_id long, item long, final double")
    got = RC.mmr_rerank(cands, sparse(spark, right, "item"), 6, 0.6).collect()
    c = cosines(right, right)
    for g in range(3):
        order, taken = sorted(range(31), key=lambda i: (-scores[g, i], i)), []
        for _ in range(6):
            value = {i: round(0.6 * scores[g, i] - 0.4 * max((c[i, t] for t in taken), default=0.0), 9) for i in order if i not in taken}
            taken.append(max(value, key=lambda i: (value[i], -order.index(i))))
        assert [r["item"] for r in sorted((r for r in got if r["query_id"] == g), key=lambda r: r["rank"])] == taken
    assert [r["item"] for r in sorted((r for r in got if r["query_id"] == 7), key=lambda r: r["rank"])] == [2, 1]


def test_minmax_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "g int, s double")
    assert sorted(r["x"] for r in minmax(rows, "s", ["g"], "x").collect()) == [0.0, 1.0, 1.0, 1.0]


@pytest.mark.parametrize("block, cells_per_part, sent", [(256, 1 << 15, 1 << 26), (7, 20, 1 << 26), (256, 1 << 15, 0), (7, 20, 0)])
def test_svd_against_numpy(spark, monkeypatch, block, cells_per_part, sent):
    monkeypatch.setattr(FA, "BLOCK", block)
    monkeypatch.setattr(FA, "SENT", sent)
    monkeypatch.setattr(FA, "CELLS", cells_per_part)
    rng = np.random.default_rng(3)
    a = np.round(rng.random((30, 18)) * 10) * (rng.random((30, 18)) < 0.5)
    a[:, 0], a[0, :] = 5, 3
    cells = spark.createDataFrame([(f"u{i}", j, float(a[i, j])) for i in range(30) for j in range(18) if a[i, j]], "user string, item long, r double")
    users, items = FA.truncated_svd(cells, k=4, n_iter=8, oversampling=12)
    u = np.zeros((30, 4))
    for r in users.collect():
        u[int(r["user"][1:])] = r["factors"]
    v = np.zeros((18, 4))
    for r in items.collect():
        v[r["item"]] = r["factors"]
    left, s, right = np.linalg.svd(a)
    assert np.allclose(np.linalg.norm(u, axis=0), s[:4], rtol=1e-4)
    assert np.allclose(u @ v.T, (left[:, :4] * s[:4]) @ right[:4], atol=1e-2)
    expected = u.var(axis=0).sum() / a.var(axis=0).sum()
    assert FA.explained_variance(users, cells).first()[0] == pytest.approx(expected)


def test_routes_send_each_needed_row_once(spark, monkeypatch):
    monkeypatch.setattr(FA, "BLOCK", 8)
    cells = spark.range(0, 3000).selectExpr("id % 40 AS u", "(id * 7) % 60 AS i", "1.0D AS r").distinct()
    monkeypatch.setattr(FA, "CELLS", 500)
    stripes = FA._Stripes(cells, "u", "i", cells.count())
    sent = [(r["g"], f) for r in stripes.routes.collect() for f in r["far"]]
    assert len(sent) == len(set(sent))
    assert set(sent) == {(r["g"], f) for r in stripes.packed.collect() for f in r["far"]}


def labelled_rows(n=400, width=30, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.random((n, width)) * (rng.random((n, width)) < 0.3)
    y = (x @ rng.standard_normal(width) + 0.3 * rng.standard_normal(n) > 0.2).astype(int)
    return x, y


def feature_table(spark, x, y):
    idx = [np.flatnonzero(r).tolist() for r in x]
    rows = [(i, int(t), j, [float(r[k]) for k in j]) for i, (r, t, j) in enumerate(zip(x, y, idx))]
    df = spark.createDataFrame(rows, "review_id long, label int, idx array<int>, val array<double>")
    return MO.feature_rows(df.select("review_id", "label"), df.select("review_id", "idx", "val"), x.shape[1])


def test_svm_is_the_optimum(spark):
    """Against plain gradient steps until nothing moves; primal and dual value enclose that optimum."""
    x, y = labelled_rows()
    svm = MO.fit_svm(feature_table(spark, x, y))
    a, t = np.hstack([x, np.ones((len(x), 1))]), 2 * y - 1
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    value = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - t * (a @ w)) ** 2).sum()
    w, rate = np.zeros(31), 1 / (1 + 2 * cost.max() * np.linalg.norm(a, 2) ** 2)
    for _ in range(20_000):
        w = w - rate * (w - a.T @ (2 * cost * t * np.maximum(0, 1 - t * (a @ w))))
    best = value(w)
    assert svm.dual <= best + 1e-9 <= svm.primal + 2e-9 and svm.primal - svm.dual <= 1e-4 * svm.primal
    assert value(np.append(svm.coefficients, svm.intercept)) == pytest.approx(svm.primal)
    assert np.abs(np.append(svm.coefficients, svm.intercept) - w).max() < 0.05


def test_models_fitted_together_are_those_fitted_alone(spark):
    x, y = labelled_rows(300)
    table = feature_table(spark, x, y)
    masks = [F.col("review_id") % 3 != i for i in range(3)]
    _, together = MO._fit_masked(table, masks, FIRST)
    for mask, svm in zip(masks, together):
        alone = MO.fit_svm(table.where(mask))
        assert svm.primal == pytest.approx(alone.primal, rel=3e-4) and np.abs(svm.coefficients - alone.coefficients).max() < 0.05


def test_certificate_of_given_models(spark):
    x, y = labelled_rows(200, 12)
    rows = feature_table(spark, x, y).withColumn("costs", F.array(F.lit(1.0), F.lit(0.5)))
    rng = np.random.default_rng(1)
    svms = [SV.LinearSvm(rng.standard_normal(12), 0.1), SV.LinearSvm(np.zeros(12), 0.0)]
    a, t = np.hstack([x, np.ones((200, 1))]), 2 * y - 1
    for r, svm, c in zip(SV.certificate(rows, svms).orderBy("model").collect(), svms, (1.0, 0.5)):
        w = np.append(svm.coefficients, svm.intercept)
        short = np.maximum(0, 1 - t * (a @ w))
        pulled = a.T @ (2 * c * short * t)
        assert r["primal"] == pytest.approx(0.5 * w @ w + c * (short**2).sum()) and r["gradient_norm"] == pytest.approx(np.linalg.norm(w - pulled))
        assert r["dual"] == pytest.approx((2 * c * short).sum() - c * (short**2).sum() - 0.5 * pulled @ pulled)


def test_sigmoids_of_several_models(spark):
    rng = np.random.default_rng(4)
    rows = [(m, int(rng.random() < 1 / (1 + np.exp(-(a * z + b)))), float(z)) for m, (a, b) in enumerate([(2.0, 0.5), (1.0, -1.0)]) for z in rng.standard_normal(3000) * 2]
    got = SV.fit_sigmoids(spark.createDataFrame(rows, "model int, label int, margin double"), 3)
    assert got[0] == pytest.approx((2.0, 0.5), abs=0.25) and got[1] == pytest.approx((1.0, -1.0), abs=0.2) and got[2] == (0.0, 0.0)


def test_calibrated_svm_on_separable_rows(spark, tmp_path):
    rows = [(i, i % 2, [0, 1 + i % 2, 5], [1.0, 1.0 + i / 100, 0.1]) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, label int, idx array<int>, val array<double>")
    table = MO.feature_rows(df.select("review_id", "label"), df.select("review_id", "idx", "val"), 6)
    model = MO.fit_calibrated_svm(table)
    scored = model.transform(table).select("review_id", "label", "prediction", "probability").collect()
    assert all(r["label"] == r["prediction"] and 0 < r["probability"] < 1 for r in scored)
    model.save(str(tmp_path / "m"))
    again = MO.CalibratedSvm.load(spark, str(tmp_path / "m")).transform(table).select("review_id", "probability").collect()
    assert {r["review_id"]: round(r["probability"], 9) for r in again} == {r["review_id"]: round(r["probability"], 9) for r in scored}


def test_documents_without_terms_have_zero_features(spark):
    docs = spark.createDataFrame([(1, 1)], "review_id long, label int")
    none = spark.createDataFrame([], "review_id long, idx array<int>, val array<double>")
    assert MO.feature_rows(docs, none, 9).first()["features"].numNonzeros() == 0


def test_keywords_by_both_ways(spark, monkeypatch):
    from reelmill.operators import keywords as KW

    terms = ["film", "good boy", "cat", "dog ran", "eel", "fox sat", "gnu", "hen"]
    vocab = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    vectors = SI.pack_vectors(spark.createDataFrame([(i, t, float((i * 7 + t * 3) % 5)) for i in range(4) for t in range(8)], "item long, term_id int, weight double"), "item")
    members = spark.createDataFrame([(g, i) for g in range(3) for i in range(g, 4)], "g long, item long")

    def found():
        return sorted((r["g"], r["rank"], r["term"], round(r["weight"], 9)) for r in KW.keywords(members, vectors, vocab, "g", 4).collect())

    here = found()
    monkeypatch.setattr(KW, "KINDS_SENT", 0)
    assert here and found() == here


def test_feature_vectors(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "review_id long, name string")
    vectors = spark.createDataFrame([(1, [0, 3], [1.0, 2.0]), (3, [4], [5.0])], "review_id long, idx array<int>, val array<double>")
    rows = {r["review_id"]: r for r in MO.feature_rows(docs, vectors, 5).collect()}
    assert rows[1]["features"].toArray().tolist() == [1, 0, 0, 2, 0] and rows[1]["name"] == "x"
    assert rows[2]["features"].toArray().tolist() == [0] * 5 and rows[3]["features"][4] == 5


def test_spread_follows_the_input(spark, monkeypatch):
    from reelmill import session

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = session.spread(docs, "doc_id").rdd.getNumPartitions()
    monkeypatch.setattr(session, "SPREAD_BYTES", 50_000)
    assert session.spread(docs, "doc_id").rdd.getNumPartitions() > few


def test_no_vector_reaches_the_driver(spark, matrices, monkeypatch):
    _, right = matrices
    vectors = sparse(spark, right, "item")
    members = spark.createDataFrame([(g, i) for g in range(9) for i in range(g, 31, 4)], "g long, item long")

    def refuse(self, *args):
        raise AssertionError("collected")

    frame, rows = type(vectors), []
    collect = frame.collect
    with monkeypatch.context() as patch:
        for name in ("toArrow", "toPandas"):
            patch.setattr(frame, name, refuse)
        patch.setattr(frame, "collect", lambda self: rows.append(found := collect(self)) or found)
        means = SI.mean_vectors(members, vectors, "g")
    assert all(len(found) <= 1 and len(r) == 1 for found in rows for r in found)  # single numbers
    assert means.count() == 9


def test_sums_of_one_part_are_neither_stored_nor_moved(spark, matrices, monkeypatch):
    stored = []
    for module in (SI, RC):
        if hasattr(module, "store"):
            monkeypatch.setattr(module, "store", lambda df, name="stage", rows=None, keep=module.store: stored.append((name, df.columns)) or keep(df, name, rows))
    _, right = matrices
    seeds = spark.createDataFrame([(u, i, 10) for u in range(6) for i in range(u, 31, 4)], "query_id long, item long, rating int")
    vectors = sparse(spark, right, "item")
    pool = RC.seed_pool(seeds, SI.taste_vectors(seeds, vectors, "query_id"), vectors, 5)
    plan = pool._jdf.queryExecution().executedPlan().toString()
    c = {(r["query_id"], r["item"]): r["cos"] for r in pool.collect()}
    for u in range(6):
        mine = list(range(u, 31, 4))
        near = cosines(right[mine].mean(axis=0)[None], right)[0]
        assert {i for q, i in c if q == u} == {i for i in range(31) if near[i] > 0 and i not in mine}
        assert all(abs(c[u, i] - near[i]) < 1e-8 for q, i in c if q == u)
    assert stored and not any("val" in columns for _, columns in stored)
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "val" in line]


def test_pools_get_each_vector_once(spark, matrices, monkeypatch):
    moved = []
    meet = SI.meet_vectors
    monkeypatch.setattr(RC, "meet_vectors", lambda *a, **k: moved.append(a[0].columns) or meet(*a, **k))
    _, right = matrices
    cands = spark.createDataFrame([(g, i, (i * 7 % 31) / 31) for g in range(3) for i in range(31)] + [(5, None, 0.5)], "query_id long, item long, final double")
    got = RC.mmr_rerank(cands, sparse(spark, right, "item"), 4).collect()
    assert len(got) == 13 and moved == [["query_id", "item", "final", "_place"]]


def test_vectors_without_gaps_are_multiplied_as_matrices():
    rng = np.random.default_rng(5)
    left, right = rng.standard_normal((300, 16)).round(1), rng.standard_normal((1500, 16)).round(1)
    right[700:] = right[:800]  # many ties

    def frame(m, key):
        return pd.DataFrame({key: np.arange(len(m)), "idx": [np.arange(16)] * len(m), "val": list(m), "norm": np.linalg.norm(m, axis=1)})

    for complete in (True, False):
        matches = SI.Matches(frame(left, "a").assign(k=10), "a", "b", complete)
        found = pd.concat([part for first in (0, 750) for part in matches.among(frame(right, "b").iloc[first : first + 750])])
        found = found.sort_values(["a", "cos", "b"], ascending=[True, False, True]).groupby("a").head(10)
        c = cosines(left, right)
        assert list(zip(found["a"], found["b"])) == [(a, int(b)) for a in range(300) for b in np.lexsort((np.arange(1500), -c[a]))[:10]]
        assert matches.met == 0  # no left vector met a sub-block by itself


@pytest.mark.parametrize("block", [SI.RIGHT_BLOCK, 0])
def test_explanations_by_every_path(spark, matrices, monkeypatch, block):
    monkeypatch.setattr(KW, "RIGHT_BLOCK", block)
    left, right = matrices
    vocab = spark.createDataFrame([(t, "bad" if t == 0 else f"t{t:02d}") for t in range(40)], "term_id int, term string")
    results = spark.createDataFrame([(q, i) for q in range(5) for i in range(q, 31, 6)] + [(0, 999), (77, 1)], "query_id long, item long")
    got = KW.explain(results, sparse(spark, left, "query_id"), sparse(spark, right, "item"), vocab).collect()
    skip = {0} if "bad" in KW.GENERIC_TERMS else set()
    for q, i in [(q, i) for q in range(5) for i in range(q, 31, 6)]:
        low = np.minimum(left[q], right[i])
        best = [t for t in sorted(range(40), key=lambda t: (-round(low[t], 9), t)) if low[t] > 0 and t not in skip][:4]
        assert [r["term"] for r in sorted((r for r in got if (r["query_id"], r["item"]) == (q, i)), key=lambda r: r["rank"])] == ["bad" if t == 0 else f"t{t:02d}" for t in best]
    assert {(r["query_id"], r["item"]) for r in got} <= {(q, i) for q in range(5) for i in range(31)}


def test_models_that_are_done_send_no_more_sums(spark, monkeypatch):
    x, y = labelled_rows(300)
    seen, evaluate = [], SV._evaluate
    monkeypatch.setattr(SV, "_evaluate", lambda rows, w, *rest: seen.append(len(w)) or evaluate(rows, w, *rest))
    # the second model's rows are one in ten, so that both need different numbers of passes
    MO._fit_masked(feature_table(spark, x, y), [F.lit(True), F.col("review_id") % 10 == 0], FIRST)
    assert seen[0] == 2 and seen[-1] == 1
    assert SV.SUMMED * FIRST.svc_max_iter < 1000 << 20  # what all passes together may send to the driver


def test_vectors_meet_only_rows_with_both_sides(spark):
    from pyspark.sql import functions as F

    from reelmill.operators import factors

    rows = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (2, 7, "c"), (None, 7, "d"), (3, None, "e"), (1, 7, "f"), (4, 9, "g"), (2, 8, "h")], "user long, item long, note string")
    users = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 0.0]), (4, [1.0, 1.0]), (5, [9.0, 9.0]), (None, [1.0, 1.0])], "user long, factors array<double>")
    items = spark.createDataFrame([(7, [1.0, 1.0]), (7, [0.0, 1.0]), (9, None), (None, [1.0, 1.0])], "item long, factors array<double>")
    joined = rows.join(users.withColumnRenamed("factors", "_u"), "user", "left").join(items.withColumnRenamed("factors", "_v"), "item", "left")
    want = joined.withColumn("factor_score", F.coalesce(factors.dot("_u", "_v"), F.lit(0.0))).drop("_u", "_v")
    got = factors.factor_scores(rows, users, items)
    assert got.columns == want.columns and sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    # a user's vector went on to the item join with every row, whether the item had one or not
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parts, held", [(3, 600), (1 << 8, 3000)])
def test_svd_by_groups_and_slices_of_columns(spark, monkeypatch, parts, held):
    """Several parts in a group, several slices of columns; the stages of one half step only are left."""
    import os

    from reelmill.session import scratch_folder

    for name, value in (("BLOCK", 7), ("CELLS", 20), ("SENT", 0), ("PARTS", parts), ("HELD", held)):
        monkeypatch.setattr(FA, name, value)
    seen, routed = [], FA._routed
    monkeypatch.setattr(FA, "_routed", lambda stripes, far, turn, cuts: seen.append((stripes, cuts, routed(stripes, far, turn, cuts))) or seen[-1][2])
    rng = np.random.default_rng(3)
    a = np.round(rng.random((30, 18)) * 10) * (rng.random((30, 18)) < 0.5)
    a[:, 0], a[0, :] = 5, 3
    cells = spark.createDataFrame([(f"u{i}", j, float(a[i, j])) for i in range(30) for j in range(18) if a[i, j]], "user string, item long, r double")
    folder = scratch_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    users, items = FA.truncated_svd(cells, k=4, n_iter=8, oversampling=12)
    left = sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before)
    assert left == ["blocks", "blocks", "item-ids", "user-ids"]  # every half step's parts and blocks were left
    u, v = np.zeros((30, 4)), np.zeros((18, 4))
    for side, key, out in ((users, "user", u), (items, "item", v)):
        for r in side.collect():
            out[int(str(r[key]).removeprefix("u"))] = r["factors"]
    x, s, y = np.linalg.svd(a)
    assert np.allclose(u @ v.T, (x[:, :4] * s[:4]) @ y[:4], atol=1e-2)
    assert len(seen) == 17 and all(len(cuts) > 2 for _, cuts, _ in seen)
    assert (seen[0][0].groups > 1) == (parts == 3)


def test_slices_move_each_needed_row_once(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("CELLS", 20), ("PARTS", 2), ("SENT", 0)):
        monkeypatch.setattr(FA, name, value)
    cells = spark.range(0, 3000).selectExpr("id % 40 AS u", "(id * 7) % 60 AS i", "1.0D AS r").distinct()
    stripes = FA._Stripes(cells, "u", "i", cells.count())
    rows = {b: np.random.default_rng(b).random((8, 6)) for b in range(8)}
    far = FA._Side(spark.createDataFrame([(b, bytearray(m.tobytes())) for b, m in rows.items()], "b long, m binary"), 60, 6)
    sent = FA._routed(stripes, far, None, np.array([0, 2, 4, 6])).filter(f"b < {FA.LAST}").collect()
    needed = {(r["g"], f) for r in stripes.packed.collect() for f in r["far"]}
    assert stripes.groups > 1 and sum(len(r["m"]) for r in sent) == len(needed) * 6 * 8
    found = {(r["t"] // 3, r["b"] * 8 + i) for r in sent if r["t"] % 3 == 0 for i in np.frombuffer(r["ids"], "<u4")}
    assert found == needed


def test_scores_move_each_vector_once_a_task(spark, monkeypatch):
    """Rows of every kind: unknown and null keys, several vectors, missing elements, other lengths, further columns."""
    from pyspark.sql import functions as F

    for name, value in (("BLOCK", 4), ("HELD", 200), ("ROWS", 50), ("STEP", 16)):
        monkeypatch.setattr(FA, name, value)
    rng = np.random.default_rng(5)
    vector = lambda n: [float(x) for x in rng.integers(-9, 9, n)]
    users = [(f"u{i}", vector(5)) for i in range(40)] + [("u1", vector(5)), ("u2", None), ("u3", vector(4)), (None, vector(5)), ("u5", [1.0, None, 2.0, 3.0, 4.0]), ("u90", [])]
    items = [(i, vector(5)) for i in range(30)] + [(4, vector(5)), (5, None), (6, vector(3)), (50, vector(4)), (None, vector(5)), (91, [])]
    users = spark.createDataFrame(users, "user string, factors array<double>")
    items = spark.createDataFrame(items, "item long, factors array<double>")
    rows = spark.range(0, 700).selectExpr(
        "if(id % 50 = 0, null, id * 7 % 33) AS item", "if(id % 41 = 0, null, concat('u', id % 45)) AS user", "id % 3 AS a", "if(id % 4 = 0, null, date'2020-01-01') AS d", "array(id, null) AS l"
    ).unionByName(spark.sql("SELECT 50L AS item, 'u3' AS user, 1L AS a, date'2021-01-01' AS d, array(1L) AS l UNION ALL SELECT 91L, 'u90', 2L, NULL, NULL"))
    joined = rows.join(users.withColumnRenamed("factors", "_u"), "user", "left").join(items.withColumnRenamed("factors", "_v"), "item", "left")
    want = joined.withColumn("factor_score", F.coalesce(FA.dot("_u", "_v"), F.lit(0.0))).drop("_u", "_v")
    got = FA.factor_scores(rows, users, items)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "factors" not in plan  # only blocks of vectors are joined, and with their routes
    assert any(r["factor_score"] != 0.0 for r in got.collect())


def test_sums_of_few_items_need_few_slices(spark, monkeypatch):
    """Item vectors that fit one block go to few slices; the sums are those of the other path, whatever a list's length."""
    rng = np.random.default_rng(11)
    vectors = sparse(spark, rng.random((12, 40)) * (rng.random((12, 40)) < 0.4), "item")
    rows = [(g, i, float(rng.integers(-3, 9))) for g in range(9) for i in (*range(g + 3), None, 77)] + [(None, 1, 2.0)]
    members = spark.createDataFrame(rows, "g int, item int, w double")
    moved, meet = [], SI.meet_vectors
    monkeypatch.setattr(SI, "meet_vectors", lambda *a, **k: moved.append(1) or meet(*a, **k))
    monkeypatch.setattr(SI, "SLICE_ENTRIES", 8)  # as many slices as sums
    monkeypatch.setattr(SI, "SENT_ENTRIES", 30)
    found = {}
    for parts in (256, 2):
        for block in (1 << 21, 0):
            monkeypatch.setattr(SI, "PART", parts)
            monkeypatch.setattr(SI, "RIGHT_BLOCK", block)
            found[parts, block] = {r["g"]: r for r in SI.combine_vectors(members, vectors, "g").collect()}
            assert bool(moved) == (block == 0)
            moved.clear()
    for got in found.values():
        assert sorted(got) == list(range(9))
        for g, r in got.items():
            assert r["idx"] == found[256, 0][g]["idx"]
            assert np.allclose(r["val"], found[256, 0][g]["val"]) and np.isclose(r["norm"], found[256, 0][g]["norm"])


def test_gram_of_factors(spark):
    rows = np.random.default_rng(2).random((40, 5))
    gram = {(r["i"], r["j"]): r["g"] for r in FA.factor_gram(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "item int, factors array<double>")).collect()}
    assert len(gram) == 25 and np.allclose([gram[i, j] for i in range(5) for j in range(5)], (rows.T @ rows).ravel())
    assert FA.factor_gram(spark.createDataFrame([], "item int, factors array<double>")).count() == 0
    odd = spark.createDataFrame([(0, [1.0, None, 2.0]), (1, [3.0, None]), (2, None)], "item int, factors array<double>").coalesce(1)
    assert {(r["i"], r["j"]): r["g"] for r in FA.factor_gram(odd).collect()} == {
        (0, 0): 10.0, (0, 1): None, (0, 2): 2.0, (1, 0): None, (1, 1): None, (1, 2): None, (2, 0): 2.0, (2, 1): None, (2, 2): 4.0,
    }
