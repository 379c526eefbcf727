import pytest
from pyspark.sql import functions as F

from reelmill.operators import metrics as ME
from reelmill.operators import sampling as SA

PUBLISHED = [
    ([[26811, 3407], [2767, 46062]], [.9219, .9217, .9219, .9217, .9188, .9153, .9170]),
    ([[7673, 1214], [899, 13692]], [.9100, .9097, .9100, .9097, .9068, .9009, .9037]),
    ([[8029, 1144], [846, 13940]], [.9169, .9167, .9169, .9167, .9144, .9090, .9116]),
    ([[27146, 3459], [2734, 46630]], [.9226, .9224, .9226, .9224, .9197, .9158, .9177]),
]


@pytest.mark.parametrize("matrix, expected", PUBLISHED)
def test_published_metrics(spark, matrix, expected):
    cells = [(i, j, matrix[i][j]) for i in (0, 1) for j in (0, 1)]
    r = ME.class_report(spark.createDataFrame(cells, "label int, prediction int, n long")).first()
    names = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "precision_macro", "recall_macro", "f1_macro"]
    assert [round(r[n], 4) for n in names] == expected


def test_class_never_predicted_counts_zero(spark):
    cells = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "label int, prediction int, n long")
    assert ME.class_report(cells).first()["precision_macro"] == pytest.approx(0.25)


def test_published_undersampling(spark):
    rows = spark.range(359_698).select(F.col("id").alias("review_id"), F.lit(8.0).alias("rating")).unionAll(
        spark.range(1_000_000, 1_139_378).select("id", F.lit(2.0))).unionAll(spark.range(2_000_000, 2_000_100).select("id", F.lit(5.0)))
    kept = {r["rating"]: r["count"] for r in SA.balance(rows).groupBy("rating").count().collect()}
    assert kept == {8.0: 209_067, 2.0: 139_378}
    assert SA.balance(rows, cap=1000).count() == 1000


def test_no_negatives_drops_all_positives(spark):
    rows = spark.range(10).select(F.col("id").alias("review_id"), F.lit(9.0).alias("rating"))
    assert SA.balance(rows).count() == 0


def test_published_split_and_oversampling(spark):
    rows = spark.range(117_386).select(F.col("id").alias("k"), F.when(F.col("id") < 72_951, 1).otherwise(0).alias("label"))
    split = SA.stratified_split(rows, "k")
    n = {(r["is_test"], r["label"]): r["count"] for r in split.groupBy("is_test", "label").count().collect()}
    assert n == {(False, 1): 58_360, (False, 0): 35_548, (True, 1): 14_591, (True, 0): 8_887}
    more = SA.oversample(split.filter("not is_test"), "k")
    assert {r["label"]: r["count"] for r in more.groupBy("label").count().collect()} == {1: 58_360, 0: 38_906}
    assert more.select("k", "copy").distinct().count() == 58_360 + 38_906


def test_oversample_many_rounds_and_none_needed(spark):
    rows = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(33)], "k long, label int")
    copies = [r["count"] for r in SA.oversample(rows, "k").filter("label = 0").groupBy("k").count().collect()]
    assert sorted(copies) == [6, 7, 7]
    even = spark.createDataFrame([(i, i % 2) for i in range(10)], "k long, label int")
    assert SA.oversample(even, "k").count() == 10


def test_draws_are_exact_and_repeatable(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"] for r in SA.sample_keys(rows, "k", 777).collect()}
    b = {r["k"] for r in SA.sample_keys(rows.repartition(13), "k", 777).collect()}
    assert len(a) == 777 and a == b
    assert SA.sample_keys(rows, "k", 0).count() == 0 and SA.sample_keys(rows, "k", 9999).count() == 5000
    folds = SA.stratified_folds(rows.withColumn("label", (F.col("k") % 3 == 0).cast("int")), "k").groupBy("label", "fold").count().collect()
    for c in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == c]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_dense_ids_have_no_gaps(spark):
    rows = spark.createDataFrame([(f"u{i % 400}",) for i in range(1000)] + [(None,)], "u string")
    assert sorted(r["dense_id"] for r in SA.dense_ids(rows, "u").collect()) == list(range(400))


def test_auc(spark):
    def area(rows):
        return ME.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()[0]

    assert area([(0, .1), (0, .2), (1, .3), (1, .9)]) == 1.0
    assert area([(0, .5), (1, .5)]) == 0.5
    assert area([(1, .5), (1, .7)]) is None
    rows = [((i * 7919) % 3 == 0, ((i * 104729) % 97) / 97) for i in range(400)]
    brute = [1.0 if p > q else 0.5 if p == q else 0.0 for a, p in rows if a for b, q in rows if not b]
    assert area([(int(a), s) for a, s in rows]) == pytest.approx(sum(brute) / len(brute))


def test_list_metrics_edges(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "user string, item string, rank int")
    relevant = spark.createDataFrame([("a", "y"), ("c", "x")], "user string, item string")
    got = {r["user"]: (r["precision_5"], r["ndcg_5"]) for r in ME.list_metrics(ranked, relevant, (5,)).collect()}
    assert got["a"] == (pytest.approx(0.2), pytest.approx(1 / 1.584962500721156)) and got["c"] == (0.0, 0.0) and "b" not in got
    assert ME.precision_at_k(ranked, relevant, 0).first()["precision_0"] == 0.0
    assert ME.mean_metrics(ME.list_metrics(ranked, relevant.limit(0), (5,)), ["precision_5"]).first()[0] == 0.0
