"""Sentiment classifier: linear SVM with balanced classes and Platt calibration."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.operators.metrics import class_report, confusion, mean_std
from reelmill.operators.sampling import stratified_folds
from reelmill.operators.svm import LinearSvm, fit_many, fit_sigmoids, with_margins
from reelmill.params import FIRST, Params
from reelmill.session import cut_lineage, store


def feature_rows(docs: DataFrame, vectors: DataFrame, size: int, key: str = "review_id") -> DataFrame:
    """Add ``features``; a document without known terms has the zero vector.

    Index and value lists become the vectors' own struct as they are, batch by batch.
    """
    joined = docs.join(vectors.select(key, F.col("idx").alias("_idx"), F.col("val").alias("_val")), key, "left")
    idx = F.coalesce("_idx", F.array().cast("array<int>"))
    val = F.coalesce("_val", F.array().cast("array<double>"))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("features", VectorUDT())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), batch.column("_idx"), batch.column("_val")]
            features = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), features], names=schema.names)

    return joined.select(*names, idx.alias("_idx"), val.alias("_val")).mapInArrow(assemble, schema)


ROWS_PER_TASK = 2_000


@dataclass
class CalibratedSvm:
    """Linear SVMs with one sigmoid (slope, offset) each; the probability is their mean."""

    svms: list[LinearSvm]
    sigmoids: list[tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` of the positive class and ``prediction``."""
        scored = with_margins(df, self.svms, "_margins")
        out = scored.withColumn("probability", mean_probability("_margins", self.sigmoids)).drop("_margins")
        return out.withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        for i, svm in enumerate(self.svms):
            terms = pa.table({"term_id": np.arange(len(svm.coefficients)), "weight": svm.coefficients})
            spark.createDataFrame(terms).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"svm_{i}"))
        known = [{"intercept": s.intercept, "primal": s.primal, "dual": s.dual, "gradient": s.gradient} for s in self.svms]
        rows = [(json.dumps(self.sigmoids), json.dumps(known))]
        spark.createDataFrame(rows, "sigmoids string, known string").coalesce(1).write.mode("overwrite").json(
            os.path.join(path, "sigmoids")
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> CalibratedSvm:
        saved = spark.read.schema("sigmoids string, known string").json(os.path.join(path, "sigmoids")).first()
        svms = []
        for i, known in enumerate(json.loads(saved["known"])):
            terms = spark.read.parquet(os.path.join(path, f"svm_{i}")).toArrow().sort_by("term_id")
            svms.append(LinearSvm(terms["weight"].to_numpy(), **known))
        return CalibratedSvm(svms, [tuple(s) for s in json.loads(saved["sigmoids"])])


def mean_probability(margins: str, sigmoids: list[tuple[float, float]], first: int = 0) -> Column:
    """Mean of the calibrated probabilities of the models from number ``first`` on."""
    parts = [1.0 / (1.0 + F.exp(-(F.get(margins, F.lit(first + i)) * slope + offset))) for i, (slope, offset) in enumerate(sigmoids)]
    return sum(parts[1:], parts[0]) / len(parts)


def _fit_masked(rows: DataFrame, masks: list[Column], params: Params) -> tuple[DataFrame, list[LinearSvm]]:
    """The rows as stored, and one SVM for each mask of rows to learn from, with class weights n / (2 n_c)."""
    named = [F.count_if(m & (F.col("label") == c)).alias(f"n{i}_{c}") for i, m in enumerate(masks) for c in (0, 1)]
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *named).first()
    costs = []
    for i, mask in enumerate(masks):
        n = [counts[f"n{i}_{c}"] for c in (0, 1)]
        if not all(n):
            raise ValueError(f"no rows of class {[c for c in (0, 1) if not n[c]]} to fit on; found {dict(enumerate(n))}")
        weight = F.when(F.col("label") == 1, sum(n) / (2.0 * n[1])).otherwise(sum(n) / (2.0 * n[0]))
        costs.append(F.when(mask, weight * params.svc_c).otherwise(0.0))
    # a solver's pass is short: few rows in many partitions would be all overhead
    rows = rows.withColumn("costs", F.array(*costs)).repartition(counts["rows"] // ROWS_PER_TASK + 1)
    rows = store(rows, "svm-rows")
    return rows, fit_many(rows, rows.select("features").first()["features"].size, len(masks), params.svc_max_iter)


def fit_svm(train: DataFrame, params: Params = FIRST) -> LinearSvm:
    """Linear SVM with class weights n / (2 n_c) and penalty C."""
    return _fit_masked(train, [F.lit(True)], params)[1][0]


def _calibrate(rows: DataFrame, svms: list[LinearSvm], held_out: list[Column]) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Rows with all margins, stored without features, and each model's sigmoid on the rows it has not seen."""
    scored = with_margins(rows, svms, "margins").drop("features", "costs")
    scored = store(scored, "margins")
    each = F.explode(F.array(*(F.when(h, F.struct(F.lit(i).alias("model"), F.get("margins", F.lit(i)).alias("margin"))) for i, h in enumerate(held_out))))
    seen = scored.select("label", each.alias("e")).where("e is not null").select("label", "e.model", "e.margin")
    return scored, fit_sigmoids(store(seen, "held-out"), len(svms))


def fit_calibrated_svm(train: DataFrame, params: Params = FIRST, key: str = "review_id") -> CalibratedSvm:
    """One SVM per fold, each calibrated on the fold it has not seen. ``key`` must be unique."""
    folded = stratified_folds(train.select(key, "label", "features"), key, "label", params.folds, f"calibrate-{params.seed}")
    folds = range(params.folds)
    rows, svms = _fit_masked(folded, [F.col("fold") != i for i in folds], params)
    _, sigmoids = _calibrate(rows, svms, [F.col("fold") == i for i in folds])
    return CalibratedSvm(svms, sigmoids)


def cross_validate(rows: DataFrame, params: Params = FIRST, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """(fold, f1_weighted) of a calibrated SVM per held-out fold, and their mean and deviation.

    The SVMs of all folds are fitted together: a row has its place in each fold's training rows.
    """
    folds = range(params.folds)
    narrow = cut_lineage(stratified_folds(rows.select(key, "label"), key, "label", params.folds, f"validate-{params.seed}"))
    for i in folds:
        inner = stratified_folds(narrow.where(F.col("fold") != i).select(key, "label"), key, "label", params.folds, f"calibrate-{params.seed}")
        narrow = narrow.join(inner.select(key, F.col("fold").alias(f"inner_{i}")), key, "left")
    folded = rows.select(key, "features").join(cut_lineage(narrow), key)
    pairs = [(i, j) for i in folds for j in folds]
    learns = [(F.col("fold") != i) & (F.col(f"inner_{i}") != j) for i, j in pairs]
    stored, svms = _fit_masked(folded, [F.coalesce(m, F.lit(False)) for m in learns], params)
    scored, sigmoids = _calibrate(stored, svms, [F.coalesce(F.col(f"inner_{i}") == j, F.lit(False)) for i, j in pairs])
    scores = []
    for i in folds:
        first = i * params.folds
        p = mean_probability("margins", sigmoids[first : first + params.folds], first)
        judged = scored.where(F.col("fold") == i).select("label", F.when(p > 0.5, 1).otherwise(0).alias("prediction"))
        scores.append((i, class_report(confusion(judged)).first()["f1_weighted"]))
    per_fold = rows.sparkSession.createDataFrame(scores, "fold int, f1_weighted double")
    return per_fold, mean_std(per_fold, "f1_weighted")
