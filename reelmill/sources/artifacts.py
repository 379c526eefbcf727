"""Stored tables of a training run, its metrics and its record."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.operators.models import CalibratedSvm

TABLES = ("vocab", "item_vectors", "item_texts", "display_reviews", "user_factors", "item_factors")
CLASSIFIER = "classifier"


def save_artifacts(tables: dict[str, DataFrame], path: str, model: CalibratedSvm | None = None) -> None:
    """One Parquet folder per table, and the classifier's own format."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
    if model is not None:
        model.save(os.path.join(path, CLASSIFIER))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_artifacts(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES, with_model: bool = True):
    """(tables by name, classifier). Raises if any of them is missing, naming all that are."""
    tables, missing, model = {}, [], None
    for name in names:
        if _exists(spark, os.path.join(path, name)):
            tables[name] = spark.read.parquet(os.path.join(path, name))
        else:
            missing.append(name)
    if with_model:
        if _exists(spark, os.path.join(path, CLASSIFIER)):
            model = CalibratedSvm.load(spark, os.path.join(path, CLASSIFIER))
        else:
            missing.append(CLASSIFIER)
    if missing:
        raise FileNotFoundError(f"missing artifacts in {path}: {missing}; run the training first")
    return tables, model


METRICS_SCHEMA = "run_id string, metric string, k int, value double, recorded timestamp"


def append_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict[str, float]) -> None:
    """Append scalars to the metrics table; ``name_5`` is stored as (name, k=5)."""
    rows = []
    for name, value in metrics.items():
        base, _, tail = name.rpartition("_")
        rows.append((run_id, base, int(tail), float(value)) if base and tail.isdigit() else (run_id, name, None, float(value)))
    df = spark.createDataFrame(rows, "run_id string, metric string, k int, value double").withColumn("recorded", F.current_timestamp())
    df.coalesce(1).write.mode("append").parquet(os.path.join(path, "metrics"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).parquet(os.path.join(path, "metrics"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, k, value, run_id): of every metric what was recorded last; of one time, by run and value."""
    last = F.max(F.struct("recorded", "run_id", "value")).alias("m")
    return metrics.groupBy("metric", "k").agg(last).select("metric", "k", "m.value", "m.run_id")


def read_metric(spark: SparkSession, path: str, metric: str, run_id: str | None = None, k: int | None = None) -> float | None:
    """The value of a metric recorded last, or null if there is none.

    A metric that is kept for several list lengths needs ``k``.
    """
    rows = read_metrics(spark, path).filter(F.col("metric") == metric)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    found = {r["k"]: r["value"] for r in latest_metrics(rows).collect()}  # one row per list length
    if k is None and len(found) > 1:
        raise ValueError(f"{metric} is recorded for k = {sorted(x for x in found if x is not None)}; say which")
    return found.get(k) if k is not None else next(iter(found.values()), None)


def record_run(spark: SparkSession, path: str, run_id: str, config: dict, results: dict[str, float]) -> None:
    """Append one row with the date, the configuration as text and the results as a map."""
    row = [(run_id, {k: str(v) for k, v in config.items()}, results)]
    df = spark.createDataFrame(row, "run_id string, config map<string,string>, results map<string,double>")
    df = df.withColumn("date", F.date_format(F.current_timestamp(), "yyyy-MM-dd"))
    df.coalesce(1).write.mode("append").parquet(os.path.join(path, "runs"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "runs"))
