"""Classification, ranking and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.functions.scoring import discount, ideal_gain
from reelmill.session import cut_lineage


def confusion(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) in long form."""
    return preds.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class_report(cm: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class; zero where nothing can be divided."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_truth = cm.select(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp"))
    by_guess = cm.select(F.col("prediction").alias("c"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long"))
    sums = by_truth.union(by_guess).groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    rated = sums.select(F.col("c").alias("label"), p.alias("precision"), r.alias("recall"), "support", "tp")
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select("label", "precision", "recall", f1.alias("f1"), "support", "tp")


def class_report(cm: DataFrame) -> DataFrame:
    """One row: accuracy, weighted and macro precision, recall and F1."""
    n = F.sum("support")
    cells = [(F.sum("tp") / n).alias("accuracy")]
    for name in ("precision", "recall", "f1"):
        cells.append((F.sum(F.col(name) * F.col("support")) / n).alias(f"{name}_weighted"))
        cells.append(F.avg(name).alias(f"{name}_macro"))
    return per_class_report(cm).agg(*cells)


def roc_auc(preds: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve for labels 0 and 1; null if a class is missing.

    Rank-sum form with half credit for ties: equal scores are counted together, the distinct scores
    are range-partitioned, and running sums are taken inside each range on top of the totals of the
    ranges below. The ranges are stored, since sampling could cut them otherwise on a second run.
    """
    points = preds.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    )
    n = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(points.repartitionByRange(n, "s").withColumn("b", F.spark_partition_id()))
    totals = placed.groupBy("b").agg(F.sum("q").alias("tq"))  # one row per range
    below = totals.select("b", (F.sum("tq").over(W.partitionBy().orderBy("b")) - F.col("tq")).alias("below"))
    inside = F.sum("q").over(W.partitionBy("b").orderBy("s")) - F.col("q")
    ranked = placed.withColumn("i", inside).join(F.broadcast(below), "b")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("i") + F.col("q") / 2.0))
    pairs = F.sum("p").cast("double") * F.sum("q")
    return ranked.agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def roc_auc_macro(preds: DataFrame, label: str, scores: dict[int, str]) -> DataFrame:
    """Mean of the one-against-the-rest areas for three or more classes."""
    areas = [
        roc_auc(preds.select(F.when(F.col(label) == c, 1).otherwise(0).alias("y"), F.col(s).alias("s")), "y", "s")
        for c, s in scores.items()
    ]
    return reduce(DataFrame.unionByName, areas).agg(F.avg("roc_auc").alias("roc_auc"))


def mean_std(df: DataFrame, column: str) -> DataFrame:
    """(mean, std) with the population standard deviation."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def mean_metrics(per_user: DataFrame, columns: list[str]) -> DataFrame:
    """Means over users, zero if there are none."""
    return per_user.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def list_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...], user: str = "user", item: str = "item") -> DataFrame:
    """(user, precision_k, ndcg_k for each k) for users that have relevant items.

    ``ranked`` is (user, item, rank from 1), ``relevant`` the distinct (user, item) that count.
    """
    flags = ranked.join(relevant.select(user, item).withColumn("_hit", F.lit(1)), [user, item], "left")
    sums = []
    for k in ks:
        hit = (F.col("_hit") == 1) & (F.col("rank") <= k)
        sums.append(F.count_if(hit).alias(f"_hits_{k}"))
        sums.append(F.coalesce(F.sum(F.when(hit, discount(F.col("rank")))), F.lit(0.0)).alias(f"_dcg_{k}"))
    gains = flags.groupBy(user).agg(*sums)
    totals = relevant.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    cells = []
    for k in ks:
        hits, dcg = F.coalesce(f"_hits_{k}", F.lit(0)), F.coalesce(f"_dcg_{k}", F.lit(0.0))
        cells.append((hits / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias(f"precision_{k}"))
        best = ideal_gain(F.col("_n"), k)
        cells.append(F.when(best > 0, dcg / best).otherwise(F.lit(0.0)).alias(f"ndcg_{k}"))
    return totals.join(gains, user, "left").select(user, *cells)


def precision_at_k(ranked: DataFrame, relevant: DataFrame, k: int, user: str = "user") -> DataFrame:
    return list_metrics(ranked, relevant, (k,), user).select(user, f"precision_{k}")


def ndcg_at_k(ranked: DataFrame, relevant: DataFrame, k: int, user: str = "user") -> DataFrame:
    return list_metrics(ranked, relevant, (k,), user).select(user, f"ndcg_{k}")


def dashboard_counts(items: DataFrame, users: DataFrame, metrics: DataFrame) -> DataFrame:
    """(n_items, n_users, accuracy, explained_variance), the latter two from the metrics table."""
    kinds = (
        items.select(F.lit("item").alias("k"), F.lit(None).cast("double").alias("v"))
        .unionAll(users.select(F.lit("user"), F.lit(None).cast("double")))
        .unionAll(metrics.filter(F.col("metric").isin("accuracy", "explained_variance")).select("metric", "value"))
    )
    return kinds.agg(
        F.count_if(F.col("k") == "item").alias("n_items"),
        F.count_if(F.col("k") == "user").alias("n_users"),
        F.max(F.when(F.col("k") == "accuracy", F.col("v"))).alias("accuracy"),
        F.max(F.when(F.col("k") == "explained_variance", F.col("v"))).alias("explained_variance"),
    )
