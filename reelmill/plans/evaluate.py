"""Offline evaluation of recommendations and of the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.operators.metrics import class_report, confusion, list_metrics, mean_metrics, per_class_report, roc_auc
from reelmill.operators.ranking import keep_known, min_support, top_k
from reelmill.operators.sampling import hash_key, sample_keys
from reelmill.operators.similarity import intra_list_diversity, mean_vectors, top_cosine
from reelmill.params import FIRST, Params
from reelmill.session import store


def evaluation_users(reviews: DataFrame, item_vectors: DataFrame, params: Params = FIRST) -> tuple[DataFrame, DataFrame]:
    """Reviews of known items by the sampled active users, and the sampled users."""
    known = store(keep_known(reviews.select("review_id", "user", "item", "rating"), item_vectors, "item"), "known")
    active = min_support(known, "user", params.eval_min_ratings).select("user")
    users = store(sample_keys(active, "user", params.eval_users, params.seed), "users")
    return keep_known(known, users, "user"), users


def evaluate_users(
    reviews: DataFrame, item_vectors: DataFrame, params: Params = FIRST, holdout: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Per evaluated user: precision, NDCG and diversity of the list; and the sampled users.

    A user's list are the items closest to the mean of the items the user rated, those included, as
    published. With ``holdout``, that share of the rows is kept for the ground truth only, and the
    rest forms the profile and is left out of the list.
    """
    rows, users = evaluation_users(reviews, item_vectors, params)
    profile_rows, truth_rows = rows, rows
    if holdout is not None:
        h = F.conv(F.substring(hash_key("review_id", f"holdout-{params.seed}"), 1, 8), 16, 10).cast("double") / float(1 << 32)
        rows = rows.withColumn("_held", h < holdout)
        profile_rows, truth_rows = rows.filter("not _held"), rows.filter("_held")
    relevant = truth_rows.filter(F.col("rating") >= params.positive_from).select("user", "item").distinct()
    profile_rows = profile_rows.join(relevant.select("user").distinct(), "user", "left_semi")
    vectors = mean_vectors(profile_rows, item_vectors, "user")
    size = max(params.eval_ks)
    if holdout is None:
        ranked = top_cosine(vectors, item_vectors, size, "user", "item", complete=True)
    else:
        seen = profile_rows.select("user", "item").distinct()
        asking = vectors.join(seen.groupBy("user").agg(F.count(F.lit(1)).alias("n")), "user")
        found = top_cosine(asking, item_vectors, F.lit(size) + F.col("n"), "user", "item", complete=True).drop("rank")
        rest = found.join(seen, ["user", "item"], "left_anti")
        ranked = top_k(rest, ["user"], [F.desc("cos"), F.asc("item")], size)
        relevant = relevant.join(vectors.select("user"), "user", "left_semi")
    scores = list_metrics(ranked, relevant, params.eval_ks)
    return scores.join(intra_list_diversity(ranked, item_vectors, "user"), "user", "left").withColumn(
        "ild", F.coalesce("ild", F.lit(0.0))
    ), users


def evaluate_offline(reviews: DataFrame, item_vectors: DataFrame, params: Params = FIRST, holdout: float | None = None) -> DataFrame:
    """One row: mean metrics, users sampled (as published) and users really evaluated."""
    per_user, users = evaluate_users(reviews, item_vectors, params, holdout)
    columns = [f"{m}_{k}" for k in params.eval_ks for m in ("precision", "ndcg")] + ["ild"]
    means = per_user.agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_users_evaluated")
    )
    sampled = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    return means.withColumn("n_users_sampled", sampled)


def has_evaluation_columns(df: DataFrame) -> bool:
    """Whether item and user steps can run at all."""
    return {"item", "user"} <= set(df.columns)


def evaluation_report(preds: DataFrame, score: str = "probability") -> dict[str, DataFrame]:
    """The whole report on predictions: matrix, per-class rows, summary row, area under the curve."""
    cm = confusion(preds)
    return {
        "confusion": cm,
        "per_class": per_class_report(cm).drop("tp"),
        "summary": class_report(cm),
        "roc_auc": roc_auc(preds, "label", score),
    }


__all__ = ["evaluate_offline", "evaluate_users", "evaluation_report", "has_evaluation_columns", "mean_metrics"]
