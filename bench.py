"""Headline queries and a whole training run at one scale; prints one JSON line.

Artifacts (cleaned reviews, vocabulary, item profiles, feedback state) are built by entries of
their own, which are timed like all others; later entries read them, as serving does.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as Q  # noqa: E402
from checks import views as V  # noqa: E402
from reelmill.params import FIRST  # noqa: E402
from reelmill.plans.training import train  # noqa: E402
from reelmill.session import drop_scratch, local_session, scratch_path  # noqa: E402

HEADLINES = [
    "cleaned_texts", "coerced_reviews", "catalogue_matches", "user_item_cells", "numbered_items", "balanced_reviews",
    "train_test_split", "validation_folds", "classification_summary", "ranking_auc", "user_ranking_metrics",
    "folded_feedback", "dense_neighbours", "review_tfidf", "query_item_cosine", "recommended_by_query",
    "explained_results", "account_keywords", "offline_evaluation", "factorized_ratings",
]
ARTIFACTS = {
    "build_labelled_reviews": Q.labelled, "fit_vocabulary": Q.vocabulary, "build_item_profiles": Q.item_vectors,
    "fold_feedback_state": Q.feedback_state,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name, build in ARTIFACTS.items():
        start = time.time()
        build(spark, sf_dir)
        times[name] = round(time.time() - start, 3)
    for name in HEADLINES:
        start = time.time()
        Q.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    raw = V.raw_reviews(spark, sf_dir)
    start = time.time()
    metrics = train(raw, scratch_path(spark, "trained"), None, FIRST)
    times["train"] = round(time.time() - start, 3)
    stages = {k.removeprefix("seconds_"): round(v, 3) for k, v in metrics.items() if k.startswith("seconds_")}
    drop_scratch(spark)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "train_stages": stages, "train_rows": raw.count(), "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
