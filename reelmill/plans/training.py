"""Preparation of reviews and the whole training run."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.operators.factors import explained_variance, rating_cells, truncated_svd
from reelmill.operators.models import CalibratedSvm, cross_validate, feature_rows, fit_calibrated_svm
from reelmill.operators.profiles import build_item_profiles, item_texts, profile_reviews
from reelmill.operators.reviews import (
    canonical_columns,
    clean_reviews,
    coerce_reviews,
    display_reviews,
    filter_by_catalogue,
    label_reviews,
    training_rows,
)
from reelmill.operators.sampling import balance, oversample, stratified_split
from reelmill.operators.similarity import pack_vectors
from reelmill.operators.tfidf import fit_documents, term_counts, transform_tfidf
from reelmill.params import FIRST, Params
from reelmill.plans.evaluate import evaluate_offline, evaluation_report, has_evaluation_columns
from reelmill.session import cut_lineage, small_side, store
from reelmill.sources.artifacts import append_metrics, record_run, save_artifacts
from reelmill.sources.files import write_csv


def named_reviews(df: DataFrame) -> DataFrame:
    """Canonical and coerced reviews with the column names the operators use."""
    df = coerce_reviews(canonical_columns(df))
    renames = {"review_detail": "review", "movie": "item", "reviewer": "user"}
    return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})


def prepare_reviews(
    raw: DataFrame, catalogue: DataFrame | None = None, params: Params = FIRST, published_order: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(cleaned and labelled reviews, rows to train the classifier on). ``raw`` needs a unique ``review_id``.

    Only the classifier's rows are balanced and cut to ``sample_size``; vocabulary, profiles, factors
    and shown reviews see every review. ``published_order`` balances first, as published, so that
    everything after it sees the balanced rows only. Keys and ratings are stored once and sampled
    there; texts are cleaned once.
    """
    df = named_reviews(raw)
    if catalogue is not None:
        df = filter_by_catalogue(df, catalogue, params.year_from, params.year_to, params.title_types)

    def balanced(rows: DataFrame) -> DataFrame:
        """The ids that stay, from a stored table of ids and ratings."""
        narrow = store(rows.select("review_id", "rating"), "ratings")
        kept = balance(narrow, "review_id", "rating", params.balance_ratio, params.sample_size, params.seed, params.positive_from, params.negative_to)
        return small_side(store(kept.select("review_id"), "balanced"))

    if published_order:
        df = df.join(balanced(df), "review_id", "left_semi")
    cleaned = clean_reviews(df, "review", params.min_words, params.max_words)
    labelled = label_reviews(cleaned, params.positive_from, params.negative_to)
    if published_order:
        return labelled, training_rows(labelled)
    labelled = store(labelled, "labelled")
    chosen = balanced(training_rows(labelled))
    return labelled, training_rows(labelled).join(chosen, "review_id", "left_semi")


def fit_vocabulary(docs: DataFrame, params: Params = FIRST, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, term counts) of cleaned texts."""
    vocab = fit_documents(docs, key, "clean_text", params.ngram_range, False, params.max_features, params.min_df, params.max_df)
    return vocab, term_counts(docs, key, "clean_text", params.ngram_range)


def train(
    raw: DataFrame,
    out: str,
    catalogue: DataFrame | None = None,
    params: Params = FIRST,
    run_id: str = "run",
    fit_on: str = "all",
    with_cv: bool = True,
    published_order: bool = False,
    exports: bool = False,
) -> dict[str, float]:
    """Run every training stage and store the artifacts under ``out``; returns the metrics.

    Seconds of each stage are among the metrics. ``exports`` also writes the cleaned and the shown
    reviews as CSV.

    ``fit_on="train"`` fits the vocabulary on training rows only, where the published order fits it
    on all rows before the split.
    """
    started = last = time.time()
    seconds: dict[str, float] = {}

    def done(stage: str) -> None:
        nonlocal last
        seconds[f"seconds_{stage}"], last = time.time() - last, time.time()

    spark = raw.sparkSession
    reviews, training = prepare_reviews(raw, catalogue, params, published_order)
    if published_order:
        reviews = store(reviews, "labelled")
        training = training_rows(reviews)
    training = store(stratified_split(training, "review_id", "label", params.test_fraction, params.seed), "training")
    done("prepare")
    corpus = training_rows(reviews) if fit_on == "all" else training.filter("not is_test")
    vocab, _ = fit_vocabulary(corpus, params)
    done("vocabulary")
    docs = corpus if fit_on == "all" and published_order else training
    vectors = pack_vectors(transform_tfidf(docs, vocab, "review_id", "clean_text", params.ngram_range), "review_id")
    size = vocab.count()
    rows = cut_lineage(feature_rows(training.select("review_id", "label", "is_test"), vectors, size))
    done("features")

    fit_rows = oversample(rows.filter("not is_test"), "review_id", "label", params.balance_ratio, params.seed)
    fit_rows = fit_rows.withColumn("row_key", F.concat_ws("-", "review_id", "copy"))
    model = fit_calibrated_svm(fit_rows, params, "row_key")
    report = evaluation_report(model.transform(rows.filter("is_test")))
    metrics = {**report["summary"].first().asDict(), **report["roc_auc"].first().asDict()}
    done("classifier")
    if with_cv:
        cv = cross_validate(rows, params)[1].first()
        metrics |= {"cv_f1": cv["mean"], "cv_f1_std": cv["std"]}
        done("cross_validation")

    tables: dict[str, DataFrame] = {"vocab": vocab}
    if "item" in reviews.columns:
        profiles = store(build_item_profiles(reviews, vocab, params), "profiles")
        metrics["n_items_profiled"] = float(profiles.count())
        tables |= {
            "item_vectors": profiles,
            "item_texts": item_texts(profile_reviews(reviews, params.min_item_reviews)),
            "display_reviews": display_reviews(reviews),
        }
        done("profiles")
        if has_evaluation_columns(reviews):
            metrics |= {k: float(v) for k, v in evaluate_offline(reviews, profiles, params).first().asDict().items()}
            done("evaluation")
    if has_evaluation_columns(reviews):
        cells = store(rating_cells(reviews, params.svd_min_user_rows), "cells")
        users, items = truncated_svd(cells, params.svd_k, params.svd_iterations, params.seed, params.svd_oversampling)
        users = store(users, "user-factors")
        metrics |= explained_variance(users, cells).first().asDict()
        tables |= {"user_factors": users, "item_factors": items}
        done("factors")
    save_artifacts(tables, out, model)
    if exports:
        write_csv(reviews, f"{out}/cleaned_reviews_csv")
        if "display_reviews" in tables:
            write_csv(tables["display_reviews"], f"{out}/display_reviews_csv")
    done("artifacts")
    metrics = {k: float(v) for k, v in metrics.items() if v is not None}
    metrics |= seconds | {"train_seconds": time.time() - started}
    append_metrics(spark, out, run_id, metrics)
    record_run(spark, out, run_id, asdict(params), metrics)
    return metrics


__all__ = ["CalibratedSvm", "fit_vocabulary", "named_reviews", "prepare_reviews", "train"]
