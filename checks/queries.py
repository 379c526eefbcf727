"""Every operator as a query over the given tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
import numpy as np
from pyspark.sql import functions as F

from checks import views as V
from reelmill.functions.scoring import rating_weight, stars
from reelmill.functions.text import clean_text, collapse_phrases, ngrams, normalize_title, tokens, word_count
from reelmill.operators import factors as FA
from reelmill.operators import keywords as KW
from reelmill.operators import metrics as ME
from reelmill.operators import models as MO
from reelmill.operators import profiles as PR
from reelmill.operators import ranking as RK
from reelmill.operators import recommend as RC
from reelmill.operators import reviews as RV
from reelmill.operators import sampling as SA
from reelmill.operators import similarity as SI
from reelmill.operators import svm as SM
from reelmill.operators import tfidf as TF
from reelmill.params import FIRST, NEGATIVE_PHRASES, POSITIVE_PHRASES
from reelmill.plans import evaluate as EV
from reelmill.plans import serve as SV
from reelmill.plans import training as TR
from reelmill.session import cut_lineage, shared_folder, shuffles_dropped, spread, store
from reelmill.sources import artifacts as AR
from reelmill.sources import files as SF
from reelmill.streaming import feedback as FB

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
_SHARED: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def shared(build):
    """Artifacts that several queries read are built once per application and folder."""

    def get(spark: SparkSession, sf: str):
        key = (build.__name__, spark.sparkContext.applicationId, sf)
        if key not in _SHARED:
            _SHARED[key] = build(spark, sf)
        return _SHARED[key]

    return get


def forget() -> None:
    _SHARED.clear()


# --- artifacts -------------------------------------------------------------


@shared
def labelled(spark, sf):
    """Cleaned and labelled reviews, stored."""
    return cut_lineage(RV.label_reviews(RV.clean_reviews(spread(V.reviews(spark, sf), "review_id"))))


def corpus(spark, sf):
    return RV.training_rows(labelled(spark, sf))


def corpus_counts(spark, sf):
    return TF.term_counts(corpus(spark, sf), "review_id")


@shared
def vocabulary(spark, sf):
    return TF.fit_documents(corpus(spark, sf), "review_id")


@shared
def item_vectors(spark, sf):
    return cut_lineage(PR.build_item_profiles(labelled(spark, sf), vocabulary(spark, sf), FIRST))


@shared
def query_vectors(spark, sf):
    return cut_lineage(SV.query_vectors(V.queries(spark, sf), vocabulary(spark, sf)))


@shared
def feedback_state(spark, sf):
    return cut_lineage(FB.fold_feedback(V.feedback_events(spark, sf)))


@shared
def dense_items(spark, sf):
    return cut_lineage(SI.dense_vectors(V.table(spark, sf, "embeddings"), "vec_id", "embedding"))


def named_queries(spark, sf):
    """Benchmark texts asked by guests, accounts and named users in turn."""
    i = F.col("query_id")
    kind = F.when(i % 3 == 0, "guest").when(i % 3 == 1, "account").otherwise("user")
    return V.queries(spark, sf).withColumn("user", i).withColumn("kind", kind)


def given_factors(spark, sf):
    """Embeddings as factors: of users by vector id, of items by the name of their source."""
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("factors"))
    users = e.select(F.col("vec_id").alias("user"), "factors")
    items = e.select(F.concat(F.lit("src"), F.col("vec_id").cast("string")).alias("item"), "factors")
    return users, items


def favourites(spark, sf):
    return FB.favourites(feedback_state(spark, sf))


# --- projections, filters, predicates ----------------------------------------


@query
def canonical_columns(spark, sf):
    raw = V.raw_reviews(spark, sf)
    i = F.col("review_id")
    messy = raw.select(
        i.alias("Review_Id"), F.col("movie").alias("MOVIE"), F.col("rating").alias("Stars"),
        F.when(i % 3 != 0, F.col("review_detail")).alias("Text"), F.col("review_detail").alias("content"),
        F.col("spoiler_tag").alias("Is_Spoiler"),
    )
    return RV.canonical_columns(messy).select("review_id", "movie", "rating", "spoiler_tag", F.md5("review_detail").alias("text_md5"))


@query
def coerced_reviews(spark, sf):
    i = F.col("review_id")
    raw = V.raw_reviews(spark, sf).select(
        "review_id", F.when(i % 11 != 5, F.col("review_detail")).alias("review_detail"),
        F.when(i % 7 == 0, F.lit("n/a")).when(i % 7 == 1, F.lit(None)).when(i % 7 == 2, F.lit(" 8 ")).otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(i % 5 == 0, F.lit("yes")).when(i % 5 == 1, F.lit("1.7")).otherwise(F.col("spoiler_tag").cast("string")).alias("spoiler_tag"),
    )
    return RV.coerce_reviews(raw).select("review_id", "rating", "spoiler_tag")


@query
def cleaned_texts(spark, sf):
    docs = spread(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", clean_text(F.col("text")).alias("clean_text"))


@query
def cleaned_markup(spark, sf):
    pages = spread(V.table(spark, sf, "pages"), "page_id")
    return pages.select("page_id", clean_text(F.concat_ws(" ", "url", "html")).alias("clean_text"))


@query
def collapsed_phrases(spark, sf):
    docs = V.table(spark, sf, "documents")
    i = F.col("doc_id")
    extra = F.when(i % 3 == 0, "A MUST see, not worthy; well done <br/> https://a.b/c?d too long").when(i % 3 == 1, "waste of time and waste of money, edge of my seat").otherwise("fell asleep")
    text = F.lower(F.concat_ws(" ", "text", extra))
    text = collapse_phrases(collapse_phrases(text, POSITIVE_PHRASES), NEGATIVE_PHRASES)
    return docs.select("doc_id", F.md5(text).alias("text_md5"), clean_text(F.concat_ws(" ", "text", extra)).alias("clean_text"))


@query
def word_count_filter(spark, sf):
    cleaned = RV.clean_reviews(spread(V.reviews(spark, sf), "review_id"))
    return cleaned.select("review_id", word_count(F.col("clean_text")).alias("n_words"))


@query
def labelled_training_rows(spark, sf):
    return RV.training_rows(labelled(spark, sf)).select("review_id", "label", "rating")


@query
def normalized_titles(spark, sf):
    titles = V.titled_reviews(spark, sf).select("item").distinct().select(F.concat("item", F.lit(" (II) É")).alias("title"))
    return titles.select("title", normalize_title(F.col("title")).alias("title_key"), normalize_title(F.col("title"), True).alias("title_key_fixed"))


@query
def filtered_catalogue(spark, sf):
    kept = RV.filter_catalogue(V.catalogue(spark, sf), 1980, 2010, FIRST.title_types)
    return kept.select("tconst", "titleType", "primaryTitle", "year")


@query
def weighted_ratings(spark, sf):
    return V.raw_reviews(spark, sf).select("review_id", F.round(rating_weight(F.col("rating")), 6).alias("weight"))


@query
def shown_reviews(spark, sf):
    return RV.display_reviews(labelled(spark, sf)).select("review_id", "item", "user", "rating", "spoiler_tag", F.md5("review").alias("review_md5"))


@query
def result_links(spark, sf):
    part = V.table(spark, sf, "part")
    rows = part.select("p_partkey", F.concat("p_name", F.lit(" & "), "p_brand").alias("item"), (F.col("p_retailprice") / 1000).alias("final"))
    return SV.result_columns(rows).drop("final")


@query
def review_snippets(spark, sf):
    rows = V.reviews(spark, sf).select("review_id", "rating", "review")
    return SV.review_columns(rows).select("review_id", "stars", "snippet", "has_more")


@query
def personalized_queries(spark, sf):
    q = named_queries(spark, sf)
    p = RC.personalize(q, given_factors(spark, sf)[0], favourites(spark, sf), item_vectors(spark, sf))
    flags = q.select("query_id", "kind").join(p.select("query_id", F.lit(True).alias("p")), "query_id", "left")
    return flags.select("query_id", "kind", F.coalesce("p", F.lit(False)).alias("is_pers"))


# --- joins -------------------------------------------------------------------


@query
def catalogue_matches(spark, sf):
    return RV.filter_by_catalogue(V.titled_reviews(spark, sf), V.catalogue(spark, sf), 1980, 2010)


@query
def catalogue_retention(spark, sf):
    rows = V.titled_reviews(spark, sf)
    r = RV.retention(rows, RV.filter_by_catalogue(rows, V.catalogue(spark, sf), 1980, 2010))
    return r.select("n_before", "n_after", F.round("kept", 6).alias("kept"))


@query
def supported_items(spark, sf):
    return RK.min_support(labelled(spark, sf), "item", 3, (F.col("label") == 1) & (F.col("spoiler_tag") == 0))


@query
def active_users(spark, sf):
    return RK.min_support(V.interactions(spark, sf), "user", 30)


@query
def known_items(spark, sf):
    rows = V.interactions(spark, sf)
    known = RK.min_support(rows, "item", 30)
    return RK.keep_known(rows, known, "item").groupBy("user").agg(F.count(F.lit(1)).alias("n_known"))


@query
def not_yet_liked(spark, sf):
    state = feedback_state(spark, sf)
    liked = state.filter("favorite")
    return RK.exclude(state, liked, ["user", "item"]).select("user", "item", "rating")


@query
def numbered_items(spark, sf):
    return SA.dense_ids(V.interactions(spark, sf), "item", "item_index")


@query
def query_item_cosine(spark, sf):
    pairs = SI.cosine_pairs(query_vectors(spark, sf), item_vectors(spark, sf), "query_id", "item")
    return pairs.select("query_id", "item", F.round("cos", 6).alias("cos"))


@query
def dense_neighbours(spark, sf):
    items = dense_items(spark, sf)
    left = items.withColumnRenamed("vec_id", "query_id")
    top = SI.top_cosine(left, items, 10, "query_id", "vec_id", complete=True)
    return top.select("query_id", "vec_id", F.round("cos", 6).alias("cos"), "rank")


@query
def factor_dot_scores(spark, sf):
    users, items = given_factors(spark, sf)
    items = items.select(F.regexp_replace("item", "src", "").cast("bigint").alias("item"), "factors")
    scored = FA.factor_scores(FA.rating_cells(V.interactions(spark, sf)).select("user", "item"), users, items)
    return scored.select("user", "item", F.round("factor_score", 6).alias("factor_score"))


@query
def reviews_per_item(spark, sf):
    shown = RV.display_reviews(labelled(spark, sf))
    return SV.top_reviews(shown, shown, 3).select("item", "review_id", "rating", "spoiler_tag", "rank")


@query
def own_feedback(spark, sf):
    results = feedback_state(spark, sf).select("user").distinct().withColumn("item", F.concat(F.lit("src"), (F.col("user") % 25).cast("string")))
    joined = SV.attach_own_feedback(results, feedback_state(spark, sf))
    return joined.select("user", "item", "own_rating", "own_review", "own_stars")


# --- aggregations ------------------------------------------------------------


@query
def class_counts(spark, sf):
    b = RV.class_balance(RV.label_reviews(V.reviews(spark, sf)))
    return b.select("n_pos", "n_neg", F.round("ratio", 6).alias("ratio"))


@query
def user_item_cells(spark, sf):
    return FA.rating_cells(V.interactions(spark, sf))


@query
def active_user_cells(spark, sf):
    return FA.rating_cells(V.interactions(spark, sf), 20)


@query
def term_frequencies(spark, sf):
    return TF.term_statistics(corpus_counts(spark, sf)).filter("term <> ''")  # the empty term counts documents


@query
def fitted_vocabulary(spark, sf):
    return vocabulary(spark, sf).select("term", "term_id", "df", "ctf", F.round("idf", 6).alias("idf"))


@query
def capped_vocabulary(spark, sf):
    v = TF.fit_documents(corpus(spark, sf), "review_id", max_features=1500)
    return v.select("term", "term_id", "df", "ctf", F.round("idf", 6).alias("idf"))


@query
def item_profile_terms(spark, sf):
    terms = PR.item_terms(PR.profile_reviews(labelled(spark, sf), 3), vocabulary(spark, sf), FIRST)
    return terms.select("item", "term_id", F.round("weight", 6).alias("weight"))


@query
def item_profiles(spark, sf):
    v = item_vectors(spark, sf)
    return v.select("item", F.size("idx").alias("n_terms"), F.round("norm", 6).alias("norm"))


@query
def item_full_texts(spark, sf):
    texts = PR.item_texts(PR.profile_reviews(labelled(spark, sf), 3))
    return texts.select("item", "part", "n_texts", F.md5("clean_text").alias("text_md5"))


@query
def account_taste(spark, sf):
    t = SI.taste_vectors(favourites(spark, sf), item_vectors(spark, sf), "user")
    total = F.aggregate("val", F.lit(0.0), lambda a, x: a + x)
    return t.select("user", F.size("idx").cast("long").alias("n_terms"), F.round(total, 6).alias("total"), F.round(F.array_max("val"), 6).alias("top"))


@query
def mean_embeddings(spark, sf):
    members = V.table(spark, sf, "embeddings").select(F.col("label").alias("set_id"), F.col("vec_id").alias("item"))
    vectors = dense_items(spark, sf).withColumnRenamed("vec_id", "item")
    m = SI.unpack_vectors(SI.mean_vectors(members, vectors, "set_id"), "set_id")
    return m.select("set_id", "term_id", F.round("weight", 6).alias("weight"))


@query
def scaled_balances(spark, sf):
    scaled = RK.minmax(V.table(spark, sf, "customer"), "c_acctbal", ["c_nationkey"], "scaled")
    return scaled.select("c_custkey", F.round("scaled", 6).alias("scaled"))


def line_predictions(spark, sf):
    """Return flags as three classes, guessed from the line number."""
    flag = F.col("l_returnflag")
    return V.table(spark, sf, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        (F.col("l_linenumber") % 3).alias("prediction"), F.col("l_discount").alias("s0"),
        F.col("l_tax").alias("s1"), (F.col("l_quantity") % 7 + F.col("l_discount")).alias("s2"),
    )


@query
def confusion_matrix(spark, sf):
    return ME.confusion(line_predictions(spark, sf))


@query
def classification_summary(spark, sf):
    r = ME.class_report(ME.confusion(line_predictions(spark, sf)))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query
def classification_per_class(spark, sf):
    r = ME.per_class_report(ME.confusion(line_predictions(spark, sf)))
    return r.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def ranking_auc(spark, sf):
    orders = V.table(spark, sf, "orders")
    preds = orders.select(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"), F.col("o_totalprice").alias("score"))
    return ME.roc_auc(preds).select(F.round("roc_auc", 6).alias("roc_auc"))


@query
def ranking_auc_macro(spark, sf):
    r = ME.roc_auc_macro(line_predictions(spark, sf), "label", {0: "s0", 1: "s1", 2: "s2"})
    return r.select(F.round("roc_auc", 6).alias("roc_auc"))


@query
def score_mean_std(spark, sf):
    r = ME.mean_std(V.table(spark, sf, "orders"), "o_totalprice")
    return r.select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query
def account_summary(spark, sf):
    s = FB.user_summary(feedback_state(spark, sf))
    return s.select("user", "n_favorites", "n_ratings", F.round("mean_rating", 6).alias("mean_rating"), "n_reviews")


@query
def nested_account_state(spark, sf):
    n = FB.nested_state(feedback_state(spark, sf))
    return n.select(
        "user", "part", F.array_join("favorites", ",").alias("favorites"),
        F.array_join(F.transform(F.map_entries("ratings"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("ratings"),
        F.size(F.map_keys("reviews")).alias("n_reviews"),
    )


@query
def dashboard(spark, sf):
    items = item_vectors(spark, sf).select("item")
    users = V.interactions(spark, sf).select("user").distinct()
    report = ME.class_report(ME.confusion(line_predictions(spark, sf)))
    metrics = report.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    d = ME.dashboard_counts(items, users, metrics)
    return d.select("n_items", "n_users", F.round("accuracy", 6).alias("accuracy"), "explained_variance")


# --- ranking -----------------------------------------------------------------


@query
def query_candidates(spark, sf):
    pool = RC.query_pool(query_vectors(spark, sf), item_vectors(spark, sf), 5)
    return pool.select("query_id", "item", F.round("cos", 6).alias("cos"))


@query
def seed_candidates(spark, sf):
    seeds = favourites(spark, sf).withColumnRenamed("user", "query_id")
    vectors = SI.taste_vectors(seeds, item_vectors(spark, sf), "query_id")
    pool = RC.seed_pool(seeds, vectors, item_vectors(spark, sf), 5)
    return pool.select("query_id", "item", F.round("cos", 6).alias("cos"))


@query
def user_top_items(spark, sf):
    rows = V.reviews(spark, sf).select("user", "item")
    vectors = SI.mean_vectors(rows, item_vectors(spark, sf), "user")
    top = SI.top_cosine(vectors, item_vectors(spark, sf), 10, "user", "item", complete=True)
    return top.select("user", "item", F.round("cos", 6).alias("cos"), "rank")


@query
def account_keywords(spark, sf):
    k = SV.taste_keywords(favourites(spark, sf), item_vectors(spark, sf), vocabulary(spark, sf))
    return k.select("user", "term", F.round("weight", 6).alias("weight"), "rank")


@query
def explained_results(spark, sf):
    pool = RC.query_pool(query_vectors(spark, sf), item_vectors(spark, sf), 5)
    e = KW.explain(pool, query_vectors(spark, sf), item_vectors(spark, sf), vocabulary(spark, sf))
    return e.select("query_id", "item", "term", F.round("weight", 6).alias("weight"), "rank")


@query
def sorted_catalogue(spark, sf):
    users = V.interactions(spark, sf).select(F.col("user").alias("item"))
    return RK.catalogue_list(users, 50)


@query
def never_liked_items(spark, sf):
    cells = FA.rating_cells(V.interactions(spark, sf))
    return RK.unliked(cells, cells.filter("r >= 11"))


@query
def all_title_keys(spark, sf):
    return RV.title_keys(RV.filter_catalogue(V.catalogue(spark, sf), 1980, 2010, FIRST.title_types))


@query
def combined_parts(spark, sf):
    """Two parts with different columns as one table."""
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("text_md5"), "source")
    talks = V.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.md5("text").alias("text_md5"), "role")
    return docs.unionByName(talks, allowMissingColumns=True)


# --- sampling ----------------------------------------------------------------


@query
def balanced_reviews(spark, sf):
    return SA.balance(V.reviews(spark, sf)).select("review_id", "rating")


@query
def capped_balanced_reviews(spark, sf):
    return SA.balance(V.reviews(spark, sf), cap=120).select("review_id", "rating")


@query
def oversampled_rows(spark, sf):
    rows = RV.label_reviews(V.reviews(spark, sf)).filter("label <> -1").select("review_id", "label")
    return SA.oversample(rows, "review_id")


@query
def train_test_split(spark, sf):
    rows = RV.label_reviews(V.reviews(spark, sf)).select("review_id", "label")
    return SA.stratified_split(rows, "review_id")


@query
def validation_folds(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return SA.stratified_folds(rows, "o_orderkey")


@query
def sampled_users(spark, sf):
    users = RK.min_support(V.interactions(spark, sf), "user", 3)
    return SA.sample_keys(users, "user", 200)


# --- text features -------------------------------------------------------------


@query
def text_tokens(spark, sf):
    talks = V.table(spark, sf, "conversations")
    words = tokens(F.col("text"), raw=True)
    return talks.select("conv_id", "turn", F.array_join(words, "|").alias("tokens"))


@query
def text_ngrams(spark, sf):
    words = V.queries(spark, sf).select("query_id", F.explode(F.array(tokens(F.col("text"), raw=True))).alias("w"))
    grams = words.select("query_id", F.explode(ngrams(F.col("w"))).alias("term")).filter("term is not null")
    return grams.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query
def review_tfidf(spark, sf):
    w = TF.transform_tfidf(corpus(spark, sf), vocabulary(spark, sf), "review_id")
    return w.select("review_id", "term_id", F.round("weight", 6).alias("weight"))


@query
def query_tfidf(spark, sf):
    w = TF.transform_tfidf(V.queries(spark, sf), vocabulary(spark, sf), "query_id", "text", raw=True)
    return w.select("query_id", "term_id", F.round("weight", 6).alias("weight"))


# --- models (no SQL form) --------------------------------------------------------


@shared
def feature_table(spark, sf):
    rows = RV.training_rows(labelled(spark, sf)).select("review_id", "label")
    rows = SA.stratified_split(cut_lineage(rows), "review_id")
    vocab = vocabulary(spark, sf)
    vectors = SI.pack_vectors(TF.transform_tfidf(corpus(spark, sf), vocab, "review_id"), "review_id")
    return cut_lineage(MO.feature_rows(rows, vectors, vocab.count()))


@shared
def classifier(spark, sf):
    train = SA.oversample(feature_table(spark, sf).filter("not is_test"), "review_id")
    return MO.fit_calibrated_svm(train.withColumn("row_key", F.concat_ws("-", "review_id", "copy")), FIRST, "row_key")


@query
def sentiment_scores(spark, sf):
    scored = classifier(spark, sf).transform(feature_table(spark, sf))
    return scored.select("review_id", "label", "is_test", "prediction", F.round("probability", 4).alias("probability"))


@query
def sentiment_score_checks(spark, sf):
    """Every training row has one score; the prediction follows from it."""
    scored = classifier(spark, sf).transform(feature_table(spark, sf))
    p = F.col("probability")
    return scored.select("review_id", "label", "is_test", p.between(0, 1).alias("in_range"), ((p > 0.5).cast("int") == F.col("prediction")).alias("consistent"))


@query
def sentiment_fold_checks(spark, sf):
    """Cross-validation has one score for each fold, and they are averaged."""
    per_fold, summary = folds(spark, sf)
    s = per_fold.agg(F.avg("f1_weighted").alias("m"), F.stddev_pop("f1_weighted").alias("d"))
    close = (F.abs(s["m"] - summary["mean"]) < 1e-9) & (F.abs(s["d"] - summary["std"]) < 1e-9)
    averaged = s.crossJoin(summary).select(close.alias("averaged")).scalar()  # two tables of one row
    return per_fold.select("fold", F.col("f1_weighted").between(0, 1).alias("in_range"), averaged.alias("averaged"))


@query
def sentiment_report(spark, sf):
    scored = classifier(spark, sf).transform(feature_table(spark, sf).filter("is_test"))
    report = EV.evaluation_report(scored)
    s = report["summary"]
    auc = report["roc_auc"].select("roc_auc").scalar()
    return s.withColumn("roc_auc", auc).select(*[F.round(c, 4).alias(c) for c in [*s.columns, "roc_auc"]])


@query
def given_certificate(spark, sf):
    """Primal and dual value and gradient norm of two given models on the TF-IDF rows."""
    table = feature_table(spark, sf)
    rows = table.withColumn("costs", F.array(F.lit(1.0), F.lit(0.25)))
    size = vocabulary(spark, sf).count()
    given = [SM.LinearSvm((np.arange(size) * 37 % 11 - 5) / 10, 0.1), SM.LinearSvm(np.zeros(size), -0.2)]
    found = SM.certificate(rows, given)
    return found.select("model", *[F.round(c, 5).alias(c) for c in ("primal", "dual", "gradient_norm")])


@query
def fitted_certificate(spark, sf):
    """Every fitted model's dual value is within the solver's gap of its primal value."""
    svms = classifier(spark, sf).svms
    rows = [(i, 0 <= s.primal - s.dual <= SM.GAP * s.primal) for i, s in enumerate(svms)]
    return spark.createDataFrame(rows, "model int, optimal boolean")


@query
def reported_lines(spark, sf):
    """The whole report on given predictions of returned lines."""
    lines = V.table(spark, sf, "lineitem")
    preds = lines.select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_linenumber") % 2).alias("prediction"), F.col("l_discount").alias("probability"))
    report = EV.evaluation_report(preds)
    s = report["summary"].withColumn("roc_auc", report["roc_auc"].select("roc_auc").scalar())
    right = report["confusion"].where("label = prediction").agg(F.sum("n").alias("n")).scalar()
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns], right.alias("n_right"), report["per_class"].agg(F.sum("support").alias("n")).scalar().alias("n_rows"))


@shared
def folds(spark, sf):
    return MO.cross_validate(feature_table(spark, sf))


@query
def sentiment_cross_validation(spark, sf):
    per_fold, summary = folds(spark, sf)
    return summary.select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@shared
def rating_factors(spark, sf):
    with shuffles_dropped(spark):
        cells = store(FA.rating_cells(V.interactions(spark, sf)), "cells")
        users, items = FA.truncated_svd(cells, FIRST.svd_k, FIRST.svd_iterations)
        return cells, store(users, "user-factors"), store(items, "item-factors")


@query
def factorized_ratings(spark, sf):
    cells, users, items = rating_factors(spark, sf)
    return FA.factor_scores(cells, users, items).select("user", "item", "r", F.round("factor_score", 4).alias("factor_score"))


@query
def factor_variance(spark, sf):
    cells, users, _ = rating_factors(spark, sf)
    return FA.explained_variance(users, cells).select(F.round("explained_variance", 6).alias("explained_variance"))


@query
def given_variance(spark, sf):
    """The share of the cells' variance that given user factors would have."""
    users, _ = given_factors(spark, sf)
    found = FA.explained_variance(users, FA.rating_cells(V.interactions(spark, sf)))
    return found.select(F.round(F.col("explained_variance") * 1e6, 4).alias("millionths"))


@query
def factor_checks(spark, sf):
    """Item factors are orthonormal, and user factors are what the cells give on them.

    Only their number and products that are sums over items or cells are compared.
    """
    cells, users, items = rating_factors(spark, sf)
    k = F.size("factors")
    gram = FA.factor_gram(items)
    off = gram.select(F.max(F.abs(F.col("g") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("v")).scalar()
    # |A V|^2 = sum of r * (u . v) over the cells, if and only if u = A v.
    dots = FA.factor_scores(cells, users, items).agg(F.sum(F.col("r") * F.col("factor_score")).alias("s")).scalar()
    norm = users.agg(F.sum(F.aggregate("factors", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).scalar()
    return items.agg(F.count(F.lit(1)).alias("n_items"), F.max(k).alias("width")).select(
        "n_items", F.col("width").cast("long").alias("width"), (off < 1e-6).alias("orthonormal"), (F.abs(dots / norm - 1) < 1e-6).alias("projected")
    )


# --- recommendation -------------------------------------------------------------


def rounded(results, *keys):
    doubles = ("cos", "pers_raw", "cos_norm", "pers_norm", "final")
    return results.select(*keys, "is_pers", *[F.round(c, 6).alias(c) for c in doubles], "rank")


@query
def recommended_by_query(spark, sf):
    r = SV.recommend_by_query(V.queries(spark, sf), vocabulary(spark, sf), item_vectors(spark, sf), 3)
    return rounded(r, "query_id", "item")


@query
def recommended_by_query_plain(spark, sf):
    r = SV.recommend_by_query(V.queries(spark, sf), vocabulary(spark, sf), item_vectors(spark, sf), 5, use_mmr=False)
    return rounded(r, "query_id", "item")


@query
def recommended_personally(spark, sf):
    users, items = given_factors(spark, sf)
    r = SV.recommend_by_query(
        named_queries(spark, sf), vocabulary(spark, sf), item_vectors(spark, sf), 5, use_mmr=False,
        user_factors=users, item_factors=items, favourites=favourites(spark, sf),
    )
    return rounded(r, "query_id", "item")


@query
def recommended_by_seeds(spark, sf):
    seeds = favourites(spark, sf).withColumnRenamed("user", "query_id")
    return rounded(SV.recommend_by_items(seeds, item_vectors(spark, sf), 5, use_mmr=False), "query_id", "item")


@query
def account_home_feed(spark, sf):
    return rounded(SV.home_feed(favourites(spark, sf), item_vectors(spark, sf), 3), "query_id", "item")


@query
def diversified_neighbours(spark, sf):
    items = dense_items(spark, sf)
    pool = SI.top_cosine(items.withColumnRenamed("vec_id", "query_id"), items, 50, "query_id", "vec_id", complete=True).drop("rank")
    picks = RC.mmr_rerank(pool, items, 3, 0.6, "query_id", "vec_id", "cos", nonnegative=False)
    return picks.select("query_id", "vec_id", F.round("cos", 6).alias("cos"), "rank")


@query
def user_ranking_metrics(spark, sf):
    cells = FA.rating_cells(V.interactions(spark, sf))
    ranked = RK.top_k(cells, ["user"], [F.asc("item")], 10)
    relevant = cells.filter("r >= 7").select("user", "item")
    m = ME.list_metrics(ranked, relevant, (5, 10))
    return m.select("user", *[F.round(c, 6).alias(c) for c in m.columns if c != "user"])


@query
def mean_ranking_metrics(spark, sf):
    cells = FA.rating_cells(V.interactions(spark, sf))
    ranked = RK.top_k(cells, ["user"], [F.asc("item")], 10)
    m = ME.mean_metrics(ME.list_metrics(ranked, cells.filter("r >= 7"), (5, 10)), ["precision_5", "ndcg_5", "precision_10", "ndcg_10"])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query
def list_diversity(spark, sf):
    e = V.table(spark, sf, "embeddings")
    lists = e.select((F.col("vec_id") % 40).alias("list_id"), F.col("vec_id").alias("item"))
    d = SI.intra_list_diversity(lists, dense_items(spark, sf).withColumnRenamed("vec_id", "item"), "list_id")
    return d.select("list_id", F.round("ild", 6).alias("ild"))


def evaluated(spark, sf, params=FIRST, holdout=None):
    rows = labelled(spark, sf).select("review_id", "user", "item", "rating")
    e = EV.evaluate_offline(rows, item_vectors(spark, sf), params, holdout)
    counts = ("n_users_evaluated", "n_users_sampled")
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns if c not in counts], *counts)


@query
def offline_evaluation(spark, sf):
    return evaluated(spark, sf)


@query
def offline_evaluation_sampled(spark, sf):
    """The published reports evaluate a sample of the users; here 30 of them."""
    return evaluated(spark, sf, replace(FIRST, eval_users=30))


@query
def offline_evaluation_holdout(spark, sf):
    return evaluated(spark, sf, holdout=0.3)


def prepared(spark, sf, published_order):
    params = replace(FIRST, year_from=1980, year_to=1982)
    reviews, training = TR.prepare_reviews(V.raw_reviews(spark, sf), V.source_catalogue(spark, sf), params, published_order)
    used = training.select("review_id", F.lit(True).alias("used"))
    return reviews.join(used, "review_id", "left").select(
        "review_id", "item", "user", "rating", "label", F.coalesce("used", F.lit(False)).alias("is_training"), F.md5("clean_text").alias("text_md5")
    )


@query
def prepared_reviews(spark, sf):
    return prepared(spark, sf, False)


@query
def prepared_reviews_published_order(spark, sf):
    return prepared(spark, sf, True)


@query
def assembled_results(spark, sf):
    qv, iv, vocab = query_vectors(spark, sf), item_vectors(spark, sf), vocabulary(spark, sf)
    q = named_queries(spark, sf)
    r = SV.recommend_by_query(q, vocab, iv, 3, use_mmr=False)
    shown = RV.display_reviews(labelled(spark, sf))
    full = SV.assemble_results(r, KW.explain(r, qv, iv, vocab), shown, q, feedback_state(spark, sf))
    return full.select(
        "query_id", "item", "rank", "percent", "bar_width", "trailer_link", "title_link", "own_rating", "own_stars",
        F.array_join("explanation", "|").alias("explanation"),
        F.array_join(F.transform("reviews", lambda r: F.concat_ws(":", r["place"].cast("string"), r["user"], r["stars"])), "|").alias("shown"),
    )


@query
def assembled_from_seeds(spark, sf):
    """Results for favourites with explanations, keywords of the seeds and reviews."""
    iv, vocab = item_vectors(spark, sf), vocabulary(spark, sf)
    seeds = favourites(spark, sf).withColumnRenamed("user", "query_id")
    vectors, words = SV.seed_context(seeds, iv, vocab)
    r = cut_lineage(SV.recommend_by_items(seeds, iv, 3, use_mmr=False))  # read several times
    shown = RV.display_reviews(labelled(spark, sf))
    full = SV.assemble_results(r, KW.explain(r, vectors, iv, vocab), shown)
    listed = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
    return full.join(listed, "query_id", "left").select(
        "query_id", "item", "rank", "percent", F.array_join("explanation", "|").alias("explanation"), F.array_join("w.term", "|").alias("keywords"),
        F.array_join(F.transform("reviews", lambda r: F.concat_ws(":", r["place"].cast("string"), r["user"], r["stars"])), "|").alias("shown"),
    )


# --- sources and sinks: what is written is read back ---------------------------------


def new_folder(spark, name):
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def rename_parts(spark, folder, out, name):
    """Move the only text part of a folder to a name that the review reader takes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in fs.globStatus(hadoop.Path(folder, "part-*"))]
    fs.rename(part, hadoop.Path(out, name))


@query
def loaded_review_parts(spark, sf):
    """Reviews written as JSON lines, one array and one object of objects, and read as one table."""
    out = new_folder(spark, "reviews")
    raw = V.raw_reviews(spark, sf)
    kind = F.when(F.col("review_id") % 50 == 0, "array").when(F.col("review_id") % 50 == 1, "dict").otherwise("lines")
    lines = raw.where(kind == "lines").select(F.col("review_id").alias("Review_Id"), "movie", "reviewer", F.col("rating").alias("stars"), F.col("review_detail").alias("text"), F.struct(F.col("spoiler_tag").alias("flag")).alias("more"))
    lines.select("more", "Review_Id", "movie", "reviewer", "stars", "text").write.json(out)
    row = F.struct("review_id", "movie", "reviewer", "rating", F.col("review_detail").alias("content"))
    array = raw.where(kind == "array").agg(F.to_json(F.collect_list(row)).alias("value"))
    named = F.map_from_entries(F.collect_list(F.struct(F.col("review_id").cast("string"), row)))
    for name, text in (("array", array), ("dict", raw.where(kind == "dict").agg(F.to_json(named).alias("value")))):
        text.coalesce(1).write.text(f"{out}-{name}")
        rename_parts(spark, f"{out}-{name}", out, f"part-{name}.json")
    rows = TR.named_reviews(SF.read_reviews(spark, out))
    return rows.select(F.col("review_id").cast("bigint").alias("review_id"), "item", "user", "rating", F.md5("review").alias("text_md5"))


@query
def loaded_catalogue(spark, sf):
    """A tab-separated catalogue with nulls, quotes and columns in another order."""
    out = new_folder(spark, "titles")
    rows = V.catalogue(spark, sf).select(
        "startYear", F.when(F.col("tconst").cast("bigint") % 7 != 0, F.col("primaryTitle")).alias("primaryTitle"), F.lit("0").alias("isAdult"),
        "titleType", F.concat(F.lit('"'), "originalTitle").alias("originalTitle"), "tconst",
    )
    rows.write.option("sep", "\t").option("header", "true").option("nullValue", "\\N").option("quote", "").csv(out)
    return SF.read_catalogue(spark, out)


@query
def exported_reviews(spark, sf):
    """Cleaned reviews as CSV and back: quotes, commas and line ends in the texts."""
    out = new_folder(spark, "export")
    SF.write_csv(labelled(spark, sf), out)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    return back.select("item", "user", "rating", "label", "spoiler_tag", F.md5("review").alias("review_md5"), F.md5("clean_text").alias("text_md5"))


@query
def reloaded_vocabulary(spark, sf):
    out = new_folder(spark, "artifacts")
    AR.save_artifacts({"vocab": vocabulary(spark, sf), "item_vectors": item_vectors(spark, sf)}, out)
    tables, _ = AR.load_artifacts(spark, out, ("vocab", "item_vectors"), with_model=False)
    sizes = tables["item_vectors"].agg(F.sum(F.size("idx")).alias("n")).scalar()
    return tables["vocab"].select("term", "term_id", "df", "ctf", F.round("idf", 6).alias("idf"), sizes.alias("n_entries"))


def order_numbers(spark, sf):
    m = ME.mean_std(V.table(spark, sf, "orders"), "o_totalprice").first()
    return {"mean": m["mean"], "std": m["std"], "top_5": m["mean"] * 5, "top_10": m["mean"] * 10}


@query
def recorded_metrics(spark, sf):
    """Two runs of the same metrics; the later one counts, for each list length."""
    out = new_folder(spark, "metrics")
    AR.append_metrics(spark, out, "first", order_numbers(spark, sf))
    AR.append_metrics(spark, out, "second", {k: 2 * v for k, v in order_numbers(spark, sf).items() if k != "std"})
    return AR.latest_metrics(AR.read_metrics(spark, out)).select("metric", "k", F.round("value", 2).alias("value"), "run_id")


@query
def recorded_runs(spark, sf):
    out = new_folder(spark, "runs")
    for run_id, seed in (("first", 1), ("second", 2)):
        AR.record_run(spark, out, run_id, {"seed": seed}, order_numbers(spark, sf))
    return AR.read_runs(spark, out).select("run_id", F.col("config")["seed"].alias("seed"), F.round(F.col("results")["mean"], 2).alias("mean"))


@query
def prepared_bare_reviews(spark, sf):
    """Reviews without item, user and spoiler columns."""
    raw = V.raw_reviews(spark, sf).select("review_id", F.col("review_detail").alias("text"), F.col("rating").alias("score"))
    reviews, training = TR.prepare_reviews(raw)
    used = training.select("review_id", F.lit(True).alias("used"))
    return reviews.join(used, "review_id", "left").select("review_id", "label", F.coalesce("used", F.lit(False)).alias("is_training"), F.md5("clean_text").alias("text_md5"))


# --- feedback ---------------------------------------------------------------------


@query
def folded_feedback(spark, sf):
    return FB.fold_feedback(V.feedback_events(spark, sf))


@query
def streamed_feedback(spark, sf):
    """The events in six micro-batches, each of as many files as the cluster has cores, with snapshots on the way."""
    run = shared_folder(spark, f"stream-{uuid.uuid4().hex}")
    events, source = V.table(spark, sf, "events"), os.path.join(run, "in")
    width = spark.sparkContext.defaultParallelism
    events.repartition(6 * width, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", width).parquet(source)
    q = FB.stream_feedback(V.as_feedback(stream), os.path.join(run, "out"), os.path.join(run, "log"), compact_every=2)
    q.awaitTermination()
    return FB.stream_state(spark, os.path.join(run, "out"))


@query
def starred_ratings(spark, sf):
    parts = V.table(spark, sf, "part")
    return parts.select("p_partkey", stars(F.col("p_size") % 11).alias("stars"))
