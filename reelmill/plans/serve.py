"""Recommendation in batch: a table of queries or of seed sets in, ranked results out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.scoring import snippet, stars, title_link, trailer_link
from reelmill.operators.keywords import keywords
from reelmill.operators.ranking import top_k
from reelmill.operators.recommend import blend_scores, finish, personalize, query_pool, rank_blended, seed_pool
from reelmill.operators.similarity import pack_vectors, taste_vectors
from reelmill.operators.tfidf import transform_tfidf
from reelmill.params import FIRST, Params
from reelmill.session import cut_lineage


def query_vectors(queries: DataFrame, vocab: DataFrame, params: Params = FIRST) -> DataFrame:
    """Packed vectors of raw query texts; a text without known terms has none."""
    terms = transform_tfidf(queries, vocab, "query_id", "text", params.ngram_range, raw=True)
    return pack_vectors(terms, "query_id")


def recommend_by_query(
    queries: DataFrame,
    vocab: DataFrame,
    item_vectors: DataFrame,
    n: int = 5,
    params: Params = FIRST,
    use_mmr: bool = True,
    user_factors: DataFrame | None = None,
    item_factors: DataFrame | None = None,
    favourites: DataFrame | None = None,
) -> DataFrame:
    """(query_id, item, cos, is_pers, pers_raw, cos_norm, pers_norm, final, rank).

    ``queries`` is (query_id, text) and, for personal results, (user, kind).
    """
    pool = query_pool(cut_lineage(query_vectors(queries, vocab, params)), item_vectors, n)
    personal = None
    if "kind" in queries.columns:
        personal = personalize(queries, user_factors, favourites, item_vectors)
    return finish(pool, item_vectors, n, params.w_cos, use_mmr, params.mmr_lambda, personal, item_factors)


def recommend_by_items(
    seeds: DataFrame,
    item_vectors: DataFrame,
    n: int = 5,
    params: Params = FIRST,
    use_mmr: bool = True,
    exclude_seeds: bool = True,
    queries: DataFrame | None = None,
    user_factors: DataFrame | None = None,
    item_factors: DataFrame | None = None,
    favourites: DataFrame | None = None,
) -> DataFrame:
    """Results for seed sets (query_id, item, rating); a null rating counts as ten.

    ``queries`` (query_id, user, kind) says who asks; without it nobody is known.
    """
    vectors = taste_vectors(seeds, item_vectors, "query_id")
    pool = seed_pool(seeds, vectors, item_vectors, n, exclude_seeds)
    personal = None
    if queries is not None:
        personal = personalize(queries, user_factors, favourites, item_vectors)
    return finish(pool, item_vectors, n, params.w_cos, use_mmr, params.mmr_lambda, personal, item_factors)


def seed_context(seeds: DataFrame, item_vectors: DataFrame, vocab: DataFrame, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """What results for seed sets are shown with: (query_id, idx, val, norm), the vector that explanations
    compare items with, and (query_id, term, weight, rank), the keywords of the seeds."""
    return taste_vectors(seeds, item_vectors, "query_id"), keywords(seeds, item_vectors, vocab, "query_id", n)


def home_feed(favourites: DataFrame, item_vectors: DataFrame, n: int = 5, params: Params = FIRST, use_mmr: bool = True) -> DataFrame:
    """Results for every account from its own favourites (user, item, rating), seen as that account.

    The seeds and the account's taste are the same vector here, so the personal score is the cosine
    the pool already has.
    """
    seeds = favourites.select(F.col("user").alias("query_id"), "item", "rating")
    vectors = taste_vectors(seeds, item_vectors, "query_id")
    pool = seed_pool(seeds, vectors, item_vectors, n)
    known = pool.withColumn("is_pers", F.lit(True)).withColumn("pers_raw", F.col("cos"))
    return rank_blended(blend_scores(known, params.w_cos), item_vectors, n, use_mmr, params.mmr_lambda)


def taste_keywords(favourites: DataFrame, item_vectors: DataFrame, vocab: DataFrame, n: int = 8) -> DataFrame:
    """The terms that stand for each account's favourites."""
    return keywords(favourites, item_vectors, vocab, "user", n)


def top_reviews(items: DataFrame, reviews: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` reviews of each item: without spoilers first, then by rating, then by id."""
    wanted = reviews.join(items.select("item").distinct(), "item", "left_semi")
    return top_k(wanted, ["item"], [F.asc("spoiler_tag"), F.desc("rating"), F.asc("review_id")], n)


def result_columns(results: DataFrame) -> DataFrame:
    """Add percent, bar width and search links."""
    percent = F.round(F.col("final") * 100, 1)
    return (
        results.withColumn("percent", percent)
        .withColumn("bar_width", F.least(percent, F.lit(100.0)))
        .withColumn("trailer_link", trailer_link(F.col("item").cast("string")))
        .withColumn("title_link", title_link(F.col("item").cast("string")))
    )


def review_columns(reviews: DataFrame, length: int = 150) -> DataFrame:
    """Add stars, snippet and whether there is more to read."""
    return (
        reviews.withColumn("stars", stars(F.col("rating")))
        .withColumn("snippet", snippet(F.col("review"), length))
        .withColumn("has_more", F.length("review") > length)
    )


def attach_own_feedback(results: DataFrame, state: DataFrame) -> DataFrame:
    """Add the asking account's rating, stars and review to (user, item, ...) rows."""
    own = state.select("user", "item", F.col("rating").alias("own_rating"), F.col("review").alias("own_review"))
    return results.join(own, ["user", "item"], "left").withColumn("own_stars", stars(F.col("own_rating")))


def review_list(results: DataFrame, reviews: DataFrame, state: DataFrame | None = None, n: int = 3) -> DataFrame:
    """(query_id, item, place, user, rating, stars, text, spoiler): what is shown below each result.

    The asking account's own review, if there is any, comes ahead of the community's.
    """
    shown = review_columns(top_reviews(results, reviews, n))
    text = F.when(F.col("spoiler_tag") == 1, F.col("review")).otherwise(F.col("snippet"))
    community = results.select("query_id", "item").join(shown, "item").select(
        "query_id", "item", F.col("rank").alias("place"), F.col("user").cast("string").alias("user"),
        F.col("rating").cast("double").alias("rating"), "stars", text.alias("text"),
        (F.col("spoiler_tag") == 1).alias("spoiler"),
    )
    if state is None or "user" not in results.columns:
        return community
    has_own = F.col("rating").isNotNull() | (F.coalesce(F.col("review"), F.lit("")) != "")
    mine = state.filter(has_own).select("user", "item", "rating", "review")
    own = results.select("query_id", "user", "item").join(mine, ["user", "item"]).select(
        "query_id", "item", F.lit(0).alias("place"), F.col("user").cast("string").alias("user"),
        F.col("rating").cast("double").alias("rating"), F.coalesce(stars(F.col("rating")), F.lit("")).alias("stars"),
        F.when(F.col("review") != "", F.col("review")).alias("text"), F.lit(False).alias("spoiler"),
    )
    return own.unionByName(community)


def assemble_results(
    results: DataFrame,
    explanations: DataFrame,
    reviews: DataFrame,
    askers: DataFrame | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """One row per result with scores, links, explanation terms, reviews and own feedback.

    A result has a handful of terms and reviews, so the nested lists are small.
    """
    if askers is not None:
        results = results.join(askers.select("query_id", "user"), "query_id", "left")
    terms = explanations.groupBy("query_id", "item").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t")
    ).select("query_id", "item", F.col("_t.term").alias("explanation"))
    listed = review_list(results, reviews, state)
    entry = F.struct("place", "user", "rating", "stars", "text", "spoiler")
    texts = listed.groupBy("query_id", "item").agg(F.array_sort(F.collect_list(entry)).alias("reviews"))
    out = result_columns(results).join(terms, ["query_id", "item"], "left").join(texts, ["query_id", "item"], "left")
    if state is not None and askers is not None:
        out = attach_own_feedback(out, state)
    return out
