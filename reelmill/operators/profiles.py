"""Item profiles: rating-weighted sums of review vectors, and the texts behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.scoring import rating_weight
from reelmill.operators.ranking import keep_known, min_support
from reelmill.operators.sampling import hash_key
from reelmill.operators.similarity import pack_vectors
from reelmill.operators.tfidf import transform_tfidf
from reelmill.params import Params


def profile_reviews(reviews: DataFrame, min_reviews: int = 3) -> DataFrame:
    """Good reviews without spoilers, of items that have at least ``min_reviews`` of them."""
    safe = reviews.filter((F.col("label") == 1) & (F.col("spoiler_tag") == 0) & F.col("item").isNotNull())
    if min_reviews <= 1:
        return safe
    return keep_known(safe, min_support(safe, "item", min_reviews), "item")


def item_terms(reviews: DataFrame, vocab: DataFrame, params: Params, partitioned: bool = False) -> DataFrame:
    """(item, term_id, weight) summed over reviews, each weighted by its rating.

    Item and weight travel with the review through the term counts, so no join brings them back;
    the sum per (item, term) is taken partially before the shuffle, so a hot item is spread over
    its terms and arrives in sums, not in reviews.
    """
    weighted = reviews.select("review_id", "item", rating_weight(F.col("rating")).alias("w"), "clean_text")
    terms = transform_tfidf(
        weighted, vocab, "review_id", "clean_text", params.ngram_range,
        keep=("item", "w"), partitioned=partitioned,
    )
    return terms.groupBy("item", "term_id").agg(F.sum(F.col("w") * F.col("weight")).alias("weight"))


def build_item_profiles(reviews: DataFrame, vocab: DataFrame, params: Params, partitioned: bool = False) -> DataFrame:
    """Packed profile vectors (item, idx, val, norm)."""
    return pack_vectors(item_terms(profile_reviews(reviews, params.min_item_reviews), vocab, params, partitioned), "item")


def item_texts(reviews: DataFrame, texts_per_part: int = 1000, seed: int = 42) -> DataFrame:
    """(item, part, n_texts, clean_text): all texts of an item joined by blanks, in hash order.

    An item with many reviews gets several parts, about ``texts_per_part`` each, in place of one
    string without bound; read in order of ``part`` they are the whole text.
    """
    sizes = reviews.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    h = hash_key("review_id", seed)
    fraction = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = reviews.select("item", "review_id", "clean_text", h.alias("_h")).join(sizes, "item")
    part = F.floor(fraction * F.ceil(F.col("_n") / F.lit(float(texts_per_part))))
    texts = F.array_sort(F.collect_list(F.struct("_h", "review_id", "clean_text")))
    return (
        rows.withColumn("part", part.cast("int"))
        .groupBy("item", "part")
        .agg(F.count(F.lit(1)).alias("n_texts"), texts.alias("_t"))
        .select("item", "part", "n_texts", F.array_join(F.col("_t.clean_text"), " ").alias("clean_text"))
    )
