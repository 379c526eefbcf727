"""Scalar expressions on ratings, scores and result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_ELEVEN = math.log(11.0)


def assign_label(rating: Column, positive_from: float = 7, negative_to: float = 4) -> Column:
    """1 for good, 0 for bad, -1 for neither."""
    return F.when(rating >= positive_from, 1).when(rating <= negative_to, 0).otherwise(-1)


def rating_weight(rating: Column) -> Column:
    """ln(r + 1) / ln(11): a full rating weighs one."""
    return F.log(rating + 1) / F.lit(LOG_ELEVEN)


def blend(cos_norm: Column, pers_norm: Column, is_personalized: Column, w_cos: float) -> Column:
    """Weighted content and personal score; content alone for a cold start."""
    mixed = cos_norm * w_cos + pers_norm * (1.0 - w_cos)
    return F.when(is_personalized, mixed).otherwise(cos_norm)


def stars(rating: Column) -> Column:
    """Five-star text for a rating of one to ten; halves go to the even number."""
    n = F.bround(rating.cast("double") / 2, 0).cast("int")
    full = F.least(F.greatest(n, F.lit(0)), F.lit(5))
    return F.when(n.isNotNull(), F.concat(F.repeat(F.lit("⭐"), full), F.repeat(F.lit("☆"), 5 - full)))


def snippet(text: Column, length: int = 150) -> Column:
    """The first characters of a text, marked with dots if anything is left out."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def trailer_link(title: Column) -> Column:
    query = F.url_encode(F.concat(title, F.lit(" official trailer")))
    return F.concat(F.lit("https://www.youtube.com/results?search_query="), query)


def title_link(title: Column) -> Column:
    return F.concat(F.lit("https://www.imdb.com/find?q="), F.url_encode(title), F.lit("&s=tt"))


def discount(position: Column) -> Column:
    """Gain of a hit at a 1-based position: 1 / log2(position + 1)."""
    return F.lit(1.0) / F.log2(position + 1)


def ideal_gain(n_relevant: Column, k: int) -> Column:
    """Gain of the best possible list of length k."""
    places = F.when(F.least(n_relevant, F.lit(k)) > 0, F.sequence(F.lit(1), F.least(n_relevant, F.lit(k)).cast("int")))
    return F.coalesce(
        F.aggregate(places, F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / F.log2(p.cast("double") + 1)),
        F.lit(0.0),
    )
