"""Review table: canonical columns, coercion, filters, labels and catalogue matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.functions.scoring import assign_label
from reelmill.functions.text import clean_text, normalize_title, word_count
from reelmill.params import COLUMN_ALIASES
from reelmill.session import small_side

REQUIRED = ("rating", "review_detail")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names and fold aliases into the three canonical ones.

    If a column occurs under several aliases, the first non-null one counts, the canonical name
    first and then the aliases in table order.
    """
    by_name: dict[str, list[str]] = {}
    for name in df.columns:
        by_name.setdefault(name.lower(), []).append(name)
    target = {alias: name for name, aliases in COLUMN_ALIASES.items() for alias in aliases}
    picked: dict[str, list[Column]] = {}
    for name in by_name:
        if name not in target:
            picked[name] = [F.col(f"`{c}`") for c in by_name[name]]
    for name, aliases in COLUMN_ALIASES.items():
        for alias in aliases:
            if alias in by_name:
                picked.setdefault(name, []).extend(F.col(f"`{c}`") for c in by_name[alias])
    out = []
    for name, columns in picked.items():
        if len(columns) > 1 and name in COLUMN_ALIASES:
            columns = [c.cast("string") for c in columns]
        out.append((F.coalesce(*columns) if len(columns) > 1 else columns[0]).alias(name))
    return df.select(*out)


def require_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; found {df.columns}")
    return df


def to_number(df: DataFrame, column: str) -> Column:
    """Number or null; text that is no number, and NaN, are null."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return value.cast("int").cast("double")
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce_reviews(df: DataFrame) -> DataFrame:
    """Numeric rating, integer spoiler flag (0 where absent or unreadable), no rows without text or rating."""
    require_columns(df)
    spoiler = F.lit(0)
    if "spoiler_tag" in df.columns:
        spoiler = F.coalesce(to_number(df, "spoiler_tag").try_cast("int"), F.lit(0))
    return (
        df.withColumn("rating", to_number(df, "rating"))
        .withColumn("spoiler_tag", spoiler)
        .filter(F.col("rating").isNotNull() & F.col("review_detail").isNotNull())
    )


def quality_filter(df: DataFrame, low: int = 10, high: int = 2000, text: str = "clean_text") -> DataFrame:
    """Texts of ``low`` to ``high`` words, both included."""
    return df.filter(word_count(F.col(text)).between(low, high))


def clean_reviews(df: DataFrame, text: str = "review", low: int = 10, high: int = 2000) -> DataFrame:
    """Add ``clean_text`` and keep texts of the right length.

    The text is cleaned in a generator of one row. As a plain column the optimizer would push the
    length filter below it and clean every text twice.
    """
    cleaned = df.select("*", F.explode(F.array(clean_text(F.col(text)))).alias("clean_text"))
    return quality_filter(cleaned, low, high)


def label_reviews(df: DataFrame, positive_from: float = 7, negative_to: float = 4) -> DataFrame:
    return df.withColumn("label", assign_label(F.col("rating"), positive_from, negative_to))


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with a clear label and no spoiler."""
    return df.filter((F.col("label") != -1) & (F.col("spoiler_tag") == 0))


def filter_catalogue(catalogue: DataFrame, year_from: int, year_to: int, types: tuple[str, ...]) -> DataFrame:
    """Titles of the wanted types with a readable year in the closed range."""
    year = F.col("startYear").try_cast("double")
    return catalogue.filter(F.col("titleType").isin(*types)).withColumn("year", year).filter(
        F.col("year").between(year_from, year_to)
    )


def title_keys(catalogue: DataFrame, roman_fix: bool = False) -> DataFrame:
    """Distinct matching keys of primary and original titles; empty keys would match anything."""
    columns = [c for c in ("primaryTitle", "originalTitle") if c in catalogue.columns]
    keys = catalogue.select(F.explode(F.array(*columns)).alias("title")).select(
        normalize_title(F.col("title"), roman_fix).alias("title_key")
    )
    return keys.filter("title_key <> ''").distinct()


def filter_by_catalogue(
    reviews: DataFrame,
    catalogue: DataFrame,
    year_from: int = 1980,
    year_to: int = 2024,
    types: tuple[str, ...] = ("movie", "tvSeries", "tvMovie", "short"),
    item: str = "item",
    roman_fix: bool = False,
) -> DataFrame:
    """Reviews of items whose title is in the filtered catalogue.

    The catalogue is matched with the distinct item names first, which are few and narrow. The wide
    review rows are then filtered by that name list, without being shuffled while it is small.
    """
    keys = title_keys(filter_catalogue(catalogue, year_from, year_to, types), roman_fix)
    names = reviews.select(item).distinct().withColumn("title_key", normalize_title(F.col(item), roman_fix))
    valid = names.join(keys, "title_key", "left_semi").select(item)
    return reviews.join(small_side(valid), item, "left_semi")


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, kept) of a filter."""
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_after")
    ).withColumn("kept", F.col("n_after") / F.greatest("n_before", F.lit(1)))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """(n_pos, n_neg, ratio)."""
    n_pos, n_neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), (n_pos / F.greatest(n_neg, F.lit(1))).alias("ratio"))


def display_reviews(df: DataFrame) -> DataFrame:
    """Positive reviews as they are shown, spoilers included."""
    columns = [c for c in ("review_id", "item", "user", "rating", "review", "spoiler_tag") if c in df.columns]
    return df.filter("label = 1").select(*columns)
