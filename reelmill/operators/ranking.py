"""Top-k, min-max scaling and key-set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.session import small_side


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per partition, ranked from 1.

    ``row_number() <= k`` lets Spark drop rows map-side (window group limit), so that a hot
    partition shuffles at most k rows per task. ``order`` must end in a unique key.
    """
    place = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k)


def minmax(df: DataFrame, column: str, partition: list[str], out: str) -> DataFrame:
    """Scale to [0, 1] within each partition; all ones where the range is below 1e-9.

    The partitions are candidate pools, whose size the pool limit bounds.
    """
    w = W.partitionBy(*partition)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(high - low < 1e-9, F.lit(1.0)).otherwise((F.col(column) - low) / (high - low)))


def min_support(df: DataFrame, key: str, m: int, where: Column | None = None) -> DataFrame:
    """Keys with at least ``m`` rows (rows that satisfy ``where``), with their count."""
    rows = df if where is None else df.filter(where)
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(F.col("n_rows") >= m)


def keep_known(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the key table. The wide side is not shuffled while the keys are small."""
    return df.join(small_side(keys.select(on)), on, "left_semi")


def exclude(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows that have no match in ``seen``."""
    return df.join(seen.select(*on), on, "left_anti")


def catalogue_list(items: DataFrame, limit: int | None = None, item: str = "item") -> DataFrame:
    """Item names in order; with ``limit``, the first few of them."""
    ordered = items.select(item).distinct().orderBy(item)
    return ordered.limit(limit) if limit is not None else ordered


def unliked(items: DataFrame, favourites: DataFrame) -> DataFrame:
    """The catalogue minus the favourites given (of one account, or of all of them)."""
    return items.select("item").distinct().join(favourites.select("item"), "item", "left_anti")
