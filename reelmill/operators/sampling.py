"""Exact, repeatable sampling: every draw is a cut through the order of a seeded hash.

Rows are ordered by md5(seed || '-' || key) within their stratum. To cut that order at a given rank
no global sort is needed: a histogram over hash prefixes shows which prefix holds the rank, and only
the rows with that prefix (one in 65,536) are ranked to find the exact threshold. The rows
themselves, texts included, are then only compared with the threshold and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.session import cut_lineage


def hash_key(key: str | Column, seed: int | str) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-"), column.cast("string")))


def _prefix(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def assign_segments(df: DataFrame, key: str, cuts: DataFrame, stratum: str, seed: int | str) -> DataFrame:
    """Add ``segment``: how many of the stratum's cuts a row lies beyond.

    ``key`` must be unique. ``cuts`` has one row per stratum with an ascending ``cuts`` array of
    ranks: a row of rank r (from 1) is beyond cut c if r > c. Strata are classes, so their number
    is small by contract and the threshold table (strata x cuts rows) is broadcast.
    """
    rows = df.select(F.col(stratum).alias("_s"), F.col(key).alias("_k")).withColumn("_h", hash_key("_k", seed))
    rows = rows.withColumn("_p", _prefix(F.col("_h")))
    wanted = cuts.select(F.col(stratum).alias("_s"), F.posexplode("cuts").alias("_i", "_c"))

    counts = rows.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("_s").orderBy("_p"))  # at most 65,536 rows a stratum
    counts = counts.withColumn("_upto", upto)
    border = (
        counts.join(F.broadcast(wanted), "_s")
        .filter((F.col("_c") > F.col("_upto") - F.col("_n")) & (F.col("_c") <= F.col("_upto")))
        .select("_s", "_p", "_i", (F.col("_c") - F.col("_upto") + F.col("_n")).alias("_within"))
    )
    place = F.row_number().over(W.partitionBy("_s", "_p", "_i").orderBy("_h", "_k"))
    reached = (
        rows.join(F.broadcast(border), ["_s", "_p"])
        .withColumn("_r", place)
        .filter("_r = _within")
        .select("_s", F.struct("_h", "_k").alias("_t"))
    )
    # A cut at rank 0 lies before every row: no hash is smaller than the empty string.
    k_type = df.schema[key].dataType
    before_all = wanted.filter("_c <= 0").select(
        "_s", F.struct(F.lit("").alias("_h"), F.lit(None).cast(k_type).alias("_k")).alias("_t")
    )
    thresholds = reached.unionByName(before_all).groupBy("_s").agg(F.collect_list("_t").alias("_ts"))
    # stored, being a few rows: draws on top of draws then stay one comparison each, and a retry
    # cuts where the first run did
    thresholds = cut_lineage(thresholds)
    here = F.struct(hash_key(key, seed).alias("_h"), F.col(key).alias("_k"))
    return (
        df.join(F.broadcast(thresholds), F.col(stratum) == F.col("_s"), "left")
        .withColumn("_here", here)
        .withColumn("segment", F.coalesce(F.size(F.filter("_ts", lambda t: t < F.col("_here"))), F.lit(0)))
        .drop("_s", "_ts", "_here")
    )


def sample_keys(df: DataFrame, key: str, n: int | None, seed: int | str = 42) -> DataFrame:
    """``n`` keys in hash order, all of them for ``None``. One row per key is expected."""
    if n is None:
        return df
    spark = df.sparkSession
    # the one stratum is computed, not a literal: a literal key would be folded out of the joins
    # and leave them without an equality
    whole = df.withColumn("_all", F.pmod(F.xxhash64(key), F.lit(1).cast("long")))
    cuts = spark.range(1).select(F.col("id").alias("_all"), F.array(F.lit(n).cast("long")).alias("cuts"))
    return assign_segments(whole, key, cuts, "_all", seed).filter("segment = 0").drop("segment", "_all")


def balance(
    df: DataFrame,
    key: str = "review_id",
    rating: str = "rating",
    ratio: float = 1.5,
    cap: int | None = None,
    seed: int = 42,
    positive_from: float = 7,
    negative_to: float = 4,
) -> DataFrame:
    """At most ``ratio`` good rows per bad one, no neutral rows, at most ``cap`` rows in all."""
    good, bad = F.col(rating) >= positive_from, F.col(rating) <= negative_to
    rows = df.filter(good | bad).withColumn("_good", F.when(good, 1).otherwise(0))
    cuts = rows.agg(F.count_if(F.col("_good") == 1).alias("p"), F.count_if(F.col("_good") == 0).alias("n")).select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("_good"), F.array(F.floor(F.col("n") * F.lit(float(ratio)))).alias("cuts")),
                F.struct(F.lit(0).alias("_good"), F.array(F.col("n")).alias("cuts")),
            )
        ).alias("c")
    ).select("c.*")
    kept = assign_segments(rows, key, cuts, "_good", seed).filter("segment = 0").drop("segment", "_good")
    # A second seed: by the first one the good rows kept all hash low and would crowd out the bad.
    return kept if cap is None else sample_keys(kept, key, cap, f"cap-{seed}")


def oversample(df: DataFrame, key: str, label: str = "label", ratio: float = 1.5, seed: int = 42) -> DataFrame:
    """Repeat negatives until there are floor(positives / ratio), if more than ``ratio`` to one.

    Every row stays once; the extra copies go round the hash order. ``copy`` numbers them.
    """
    n = df.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    extra = F.when(
        (F.col("p") / F.greatest(F.col("n"), F.lit(1)) > ratio) & (F.col("n") > 0),
        F.floor(F.col("p") * F.lit(1.0 / ratio)) - F.col("n"),
    ).otherwise(F.lit(0).cast("long"))
    plan = n.select(
        F.lit(0).cast(df.schema[label].dataType).alias(label),
        extra.alias("extra"),
        F.greatest("n", F.lit(1)).alias("n"),
    ).select(label, F.floor(F.col("extra") / F.col("n")).alias("_rounds"), F.array(F.col("extra") % F.col("n")).alias("cuts"))
    cut = assign_segments(df, key, plan.select(label, "cuts"), label, seed)
    copies = cut.join(F.broadcast(plan.select(label, "_rounds")), label, "left")
    last = F.when(F.col("_rounds").isNull(), F.lit(0)).otherwise(
        F.col("_rounds") + F.when(F.col("segment") == 0, 1).otherwise(0)
    )
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(0), last.cast("int")))).drop("_rounds", "segment")


def stratified_split(
    df: DataFrame, key: str, label: str = "label", fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: ceil(fraction * n) rows, shared among the classes by largest remainder."""
    by_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()  # over one row per class
    total = F.sum("n").over(everything)
    n_train = total - F.ceil(total * F.lit(fraction))
    share = F.col("n") * n_train / total
    plan = by_class.withColumn("whole", F.floor(share)).withColumn("part", share - F.floor(share)).withColumn("t", n_train)
    spare = F.col("t") - F.sum("whole").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("part"), F.asc(label)))
    plan = plan.withColumn("train", F.col("whole") + F.when(place <= spare, 1).otherwise(0))
    cuts = plan.select(label, F.array(F.col("n") - F.col("train")).alias("cuts"))
    return (
        assign_segments(df, key, cuts, label, seed)
        .withColumn("is_test", F.col("segment") == 0)
        .drop("segment")
    )


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = 3, seed: int | str = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1; within each class the fold sizes differ by at most one."""
    by_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    cuts = by_class.select(label, F.array(*[F.floor(F.col("n") * i / k) for i in range(1, k)]).alias("cuts"))
    return assign_segments(df, key, cuts, label, seed).withColumnRenamed("segment", "fold")


def dense_ids(df: DataFrame, column: str, out: str = "dense_id") -> DataFrame:
    """Number the distinct values from 0 without gaps, in the order of their hash.

    Hash prefixes are even whatever the values look like, so no task gets more than its share; the
    prefix offsets are a table of at most 65,536 rows.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    values = values.withColumn("_h", F.md5(F.col(column).cast("string"))).withColumn("_p", _prefix(F.col("_h")))
    counts = values.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(W.partitionBy().orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_p").orderBy("_h", column))
    return (
        values.withColumn("_r", place)
        .join(F.broadcast(offsets), "_p")
        .select(column, (F.col("_before") + F.col("_r") - 1).alias(out))
    )
