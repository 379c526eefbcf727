"""User feedback folded into per-user state, as a batch job and as a stream."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LIKE, UNLIKE, RATE, DELETE = "like", "unlike", "rate", "delete"
FIELDS = {
    # field: (actions that set it, its value per action)
    "favorite": (LIKE, UNLIKE, RATE, DELETE),
    "rating": (RATE, DELETE),
    "review": (RATE, DELETE),
}


def _latest(actions: tuple[str, ...], value: Column) -> Column:
    """Value of the last event of these actions. Wrapped, so that a deleting null can win."""
    order = F.when(F.col("action").isin(*actions), F.struct("ts", "event_id"))
    return F.max_by(F.struct(value.alias("v")), order)


def _fold(events: DataFrame) -> DataFrame:
    rate = F.col("action") == RATE
    return (
        events.filter(F.col("action").isin(LIKE, UNLIKE, RATE, DELETE))
        .groupBy("user", "item")
        .agg(
            _latest(FIELDS["favorite"], F.col("action").isin(LIKE, RATE)).alias("f"),
            _latest(FIELDS["rating"], F.when(rate, F.col("rating"))).alias("r"),
            _latest(FIELDS["review"], F.when(rate, F.col("review"))).alias("t"),
        )
        .select("user", "item", F.col("f.v").alias("favorite"), F.col("r.v").alias("rating"), F.col("t.v").alias("review"))
    )


def fold_feedback(events: DataFrame) -> DataFrame:
    """(user, item, favorite, rating, review) after all events (event_id, ts, user, item, action, rating, review).

    A rating implies a like; deleting it also clears review and like; an unlike leaves the rating.
    Each field takes its last event by (ts, event_id), so the order of arrival does not matter.
    """
    return _fold(events)


def favourites(state: DataFrame) -> DataFrame:
    """(user, item, rating) of what users like."""
    return state.filter("favorite").select("user", "item", "rating")


def user_summary(state: DataFrame) -> DataFrame:
    """(user, n_favorites, n_ratings, mean_rating, n_reviews)."""
    return state.groupBy("user").agg(
        F.count_if("favorite").alias("n_favorites"),
        F.count("rating").alias("n_ratings"),
        F.avg("rating").alias("mean_rating"),
        F.count_if(F.coalesce(F.col("review"), F.lit("")) != "").alias("n_reviews"),
    )


def nested_state(state: DataFrame, part_size: int = 10_000) -> DataFrame:
    """(user, part, favorites, ratings, reviews) as lists and maps.

    A user with very many items gets several rows in place of one without bound.
    """
    sizes = state.groupBy("user").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(float(part_size)))
    rows = state.join(sizes, "user").withColumn("part", F.pmod(F.xxhash64("item"), parts).cast("int"))

    def pairs(column: str) -> Column:
        listed = F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col("item").cast("string"), column)))
        return F.map_from_entries(F.array_sort(listed))

    return rows.groupBy("user", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("favorite"), F.col("item")))).alias("favorites"),
        pairs("rating").alias("ratings"),
        pairs("review").alias("reviews"),
    )


#: State is kept on the executors' disks, not in their heap; of each batch only its changes go to the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """What starts inside has these settings; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SNAPSHOTS = "_snapshots"  # hidden from readers of the change log


def stream_feedback(
    events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, compact_every: int | None = 100
) -> StreamingQuery:
    """Run the fold on a stream of events and write the keys each batch has changed.

    State is one row per (user, item) and is the product itself, so there is no watermark: a late
    event loses against newer ones by its time. A replayed batch overwrites its own partition.
    ``trigger`` is what the writer's ``trigger`` takes; by default all that is there is drained.
    Every ``compact_every`` batches the log is folded into a snapshot. State of all keys stays for good, so
    it lies in RocksDB; a checkpoint that was begun with another store goes on with that one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, out, batch_id)

    with _settings(events.sparkSession, STATE_STORE):
        return (
            _fold(events).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers in the names of sub-folders ``prefix=number``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{prefix}="))


def _finished(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Those of ``_numbers`` that were written to their end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for n in _numbers(spark, folder, prefix) if fs.exists(hadoop.Path(f"{folder}/{prefix}={n}/_SUCCESS"))]


def compact(spark: SparkSession, out: str, upto: int) -> None:
    """Write the state after batch ``upto`` as a snapshot, then drop what it makes superfluous."""
    snapshots = os.path.join(out, SNAPSHOTS)
    stream_state(spark, out, upto).write.mode("overwrite").parquet(os.path.join(snapshots, f"upto={upto}"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in _numbers(spark, out, "batch_id"):
        if n <= upto:
            fs.delete(hadoop.Path(out, f"batch_id={n}"), True)
    for n in _numbers(spark, snapshots, "upto"):
        if n < upto:
            fs.delete(hadoop.Path(snapshots, f"upto={n}"), True)


def stream_state(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """Current state, or that after batch ``upto``: for each key the row of the last batch that changed it.

    Batches up to the last finished snapshot are in it; one that is replayed after that is not read.
    """
    snapshots = os.path.join(out, SNAPSHOTS)
    last = max((n for n in _finished(spark, snapshots, "upto") if upto is None or n <= upto), default=None)
    parts = []
    if last is not None:
        parts.append(spark.read.parquet(os.path.join(snapshots, f"upto={last}")).withColumn("batch_id", F.lit(last)))
    for n in _numbers(spark, out, "batch_id"):
        if (last is None or n > last) and (upto is None or n <= upto):
            parts.append(spark.read.parquet(os.path.join(out, f"batch_id={n}")).withColumn("batch_id", F.lit(n)))
    if not parts:
        raise FileNotFoundError(f"no state in {out}")
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    row = F.max_by(F.struct("favorite", "rating", "review"), F.col("batch_id"))
    return changes.groupBy("user", "item").agg(row.alias("s")).select("user", "item", "s.*")
