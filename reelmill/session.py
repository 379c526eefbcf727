"""Session set-up, lineage cuts and measured broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATIC_BROADCAST_BYTES = 8 << 20
MEASURED_BROADCAST_BYTES = 128 << 20


def local_session(app: str = "reelmill", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks. Cluster runs bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="reelmill-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` stored and read back: later steps neither compute it again nor read columns they do not use."""
    return store(df, "cut")


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder for stored stages, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder; every call gives another one."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that a file of a narrow table holds at least, where the caller knows how many there are.
FILE_ROWS = 100_000


def store(df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint of row objects, later reads prune columns and push filters down. Lost
    executors re-read the files. ``drop_scratch`` removes them when the results are written.
    ``rows``, if the caller knows a bound, keeps a narrow table from being many tiny files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(8 + rows // FILE_ROWS)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all stored stages of this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*stages: DataFrame) -> None:
    """Delete stages that ``store`` gave and that nothing reads any more."""
    for df in stages:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            if path.getParent().getName() != f"stages-{df.sparkSession.sparkContext.applicationId}":
                raise ValueError(f"{path} is no stored stage")
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """In here a stage's shuffle files are deleted once it is stored, not when the driver's JVM happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


SPREAD_BYTES = 128 << 20
MOST_PARTITIONS = 100_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of all files that a plan reads; other inputs have estimates only and count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    files = [x for x in found if x.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation")]
    return sum(int(str(x.stats().sizeInBytes())) for x in files)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys, for rows that are about to be expanded.

    The number is fixed, since adaptive coalescing would judge partitions by the few bytes shuffled
    and not by the work they cause. It follows the input, one for each ``SPREAD_BYTES``, and is the
    session's number of shuffle partitions at least.
    """
    return df.repartition(partitions_for(df), *keys)


def partitions_for(df: DataFrame) -> int:
    """Partitions for rows that are about to be expanded."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(input_bytes(df) // SPREAD_BYTES + 1, MOST_PARTITIONS))


def static_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of a stored key table, from one narrow scan."""
    width = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif kind == "array":
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * 8 + 24
        else:
            width = width + 8
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"])


def small_side(df: DataFrame, limit: int = MEASURED_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for ``df`` only if its size is within ``limit``.

    Plans the optimizer already knows to be small go without a job. Anything else is stored once and
    measured there; beyond the limit it comes back without a hint, and the join is left to shuffle
    with adaptive skew handling.
    """
    if static_bytes(df) <= STATIC_BROADCAST_BYTES:
        return F.broadcast(df)
    return stored_side(store(df, "side"), limit)


def stored_side(df: DataFrame, limit: int = MEASURED_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a table that is already stored, if it is measured to be within ``limit``."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A sub-folder next to the checkpoints, for tables shared by executors."""
    return os.path.join(checkpoint_dir(spark), name)
