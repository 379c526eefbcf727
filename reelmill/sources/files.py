"""Review parts, title catalogue and CSV exports."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.session import scratch_path, store
from reelmill.sources.records import record_lines

PART_NAME = "part-*.json"
HEAD = 64 << 10
LONGEST_HEAD = 16 << 20
LAYOUTS = ("lines", "array", "dict", "object")
HEAD_READERS = 32

CATALOGUE_COLUMNS = ("tconst", "titleType", "primaryTitle", "originalTitle", "startYear")


def _part_files(spark: SparkSession, folder: str) -> list[str]:
    """Sorted paths of the parts, on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/" + PART_NAME)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern)
    return sorted(str(s.getPath().toString()) for s in found) if found else []


def _head(spark: SparkSession, path: str, size: int = HEAD) -> tuple[str, bool]:
    """The first bytes of a file, and whether that is all of it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        found = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(
            jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)
        ))
        return found.decode("utf-8", errors="ignore"), len(found) < size
    finally:
        stream.close()


def _parsed(text: str):
    """The JSON value of a text, or ``None`` if it is not one whole value."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def _is_dict(value) -> bool:
    return isinstance(value, dict) and bool(value) and all(isinstance(v, dict) for v in value.values())


def _top_values(text: str) -> list:
    """The complete values of a JSON object whose text may be cut off."""
    read, found, at = json.JSONDecoder().raw_decode, [], 1
    skip = re.compile(r"[\s,:]*").match
    try:
        while True:
            _, at = read(text, skip(text, at).end())
            value, at = read(text, skip(text, at).end())
            found.append(value)
    except ValueError:
        return found


def layout_of(head: str, whole: bool = False) -> str:
    """``lines``, ``array``, ``dict`` (objects under keys) or ``object`` (one, over several lines).

    ``whole``: the head is the whole file. JSON lines come first: a first line that is an object of
    its own, with another line after it, makes the file one of lines, whatever its fields hold. A
    head that leaves it open raises. One object that goes on beyond the head is a dict if the head
    holds two or more of its values and all of them are objects.
    """
    text = head.lstrip("\ufeff \t\r\n")
    if not text and whole:
        return "lines"
    if text.startswith("["):
        return "array"
    first, newline, rest = text.partition("\n")
    value = _parsed(first.strip())
    if isinstance(value, dict) and (rest.strip() or (newline and not whole)):
        return "lines"
    if whole:
        value = _parsed(text)
        if isinstance(value, dict):
            return "dict" if _is_dict(value) else "object" if "\n" in text.strip() else "lines"
    elif text.startswith("{") and value is None:
        values = _top_values(text)
        if len(values) > 1 and all(isinstance(v, dict) for v in values):
            return "dict"
    raise ValueError("the layout cannot be told from the first bytes; pass layout=, one of " + ", ".join(LAYOUTS))


def _layout_of_file(spark: SparkSession, path: str) -> str:
    """The layout by the file's head, which is read on while an object's first line goes on beyond it.

    A first line of over ``LONGEST_HEAD`` bytes counts as a dict if it begins like one; the reader of
    dicts raises if what follows shows that it is none.
    """
    size = HEAD
    head, whole = _head(spark, path, size)
    while not whole and size < LONGEST_HEAD and "\n" not in (start := head.lstrip("\ufeff \t\r\n")) and start[:1] in ("{", ""):
        size *= 16
        head, whole = _head(spark, path, size)
    try:
        return layout_of(head, whole)
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from None


def _as_lines(spark: SparkSession, paths: list[str], layout: str, on_broken: str) -> str:
    """A scratch folder with the records of arrays or dicts, one a line."""
    out = scratch_path(spark, "lines")
    record_lines(spark, paths, layout, on_broken).write.text(out)
    return out


def _read_dicts(spark: SparkSession, lines: str) -> DataFrame:
    """Inner objects of dicts, one a line, with all their fields as text.

    Field names are put in lower case; of names that differ in case only, the first with a value counts.
    """
    strict, texts = {"mode": "FAILFAST"}, T.MapType(T.StringType(), T.StringType())
    rows = spark.read.text(lines).select(F.from_json("value", texts, strict).alias("m"))
    names: dict[str, list[str]] = {}
    for r in rows.select(F.explode(F.map_keys("m")).alias("n")).distinct().orderBy("n").collect():  # one row per field
        names.setdefault(r["n"].lower(), []).append(r["n"])
    return rows.select(*[F.coalesce(*[F.col("m")[n] for n in same]).alias(low) for low, same in names.items()])


def read_reviews(
    spark: SparkSession, folder: str, layout: str | None = None, schema: T.StructType | None = None, on_broken: str = "fail"
) -> DataFrame:
    """All ``part-*.json`` files of a folder as one table.

    Each file may hold JSON lines, an array, or an object of objects. The layout is taken from the
    first bytes of each file unless given; where they leave it open, an error names the file. With a
    ``schema`` no inference pass is made over the data, which is how large folders should be read.
    Text that is not JSON raises; ``on_broken="skip"`` leaves such rows out instead.

    Every file is read by many tasks: lines as they are, arrays and objects of objects after
    ``record_lines`` has cut them into lines in the scratch folder. One object over several lines
    (``object``) is one row and one task.
    """
    files = _part_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no {PART_NAME} in {folder}")
    if layout is not None and layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    groups: dict[str, list[str]] = {}
    if layout is not None:
        groups[layout] = files
    else:
        with ThreadPoolExecutor(HEAD_READERS) as heads:
            for path, kind in zip(files, heads.map(lambda f: _layout_of_file(spark, f), files)):
                groups.setdefault(kind, []).append(path)
    reader = spark.read.option("primitivesAsString", "true").option("encoding", "UTF-8")
    reader = reader.option("mode", "DROPMALFORMED" if on_broken == "skip" else "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    parts = []
    for kind, paths in groups.items():
        if kind == "dict":
            parts.append(_read_dicts(spark, _as_lines(spark, paths, kind, on_broken)))
        elif kind == "array":
            parts.append(reader.json(_as_lines(spark, paths, kind, on_broken)))
        else:
            parts.append(reader.option("multiLine", str(kind == "object").lower()).json(paths))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rewrite_as_lines(spark: SparkSession, folder: str, out: str, layout: str | None = None) -> None:
    """Copy the parts of a folder as JSON lines, which later reads can split."""
    rows = read_reviews(spark, folder, layout)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(out)


def with_review_ids(df: DataFrame) -> DataFrame:
    """Give every row an id and store the table, so that the ids stay what they are.

    Ids come from scan partition and position; written once, no later plan or retry changes them.
    """
    if "review_id" in df.columns:
        return df
    return store(df.withColumn("review_id", F.monotonically_increasing_id()), "reviews")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The five title columns of a tab-separated catalogue; ``\\N`` and nothing are null."""
    header = spark.read.option("sep", "\t").option("header", "true").option("quote", "")
    names = header.csv(path).columns
    missing = [c for c in CATALOGUE_COLUMNS if c not in names]
    if missing:
        raise KeyError(f"missing catalogue columns {missing}; found {names}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return header.schema(schema).option("nullValue", "\\N").csv(path).select(*CATALOGUE_COLUMNS)


EXPORT_COLUMNS = ("review", "clean_text", "rating", "label", "spoiler_tag", "item", "user")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Export as CSV with a header; by default the cleaned-review columns that exist."""
    chosen = columns if columns is not None else [c for c in EXPORT_COLUMNS if c in df.columns]
    df.select(*chosen).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
