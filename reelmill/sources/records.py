"""Arrays and objects of objects as JSON lines, cut by many tasks from one file.

Spark's text reader splits a file at ``}``, so every task gets the fragments that begin in its byte
range, on any file system. A first pass adds up each range: quotation marks, and the change of depth
if the range begins outside a string and if it begins inside one. Sums over the ranges before it then
tell how each range really begins. The second pass walks through the fragments again and cuts where
the depth falls back to one. What lies before a range's first cut and after its last one is joined
with the neighbours'; only these edges are shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.session import MEASURED_BROADCAST_BYTES, measured_bytes, store

ESCAPE = re.compile(rb"\\.", re.DOTALL)
PIECES = 2_000  # rows of one batch on their way back

RANGES = "path string, start long, fragments long, bytes long, quotes long, outside long, inside long, size long"
CUTS = "path string, start long, place int, kind string, text binary"

#: A record with what stands before it, by layout, and what may be left behind the last one.
OPENING = {"array": r"^\x{FEFF}?\s*[\[,]\s*", "dict": r'^\x{FEFF}?\s*[{,]\s*"(?:[^"\\]++|\\.)*+"\s*:\s*'}
CLOSING = {"array": r"^(\x{FEFF}?\s*\[)?\s*\]\s*$", "dict": r"^(\x{FEFF}?\s*\{)?\s*\}\s*$"}


def tally(fragment: bytes) -> tuple[int, int, int]:
    """Quotation marks, and the brackets left open in every other part between them, from the first or the second."""
    parts = (ESCAPE.sub(b"", fragment) if b"\\" in fragment else fragment).split(b'"')
    even, odd = b"".join(parts[::2]), b"".join(parts[1::2])
    return len(parts) - 1, *(p.count(b"{") + p.count(b"[") - p.count(b"]") for p in (even, odd))


def _fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    place = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "path"), ("file_block_start", "start"), ("file_size", "size"))]
    return spark.read.option("lineSep", "}").text(paths).select(*place, F.col("value").cast("binary").alias("value"))


def _by_range(frames):
    """(path, start, size, fragments) of runs of rows from one range."""
    for pdf in frames:
        key = pdf["path"] + pdf["start"].astype(str)
        for _, run in pdf.groupby(key.ne(key.shift()).cumsum(), sort=False):
            yield run["path"].iloc[0], int(run["start"].iloc[0]), run


def add_up(frames):
    """One row per range: how it changes the state, for both states that it may begin in."""
    now, row = None, None
    for path, start, run in _by_range(frames):
        if (path, start) != now:
            if row is not None:
                yield pd.DataFrame([row], columns=_names(RANGES))
            now, row = (path, start), [path, start, 0, 0, 0, 0, 0, int(run["size"].iloc[0])]
        for fragment in run["value"]:
            quotes, even, odd = tally(fragment)
            within = row[4] % 2  # whether a string is open here if none was at the range's start
            row[5] += odd if within else even
            row[6] += even if within else odd
            row[2], row[3], row[4] = row[2] + 1, row[3] + len(fragment), row[4] + quotes
            row[5 if row[4] % 2 == 0 else 6] -= 1
    if row is not None:
        yield pd.DataFrame([row], columns=_names(RANGES))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def begin(ranges: DataFrame) -> DataFrame:
    """Per range whether it begins inside a string, its depth there, and ``open_end``: its last fragment has no ``}``.

    Every fragment but a file's last is known to end in one; the file's size tells about the last.
    A byte order mark may be missing from the bytes read.
    """
    ahead = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    within = ranges.withColumn("within", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2)
    change = F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))
    depth = within.withColumn("depth", F.coalesce(F.sum(change).over(ahead), F.lit(0)))
    file = W.partitionBy("path")
    marks = F.col("size") - F.sum("bytes").over(file) - F.sum("fragments").over(file)
    last = F.col("start") == F.max("start").over(file)
    return depth.select("path", "start", "fragments", "within", "depth", (last & (F.pmod(marks, F.lit(3)) == 2)).alias("open_end"))


def cut(frames):
    """Pieces up to and with a record's end: the range's first as ``head``, then ``whole`` ones, what is left as ``tail``.

    A range in which no record ends is one ``head``.
    """
    now, out = None, []
    quotes = depth = left = 0
    parts: list[bytes] = []
    kind, open_end = "head", False
    for path, start, run in _by_range(frames):
        if (path, start) != now:
            first = run.iloc[0]
            if pd.isna(first["depth"]):
                raise ValueError(f"{path} was split in another way while it was read; read it again")
            now, kind, parts = (path, start), "head", []
            quotes, depth, left, open_end = int(first["within"]), int(first["depth"]), int(first["fragments"]), bool(first["open_end"])
        for fragment in run["value"]:
            marks, even, odd = tally(fragment)
            depth += odd if quotes % 2 else even
            quotes, left = quotes + marks, left - 1
            parts.append(fragment)
            if left or not open_end:
                parts.append(b"}")
                if quotes % 2 == 0:
                    depth -= 1
                    if depth == 1:
                        out.append((path, start, int(kind != "head"), kind, b"".join(parts)))
                        kind, parts = "whole", []
            if left == 0:
                rest = "head" if kind == "head" else "tail"
                out.append((path, start, 2 * (rest == "tail"), rest, b"".join(parts)))
            if len(out) >= PIECES:
                yield pd.DataFrame(out, columns=_names(CUTS))
                out = []
    if out:
        yield pd.DataFrame(out, columns=_names(CUTS))


def record_lines(spark: SparkSession, paths: list[str], layout: str, on_broken: str = "fail") -> DataFrame:
    """(value): every element of arrays (``array``) or every inner object (``dict``) as one line of JSON.

    Elements that are no objects, and files that do not end with their array or object, raise;
    ``on_broken="skip"`` leaves out what cannot be read. A record may be longer than a range; a task
    holds one record at a time and, of the ranges, counts only. Of a file, only the edges of its
    ranges, two records each, are put in order in one place, and that with spilling.
    """
    found = _fragments(spark, paths)
    starts = store(begin(store(found.mapInPandas(add_up, RANGES), "ranges")), "starts")
    if measured_bytes(starts) <= MEASURED_BROADCAST_BYTES:
        placed = found.join(F.broadcast(starts), ["path", "start"], "left")  # fragments stay in their order
    else:
        placed = found.withColumn("at", F.monotonically_increasing_id()).join(starts, ["path", "start"], "left")
        placed = placed.repartition("path", "start").sortWithinPartitions("path", "start", "at")
    pieces = store(placed.mapInPandas(cut, CUTS), "pieces")
    edges = pieces.filter("kind != 'whole'")
    order = W.partitionBy("path").orderBy("start", "place")
    edges = edges.withColumn("owner", F.count_if(F.col("kind") == "tail").over(order))
    edges = edges.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts"))
    joined = F.concat_ws("", F.transform("parts", lambda p: p["text"].cast("string")))
    last = F.col("owner") == F.max("owner").over(W.partitionBy("path"))
    whole = pieces.filter("kind = 'whole'").select(F.col("text").cast("string").alias("value"), F.lit(False).alias("last"))
    rows = whole.unionByName(edges.select(joined.alias("value"), last.alias("last")))
    rows = rows.filter(~(F.col("last") & F.col("value").rlike(CLOSING[layout])))
    body = F.regexp_replace(F.regexp_replace("value", OPENING[layout], ""), r"[\r\n]", " ")
    right = F.col("value").rlike(OPENING[layout]) & body.startswith("{") & ~F.col("last")
    if on_broken == "skip":
        return rows.filter(right).select(body.alias("value"))
    fault = F.raise_error(F.concat(F.lit(f"malformed record in a file of layout {layout}: "), F.substring("value", 1, 200)))
    return rows.select(F.when(right, body).otherwise(fault).alias("value"))
