"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes sets boundaries where its value meets the block size; each
chunk between boundaries gives one letter of the signature. The block size is the least of 3 * 2^k
at which the text gives at most 64 letters, made smaller again while there are fewer than 32. A
fingerprint is ``size:signature:signature at twice the size``, so that texts whose sizes differ by
one step can be compared. Likeness is one minus the edit distance (insertions and deletions) of the
signatures at a common size, over their joint length; signatures without a common run of letters
are unlike, and so are fingerprints without a common size.

Texts are hashed as bytes in numpy, whole batches at a time.

Documents are dealt into ranges of doc_id; each range also gets the first document of the next one, so
every document sees its successor in the same task. Doc_ids and sizes are looked at to set the
ranges; rows without a doc_id, or of one that many rows share, are dealt into ranges of their hash.

Defined results: a null text is empty; the empty text has the fingerprint ``3::``, like any text with
the same fingerprint with likeness 1; rows with the same doc_id are ordered by their text, null ids
come first; the only row of a table follows itself; other columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from reelmill.llm.batches import text_slices, texts

LEAST = 3
LETTERS = 64
WINDOW = 7
#: Letters that two signatures must have in a row to be compared; shorter signatures: half of them.
COMMON = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Odd, so that it has an inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Piecewise:
    """Fingerprints of byte strings; keeps powers for the chunk hashes."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(1 << 16, 1 << n.bit_length())
            for name, factor in (("up", FACTOR), ("down", INVERSE)):
                steps = np.full(size + 1, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def fingerprint(self, text: bytes) -> str:
        n = len(text)
        if not n:
            return f"{LEAST}::"
        self._powers(n)
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        rolled = roll(data)
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64)
        step = 0
        while LEAST * LETTERS << step < n:
            step += 1
        # Boundaries at a size are boundaries at half the size too.
        least = max(0, step - 8)
        spots = np.flatnonzero((rolled + np.uint32(1)) & np.uint32((1 << least) - 1) == 0)
        values = rolled[spots].astype(np.uint64) + np.uint64(1)
        odd = values % np.uint64(3) == 0
        spots, values = spots[odd], values[odd]

        def boundaries(k: int) -> np.ndarray:
            at = spots[values & np.uint64((1 << k) - 1) == 0]
            return at if len(at) and at[-1] == n - 1 else np.append(at, n - 1)

        while step > least and len(boundaries(step)) < LETTERS // 2:
            step -= 1
        return f"{LEAST << step}:{self._letters(sums, boundaries(step))}:{self._letters(sums, boundaries(step + 1))}"

    def _letters(self, sums: np.ndarray, ends: np.ndarray) -> str:
        if len(ends) > LETTERS:
            ends = np.append(ends[: LETTERS - 1], ends[-1])  # the last letter takes the rest
        upto = sums[ends]
        chunk = upto - np.append(np.zeros(1, np.uint64), upto[:-1])
        starts = np.append(0, ends[:-1] + 1)
        chunk *= self.down[starts]
        chunk = (chunk ^ (chunk >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ALPHABET[(chunk >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def roll(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted bytes of the last seven."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data])
    n = len(data)
    total, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for age in range(WINDOW):
        part = padded[WINDOW - 1 - age : WINDOW - 1 - age + n]
        total += part
        weighted += part * np.uint32(WINDOW - age)
        mixed ^= part << np.uint32(5 * age)
    return total + weighted + mixed


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one step per letter of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 minus the edit distance of two signatures over their joint length."""
    if a == b:
        return 1.0
    run = min(COMMON, max(1, min(len(a), len(b)) // 2))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """Likeness of two fingerprints, 0 to 1, by the signatures at sizes that both have."""
    if one == two:
        return 1.0
    size, a, a2 = one.split(":")
    other, b, b2 = two.split(":")
    size, other = int(size), int(other)
    pairs = []
    if size == other:
        pairs = [(a, b), (a2, b2)]
    elif size == 2 * other:
        pairs = [(a, b2)]
    elif other == 2 * size:
        pairs = [(a2, b)]
    pairs = [(x, y) for x, y in pairs if x and y]
    # The finer signature decides; the coarser one is for different sizes only.
    return signature_likeness(*pairs[0]) if pairs else 0.0


#: Bytes of text in a range, about; more ranges are made if the session asks for more partitions.
RANGE_BYTES = 64 << 20


def hash_part(parts) -> Column:
    """Parts 0 to ``parts`` - 1 in the order of the hash."""
    share = F.col("hash").cast("double") / 2.0**64 + 0.5
    return F.least(F.floor(share * parts), parts - 1).cast("int")


def with_successors(docs: DataFrame, ranges: int, null_ranges: int = 1) -> DataFrame:
    """doc_id, text, range and borrowed, sorted in each partition: every range ends with its successor's first row.

    Row order is doc_id, then the text's hash. Shuffles each text once, and one more text per range.
    Rows without a doc_id, and those of a whole number that is a quantile several times over, are cut by hash.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("place", F.col("doc_id").cast("double"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    cuts = rows.where("place is not null").stat.approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("range", F.lit(0))
    exact = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    hot = {c: n for c, n in Counter(cuts).items() if n > 1 and exact and abs(c) < 2**53}  # at most one entry per quantile
    step = max(hot.values(), default=0) + 1
    part = F.lit(0)
    if hot:
        # Such an id is the first of its range: its parts come before the range's other ids.
        found = F.create_map(*[F.lit(x) for c, n in hot.items() for x in (c, n)])
        starts = F.create_map(*[F.lit(x) for c, n in hot.items() for x in (float(splits.index(c)), n)])
        part = F.coalesce(hash_part(F.element_at(found, F.col("place"))), F.element_at(starts, F.col("range").cast("double")), F.lit(0))
    number = F.col("range").cast("int") * step + part
    without = hash_part(F.lit(null_ranges)) - null_ranges - 1
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), without).when(F.col("place").isNull(), -1).otherwise(number).cast("int"))
    rows = rows.drop("place")
    ids = rows.groupBy("range").agg(F.min("doc_id").alias("least")).orderBy("range").collect()  # one row per range
    if not ids:
        return rows.withColumn("borrowed", F.lit(False))
    follows = docs.sparkSession.createDataFrame(
        [(r.range, r.least, ids[i - 1].range) for i, r in enumerate(ids)],
        StructType([StructField("r", rows.schema["range"].dataType), StructField("least", docs.schema["doc_id"].dataType), StructField("before", rows.schema["range"].dataType)]),
    )
    first = rows.join(F.broadcast(follows), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("least")))
    first = first.groupBy("before").agg(F.min_by(F.struct("doc_id", "text", "hash"), F.struct("hash", "text")).alias("x"))
    lent = first.select("x.doc_id", "x.text", F.col("before").alias("range"), "x.hash", F.lit(True).alias("borrowed"))
    own = rows.select("doc_id", "text", "range", "hash", F.lit(False).alias("borrowed"))
    return own.unionByName(lent).repartition(len(ids), "range").sortWithinPartitions("range", "borrowed", F.col("doc_id").asc_nulls_first(), "hash", "text")


def fingerprints(docs: DataFrame, ranges: int | None = None, null_ranges: int = 1) -> DataFrame:
    """Fingerprint of every text, of its edited text, and both likenesses.

    The edited text has its last floor(n / 2) characters replaced by the first as many of the next text.
    """
    import hashlib

    if ranges is None:
        length = F.octet_length(F.col("text").cast("string"))
        sizes = docs.groupBy(F.col("doc_id").isNull().alias("without")).agg(F.coalesce(F.sum(length), F.lit(0)).alias("n"))
        size = {r["without"]: r["n"] for r in sizes.collect()}  # two rows at most
        ranges = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size.get(False, 0) // RANGE_BYTES + 1)
        null_ranges = size.get(True, 0) // RANGE_BYTES + 1
    kind = docs.schema["doc_id"].dataType
    schema = StructType([
        StructField("doc_id", kind), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
        StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
        StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
    ])

    def rows_of(batches, make):
        for rows in text_slices(batches):
            columns = (rows.column(c).to_pylist() for c in ("doc_id", "range", "borrowed"))
            for (doc, range_, borrowed), text in zip(zip(*columns), texts(rows.column("text"))):
                yield doc, range_, borrowed, text, make.fingerprint(text.encode())

    def work(batches):
        make, last, out = Piecewise(), None, []
        for row in rows_of(batches, make):
            if last is not None and last[1] == row[1]:
                doc, _, _, text, own = last
                half = len(text) // 2
                edited = (text[: len(text) - half] + row[3][:half]).encode()
                after = make.fingerprint(edited)
                out.append((doc, len(text), hashlib.sha256(edited).hexdigest(), own, after, likeness(own, after), likeness(own, row[4])))
            last = row
            if len(out) >= 2000:
                yield to_batch(out)
                out = []
        if out:
            yield to_batch(out)

    def to_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    return with_successors(docs, ranges, null_ranges).select("doc_id", "text", "range", "borrowed").mapInArrow(work, schema)
