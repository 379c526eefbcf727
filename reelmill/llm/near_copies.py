"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (all words of a shorter text), weighted by their count in the text
times an inverse document frequency. The latter lies between 1 (in every document) and 1 +
``RARITY`` (in a thousandth of them or less): common passages weigh less than a text's own words, and
yet copies stay alike when a large group of them makes their shared words common. Frequencies are counted over all documents in a table of
``COUNTERS`` hashed counters, the only thing that is broadcast; its size does not depend on the data,
and what shares a counter by chance is the same share of the documents at every size.

Texts with equal weighted shingles are one class from the start. For each class, consistent weighted
samples form bands. Every band is the root of a tree: its bucket is split by the band that follows, and
each part by the next one, ``DEPTH`` levels in all. Every member is compared with one leader of its smallest
parts; what that joins is one class from then on. Members of a part that are in different classes are compared with its leader,
the one whose band values are the most popular, and with their neighbours in the order of the bands
that follow, where the most alike lie next to each other. Small buckets are compared in full that way. So a
bucket of g members costs in proportion to g, however many of its pairs are alike; leaders come
from sums and are joined by key, and neighbours from a sort by ranges, so no bucket is one task's work.

What was found forms components. A bucket that still holds several goes on with one representative of
each: they are compared with the first of them and with their neighbours in the order of other bands. That is
repeated while it joins anything, at most as often as the largest bucket can be halved.

Then every pair of texts in different components that can be alike is verified, whether it shares a band or
not, so that no link between classes is lost. A text's prefix are its rarest shingles, up to where the weight of
the others falls below ``SIMILARITY`` of the whole; texts that are as alike as that share a shingle of both
prefixes, and what both weigh from the first of these on is enough for it. Shingles whose texts are all in one
component make no pairs, and a shingle of many texts is split between tasks. ``exact=False`` leaves this out.

Defined results: a null or empty text equals other empty ones; texts without any word are alike only
if they are the same bytes; rows that share a doc_id are one document; rows without a doc_id have the
class of the least document with the same words, or none; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from reelmill.llm.batches import arrow_rows, buffer, other_name, text_slices
from reelmill.llm.components import components
from reelmill.llm.words import Powers, mix, windows, word_hashes
from reelmill.session import shuffles_dropped, small_side, store

WORDS = 5
SIMILARITY = 0.8
#: A pair at the similarity shares a band with probability 1 - (1 - 0.8 ** 4) ** 10, over 0.99.
BANDS, BAND_ROWS = 10, 4
#: Places apart in the order of bands up to which members of a bucket are compared.
NEAR = 5
#: Levels of a band's tree.
DEPTH = 3
RARITY, RARE = 0.1, 1000
COUNTERS = 1 << 20
BLOCK = 1 << 10
#: Texts side by side and their bytes; shingles that are sampled side by side.
ROWS, SLICE, SIDE = 512, 1 << 20, 1 << 16
KEY_BITS = 48
#: For the number of tasks only: pairs to verify for each member of a bucket.
VERIFIED = 4
#: Pairs of a shingle's texts that one task compares by weight.
TOGETHER = 1 << 24
#: For sums in other orders.
SLACK = 1e-9


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal parts."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x


class Shingles:
    """Weighted shingles of a block of texts: 48-bit keys in order in each text, counts, and where each text begins."""

    def __init__(self, column: pa.Array, powers: Powers):
        data, places = buffer(column)
        n = len(places) - 1
        words, before = word_hashes(data, places, powers)
        counts = np.diff(before)
        keys, owner = windows(words, before, WORDS)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):
            whole = [mix(np.asarray([np.bitwise_xor.reduce(mix(words[before[i] : before[i + 1]] + np.arange(1, counts[i] + 1, dtype=np.uint64)))]))[0] for i in short]
            keys, owner = np.concatenate([keys, np.asarray(whole, np.uint64)]), np.concatenate([owner, short])
        both = np.sort((owner.astype(np.uint64) << np.uint64(KEY_BITS)) | (keys >> np.uint64(64 - KEY_BITS)))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.times = np.diff(np.append(first, len(both)))
        both = both[first]
        self.keys = both & np.uint64((1 << KEY_BITS) - 1)
        self.places = np.searchsorted(both >> np.uint64(KEY_BITS), np.arange(n + 1, dtype=np.uint64))
        self.none = np.flatnonzero(counts == 0)
        self.raw = (data, places, powers)

    def names(self) -> np.ndarray:
        """Two numbers for each text that are equal for equal weighted shingles; without words, for equal bytes."""
        n = len(self.places) - 1
        out = np.zeros((n, 2), np.uint64)
        some = np.flatnonzero(np.diff(self.places))
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            if len(some):
                out[some, i] = np.add.reduceat(mix(self.keys ^ np.uint64(salt)) * self.times.astype(np.uint64), self.places[some])
        data, places, powers = self.raw
        for i in self.none:
            text = data[places[i] : places[i + 1]]
            up, _ = powers.upto(max(1, len(text)))
            value = ((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)]).sum(dtype=np.uint64)
            out[i] = mix(np.asarray([value, value ^ np.uint64(len(text) + 7)]))
        return out


class Sampler:
    """Consistent weighted samples, combined into bands."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS):
        self.bands, self.rows = bands, rows
        quantiles = gamma_quantiles()
        self.r, self.log_c = quantiles.astype(np.float32), np.log(quantiles).astype(np.float32)
        self.seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def samples(self, keys: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """One number for each text (none of them empty) and sample; equal with the probability of the similarity."""
        log_w = np.log(weights).astype(np.float32)
        base, starts = mix(keys), places[:-1]
        out = np.empty((len(starts), len(self.seeds)), np.uint64)
        for i, seed in enumerate(self.seeds):
            h = (base ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            parts = h.view(np.uint16).reshape(-1, 4)
            r, log_c = self.r.take(parts[:, 0]), self.log_c.take(parts[:, 1])
            high = (h >> np.uint64(32)).astype(np.uint32)
            b = high.astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(log_w / r + b)
            log_a = log_c - r * (t - b + np.float32(1))
            order = log_a.view(np.int32)
            order = np.where(order < 0, ~order, order ^ np.int32(-(1 << 31))).view(np.uint32)
            mark = high ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[:, i] = np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | mark, starts)
        return out

    def band_values(self, shingles: Shingles, idf: np.ndarray) -> np.ndarray:
        """A number for each text and band; texts without words have zeros."""
        n = len(shingles.places) - 1
        out = np.zeros((n, self.bands), np.uint64)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(shingles.places, shingles.places[first] + SIDE, side="right")) - 1)
            some = first + np.flatnonzero(np.diff(shingles.places[first : last + 1]))
            if len(some):
                lo, hi = shingles.places[first], shingles.places[last]
                keys = shingles.keys[lo:hi]
                weights = shingles.times[lo:hi] * idf[keys & np.uint64(COUNTERS - 1)]
                found = self.samples(keys, weights, np.append(shingles.places[some] - lo, hi - lo))
                value = np.zeros((len(some), self.bands), np.uint64)
                for row in range(self.rows):
                    value = mix(value * np.uint64(31) + found[:, row :: self.rows])
                out[some] = value
            first = last
        return out


def blocks(batches):
    for rows in text_slices(batches, limit=SLICE):
        for first in range(0, rows.num_rows, ROWS):
            yield rows.slice(first, ROWS)


def rarity(frequency, documents: int):
    """1 for what is in every document, growing with the logarithm to 1 + RARITY."""
    return 1 + RARITY * np.minimum(1, np.log(documents / np.clip(frequency, 1, documents)) / np.log(RARE))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hashed counter, and their number.

    Each task sends its counters in blocks; blocks are added where they are sent, and the sums, one
    number per counter, come to the driver.
    """
    pieces = StructType([StructField("block", IntegerType()), StructField("counts", BinaryType())])

    def count(batches):
        import zlib

        powers, total, n = Powers(), np.zeros(COUNTERS, np.uint32), 0
        for rows in blocks(batches):
            s = Shingles(rows.column("text"), powers)
            total += np.bincount((s.keys & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n += int((np.diff(s.places) > 0).sum())
        if n:
            parts = total.reshape(-1, BLOCK)
            some = np.flatnonzero(parts.any(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int32()), pa.array([*(zlib.compress(parts[i].tobytes(), 1) for i in some), zlib.compress(np.asarray([n], np.uint64).tobytes())], pa.binary())], names=pieces.names)

    sums = StructType([StructField("block", IntegerType()), StructField("counts", ArrayType(LongType()))])

    def add(batches):
        import zlib

        found: dict[int, np.ndarray] = {}
        for rows in batches:
            for block, counts in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(counts), np.uint64 if block < 0 else np.uint32).astype(np.int64)
                found[block] = found[block] + part if block in found else part
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=sums.names)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = docs.select("text").mapInArrow(count, pieces).repartition(tasks, "block").mapInArrow(add, sums).toArrow()
    frequency, documents = np.zeros(COUNTERS), 1
    for block, counts in zip(merged["block"].to_pylist(), merged["counts"].to_pylist()):
        if block < 0:
            documents = counts[0]
        else:
            frequency[block * BLOCK : (block + 1) * BLOCK] = counts
    return frequency, documents


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, the name of its weighted shingles (k1, k2) and its band values, for every row."""
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("k1", LongType()), StructField("k2", LongType()), StructField("bands", ArrayType(LongType())),
    ])

    def sign(batches):
        powers, sampler = Powers(), Sampler(bands, rows)
        for part in blocks(batches):
            s = Shingles(part.column("text"), powers)
            names, values = s.names().view(np.int64), sampler.band_values(s, idf.value).view(np.int64)
            some = np.diff(s.places) > 0
            places = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(places), pa.array(values[some].ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[:, 0]), pa.array(names[:, 1]), listed], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, keys and times of every row, packed."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("keys", BinaryType()), StructField("times", BinaryType())])

    def pack(batches):
        powers = Powers()
        for rows in blocks(batches):
            s = Shingles(rows.column("text"), powers)
            spans = list(zip(s.places[:-1].tolist(), s.places[1:].tolist()))
            times = s.times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([s.keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([times[a:b].tobytes() for a, b in spans], pa.binary())], names=schema.names
            )

    return docs.select("doc_id", "text").mapInArrow(pack, schema)


def weighted_jaccard(keys: bytes, times: bytes, other_keys: bytes, other_times: bytes, idf: np.ndarray) -> float:
    """Sum of lesser weights over sum of greater ones."""
    a, b = np.frombuffer(keys, np.uint64), np.frombuffer(other_keys, np.uint64)
    x, y = np.frombuffer(times, np.uint32).astype(np.float64), np.frombuffer(other_times, np.uint32).astype(np.float64)
    mask = np.uint64(COUNTERS - 1)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = float((np.minimum(x[i], y[j]) * idf[a[i] & mask]).sum())
    total = float((x * idf[a & mask]).sum() + (y * idf[b & mask]).sum()) - shared
    return shared / total if total else 0.0


def verified(pairs: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """a, b and their similarity, for each of ``pairs``. Leaders with many members are split by the join."""
    left = sets.withColumnsRenamed({"doc_id": "a", "keys": "a_keys", "times": "a_times"})
    right = sets.withColumnsRenamed({"doc_id": "b", "keys": "b_keys", "times": "b_times"})
    kind = pairs.schema["a"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("similarity", DoubleType())])

    def compare(batches):
        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("a_keys", "a_times", "b_keys", "b_times")]
            found = [weighted_jaccard(*x, idf.value) for x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(found, pa.float64())], names=schema.names)

    return pairs.join(right, "b").join(left, "a").mapInArrow(compare, schema)


def prefixes(members: DataFrame, sets: DataFrame, idf, frequency, similarity: float) -> DataFrame:
    """doc_id, label, weight of all shingles, one shingle of the prefix and the weight from it on, for each of ``members`` (doc_id, label).

    The order is that of hashed counters, rarest first, then keys. What two texts share weighs at least
    ``similarity`` of either, so the first shingle that they share lies in both prefixes.
    """
    schema = StructType([
        StructField("doc_id", sets.schema["doc_id"].dataType), StructField("label", members.schema["label"].dataType),
        StructField("weight", DoubleType()), StructField("shingle", LongType()), StructField("rest", DoubleType()),
    ])

    def cut(batches):
        for rows in text_slices(batches, "keys", SLICE):
            (keys, places), (times, _) = buffer(rows.column("keys")), buffer(rows.column("times"))
            keys, places = keys.view(np.uint64), places // 8
            counter = keys & np.uint64(COUNTERS - 1)
            owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
            order = np.lexsort((keys, frequency.value[counter], owner))
            upto = np.concatenate([[0.0], np.cumsum((times.view(np.uint32) * idf.value[counter].astype(np.float64))[order])])
            total, rest = upto[places[1:]] - upto[places[:-1]], upto[places[1:]][owner] - upto[:-1]
            some = rest >= similarity * total[owner] * (1 - SLACK)
            at = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(at), rows.column("label").take(at), pa.array(total[owner[some]]), pa.array(keys[order[some]].view(np.int64)), pa.array(rest[some])], names=schema.names
            )

    return sets.join(small_side(members), "doc_id").select("doc_id", "label", "keys", "times").mapInArrow(cut, schema)


def unmet_pairs(members: DataFrame, sets: DataFrame, idf, frequency, similarity: float) -> DataFrame:
    """All pairs (a, b) of ``members`` (doc_id, label) with different labels that can be alike.

    What two texts share weighs ``similarity / (1 + similarity)`` of both together at least, and no more than
    what either weighs from the first shingle on that they share.
    """
    with arrow_rows(sets.sparkSession, 2000):
        rows = store(prefixes(members, sets, idf, frequency, similarity), "prefixes")
    several = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
    rows = store(rows.join(small_side(several), "shingle"), "shared")
    most = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    most = most.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    parts = F.expr(f"cast(n * (n - most.n) div {TOGETHER} as int)")
    rows = rows.join(most.select("shingle", F.col("most.label").alias("most"), parts.alias("parts")), "shingle")
    few = rows.where("label <> most").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts") + 1).cast("int"))
    few = few.select("shingle", "part", F.col("doc_id").alias("a"), F.col("label").alias("a_label"), F.col("weight").alias("a_weight"), F.col("rest").alias("a_rest"))
    many = rows.withColumn("part", F.explode(F.sequence(F.lit(0), "parts")))
    many = many.select("shingle", "part", F.col("doc_id").alias("b"), F.col("label").alias("b_label"), F.col("weight").alias("b_weight"), F.col("rest").alias("b_rest"))
    enough = F.least("a_rest", "b_rest") >= similarity / (1 + similarity) * (1 - SLACK) * (F.col("a_weight") + F.col("b_weight"))
    return in_order(few.join(many, ["shingle", "part"]).where((F.col("a_label") != F.col("b_label")) & enough))


def further(i: int):
    """The value of the band that is ``i`` after the next one."""
    return F.get("bands", (F.col("band") + 1 + i) % F.size("bands"))


def leader_pairs(members: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(a, b) of every member and the one of its part (equal ``keys``) that is the greatest in ``order``, if they have different labels."""
    heads = members.groupBy(*keys).agg(F.max(F.struct(*order, "doc_id", "label")).alias("h"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    heads = heads.select(*keys, F.col("h.doc_id").alias("head"), F.col("h.label").alias("head_label"))
    met = members.join(heads, keys).where("label <> head_label")
    return met.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))


def neighbour_pairs(members: DataFrame, near: int = NEAR, turn: int = 0) -> DataFrame:
    """(a, b) of members of a bucket, with different labels, that lie up to ``near`` places apart in the order of further bands.

    These are the bands that follow, from one after another in each ``turn``. Rows are sorted by ranges,
    so a large bucket lies in many tasks; rows at the ends of a range are passed on and meet those of the next one.
    """
    kind = members.schema["doc_id"].dataType
    rows = members.select("band", "value", *[further(i + 3 * turn).alias(f"v{i}") for i in range(3)], "rank", "doc_id", "label")
    order = ["band", "value", "v0", "v1", "v2", "rank"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([
        StructField("a", kind), StructField("b", kind), StructField("part", IntegerType()), StructField("side", IntegerType()),
        StructField("band", IntegerType()), StructField("value", LongType()), StructField("label", kind),
    ])

    def scan(batches):
        part, last, out, seen = TaskContext.get().partitionId(), [], [], 0
        for batch in batches:
            for doc, band, value, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "band", "value", "label"))):
                out += [(a, doc, None, None, None, None, None) for a, *key, other in last if key == [band, value] and other != label]
                if seen < near:
                    out.append((doc, None, part, 0, band, value, label))
                last, seen = [*last, (doc, band, value, label)][-near:], seen + 1
            if len(out) > 10_000:
                yield pack(out)
                out = []
        out += [(doc, None, part, 1, band, value, label) for doc, band, value, label in last]
        if out:
            yield pack(out)

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=schema.names)

    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    found = store(rows.select("band", "value", "doc_id", "label").mapInArrow(scan, schema), "neighbours")
    ends = found.where("side is not null").drop("b")
    parts = ends.select("part").distinct()  # one row per range
    following = parts.withColumn("next", F.lead("part").over(Window.partitionBy().orderBy("part")))
    tails = ends.where("side = 1").drop("side").join(F.broadcast(following), "part").select("a", F.col("next").alias("part"), "band", "value", F.col("label").alias("a_label"))
    heads = ends.where("side = 0").select(F.col("a").alias("b"), "part", "band", "value", "label")
    across = tails.join(heads, ["part", "band", "value"]).where("a_label <> label").select("a", "b")
    return found.where("side is null").select("a", "b").unionByName(across).where("a <> b")


def in_order(pairs: DataFrame) -> DataFrame:
    """Different pairs (a, b) with a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b): only the labels that these bring together are worked on."""
    of = {c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b")}
    between = links.select("a", "b").join(of["a"], "a", "left").join(of["b"], "b", "left")
    between = store(between.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct(), "between")
    found = components(between)
    further = found.select(F.col("node").alias("label"), F.col("label").alias("further"))
    known = labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return store(known.unionByName(found.join(labels, "node", "left_anti").select("node", "label")), "labels")


def find_links(docs: DataFrame, reps: DataFrame, idf, frequency, similarity: float, repeated: bool = True, exact: bool = True) -> DataFrame:
    """Verified links (a, b, similarity) between class representatives (doc_id, bands).

    ``repeated``: there may be several rows with the same doc_id.
    """
    return links_and_labels(docs, reps, idf, frequency, similarity, repeated, exact)[0]


def links_and_labels(docs: DataFrame, reps: DataFrame, idf, frequency, similarity: float, repeated: bool, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The links, and (node, label) with the least node of its component for every linked one."""
    spark = docs.sparkSession
    listed = reps.select("doc_id", "bands", F.posexplode("bands").alias("band", "value"))
    sizes = listed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = store(listed.join(sizes, ["band", "value"]).withColumn("rank", F.xxhash64("doc_id")), "buckets")
    popular = members.groupBy("doc_id").agg(F.sum("n").alias("popular"))
    members = store(members.join(popular, "doc_id").withColumns({f"v{i}": further(i) for i in range(DEPTH - 1)}), "buckets")
    found = members.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()

    def sets_of(ids: DataFrame) -> DataFrame:
        some = docs.select("doc_id", "text").where("doc_id is not null").join(small_side(ids), "doc_id", "left_semi")
        some = shingle_sets(some)
        if repeated:  # one text for each id; otherwise the wide rows need not move for it
            some = some.groupBy("doc_id").agg(F.min(F.struct("keys", "times")).alias("s")).select("doc_id", "s.keys", "s.times")
        return some

    with arrow_rows(spark, 2000):
        sets = store(sets_of(popular.select("doc_id")), "sets")

    def similar(pairs: DataFrame, most: int = VERIFIED * found["size"]) -> DataFrame:
        with arrow_rows(spark, 200):
            return store(verified(pairs, sets, idf), "verified", most)

    bucket, by_popularity = ["band", "value"], ["popular", "rank"]
    # Every member meets one leader first, of the smallest parts that it is in. What that joins is one class, whose
    # members need not meet each other again: after that only pairs of different classes are compared.
    alone = members.withColumn("label", F.col("doc_id"))
    led = leader_pairs(alone, [*bucket, *(f"v{i}" for i in range(DEPTH - 1))], by_popularity).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    checked = similar(in_order(led.groupBy("b").agg(F.max(F.struct("n", "a"))["a"].alias("a"))))
    links = checked.where(F.col("similarity") >= similarity)
    known = components(links)
    labels = known.withColumnRenamed("node", "doc_id")
    apart = store(members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "buckets")
    wanted = neighbour_pairs(apart)
    for depth in range(DEPTH):
        wanted = wanted.unionByName(leader_pairs(apart, [*bucket, *(f"v{i}" for i in range(depth))], by_popularity))
    more = similar(in_order(wanted).join(checked.select("a", "b"), ["a", "b"], "left_anti"))
    checked = checked.unionByName(more)
    new = more.where(F.col("similarity") >= similarity)
    links, known = links.unionByName(new), joined(known, new)
    for turn in range(1, int(found["most"]).bit_length()):
        labels = known.withColumnRenamed("node", "doc_id")
        several = members.where(F.col("n") > 2).join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        several = several.groupBy(*bucket, "label").agg(F.max(F.struct(*by_popularity, "doc_id", "bands")).alias("m"), F.count(F.lit(1)).alias("held"))
        several = store(several.select(*bucket, "held", "label", "m.*"), "representatives")
        open_ = several.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*bucket)
        several = several.join(open_, bucket, "left_semi")
        wanted = in_order(neighbour_pairs(several, turn=turn).unionByName(leader_pairs(several, bucket, ["held", *by_popularity])))
        more = similar(wanted.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        checked = checked.unionByName(more)
        new = more.where(F.col("similarity") >= similarity)
        if new.isEmpty():
            break
        links, known = links.unionByName(new), joined(known, new)
    if not exact:
        return links, known
    labels = known.withColumnRenamed("node", "doc_id")
    ids = reps.select("doc_id").distinct()
    all_members = store(ids.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "labelled")
    with shuffles_dropped(spark):
        wanted = unmet_pairs(all_members, sets_of(ids), idf, frequency, similarity)
        wanted = store(wanted.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "unmet")
        met = wanted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        with arrow_rows(spark, 2000):
            sets = store(sets_of(met), "sets")
        more = similar(wanted, VERIFIED * wanted.count())
    new = more.where(F.col("similarity") >= similarity)
    return links.unionByName(new), joined(known, new)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and keeper, one row for each row of ``docs``.

    ``exact``: the prefix filter, which loses no link; without it those are lost that the bands do not lead to.
    """
    counted, documents = document_frequencies(docs)
    idf = docs.sparkSession.sparkContext.broadcast(rarity(counted, documents).astype(np.float32))
    frequency = docs.sparkSession.sparkContext.broadcast(counted.astype(np.uint32))
    with arrow_rows(docs.sparkSession, 2000):
        signed = store(signatures(docs, idf), "signatures")
    named = signed.where("doc_id is not null")
    reps = store(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    repeated = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    _, labels = links_and_labels(docs, reps, idf, frequency, similarity, repeated, exact)
    labels = labels.withColumnRenamed("node", "doc_id")
    classes = reps.select("k1", "k2", "doc_id").join(labels, "doc_id", "left")
    classes = classes.select("k1", "k2", F.coalesce("label", "doc_id").alias("class_id"))
    rows = signed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    return rows.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("keeper"))


def without_copies(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """docs with one row for each class of near copies: its least doc_id, and of rows with that id the least text.

    What goes is found by id: the list of those is broadcast if it is measured to be small, else joined.
    Of rows without a doc_id, those go whose words a kept document has, and one of each text stays.
    """
    classes = store(near_classes(docs, similarity, exact), "classes")
    names = docs.columns
    number = other_name("__n", names)
    gone = small_side(classes.where("not keeper").select("doc_id").distinct())
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*names)
    repeated = classes.where("keeper").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = small_side(repeated)
        first = Window.partitionBy("doc_id").orderBy("text")
        one = kept.join(repeated, "doc_id", "left_semi").select(*names).withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number)
        kept = kept.join(repeated, "doc_id", "left_anti").select(*names).unionByName(one)
    if classes.where("doc_id is null and class_id is null").isEmpty():
        return kept
    known = classes.where("doc_id is null and class_id is not null")
    nameless = docs.where("doc_id is null").dropDuplicates(["text"])
    if known.isEmpty():
        return kept.unionByName(nameless)
    same = docs.where("doc_id is not null").select("text").distinct()
    return kept.unionByName(nameless.join(same, nameless["text"].eqNullSafe(same["text"]), "left_anti"))
