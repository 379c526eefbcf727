"""Sparse vectors, cosine top-k by blocks, taste vectors and list diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.operators.ranking import keep_known
from reelmill.session import MOST_PARTITIONS, cut_lineage, spread, store

LEFT_BLOCK = 1 << 19  # vector entries per block: some 6 MB
RIGHT_BLOCK = 1 << 21
DIGITS = 9  # similarities are rounded, so that the order of float sums decides no rank


def pack_vectors(terms: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, term_id, weight) -> (key, [kept], idx, val, norm), one row per vector.

    A vector has at most one entry per vocabulary term, so the lists are bounded by it.
    """
    entries = F.array_sort(F.collect_list(F.struct("term_id", F.col("weight").cast("double").alias("weight"))))
    packed = terms.groupBy(key, *keep).agg(entries.alias("e"))
    return with_norm(
        packed.select(key, *keep, F.col("e.term_id").cast("array<int>").alias("idx"), F.col("e.weight").alias("val"))
    )


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(F.aggregate("val", F.lit(0.0), lambda a, x: a + x * x)))


def dense_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """Dense arrays in the packed form."""
    positions = F.sequence(F.lit(0), F.size(column) - 1)
    return with_norm(df.select(key, positions.alias("idx"), F.col(column).cast("array<double>").alias("val")))


def unpack_vectors(vectors: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    pairs = F.explode(F.arrays_zip("idx", "val"))
    return vectors.select(key, *keep, pairs.alias("e")).select(
        key, *keep, F.col("e.idx").alias("term_id"), F.col("e.val").alias("weight")
    )


def _blocks(vectors: DataFrame, size: int) -> Column:
    """Number of blocks for all vectors, found when the plan runs."""
    entries = vectors.agg(F.coalesce(F.sum(F.size("idx")), F.lit(0)).alias("n"))
    return F.ceil((entries.scalar() + 1) / F.lit(float(size))).cast("long")


class _SubBlock:
    """An inverted index of some right vectors of unit length, with the greatest and least weight of every term."""

    def __init__(self, rows: np.ndarray, idx: list, val: list, norm: np.ndarray):
        self.rows = rows
        sizes = np.array([len(idx[r]) for r in rows], np.int64)
        self.terms = np.concatenate([*(idx[r] for r in rows), np.zeros(0, np.int32)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.scaled = np.concatenate([*(val[r] for r in rows), np.zeros(0)]) / np.repeat(norm[rows], sizes)
        order = np.argsort(self.terms, kind="stable")
        by_term, self.by_owner, self.by_value = self.terms[order], self.owner[order], self.scaled[order]
        self.width = int(by_term[-1]) + 1 if len(by_term) else 0
        self.start = np.searchsorted(by_term, np.arange(self.width + 1))
        self.line = np.zeros(self.width)
        self.known, first = np.unique(by_term, return_index=True)
        if len(first):
            self.most = np.maximum(np.maximum.reduceat(self.by_value, first), 0.0)
            self.least = np.minimum(np.minimum.reduceat(self.by_value, first), 0.0)
        self.full = None
        if 0 < len(rows) * self.width <= FULL * len(self.terms):
            self.full = np.zeros((len(rows), self.width))
            self.full[self.owner, self.terms] = self.scaled

    def bounds(self, idx: np.ndarray, val: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each left vector (entries from ``places``) a value that no product with a row here exceeds."""
        out = np.zeros(len(places) - 1)
        if not len(self.known) or not len(idx):
            return out
        at = np.minimum(np.searchsorted(self.known, idx), len(self.known) - 1)
        part = np.where(self.known[at] == idx, np.where(val > 0, self.most[at], self.least[at]) * val, 0.0)
        total = np.concatenate(([0.0], np.cumsum(part)))
        return total[places[1:]] - total[places[:-1]]

    def scores(self, idx: np.ndarray, val: np.ndarray, norm: float) -> np.ndarray:
        """Cosines of one left vector with all rows."""
        inside = idx < self.width
        idx, val = idx[inside], val[inside]
        first = self.start[idx]
        n = self.start[idx + 1] - first
        total = int(n.sum())
        if total == 0:
            return np.zeros(len(self.rows))
        if 2 * total > len(self.terms):
            # most of the block is touched: one pass over all of it is cheaper than collecting
            self.line[idx] = val
            if self.full is not None:
                found = self.full @ self.line / norm
            else:
                found = np.bincount(self.owner, weights=self.scaled * self.line[self.terms], minlength=len(self.rows)) / norm
            self.line[idx] = 0.0
        else:
            # positions of all entries that share a term with this vector
            spot = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            found = np.bincount(self.by_owner[spot], weights=self.by_value[spot] * np.repeat(val, n), minlength=len(self.rows)) / norm
        return np.round(found, DIGITS)


SUB_BLOCK = 512  # right vectors under one bound
SLACK = 1e-8  # above the rounding of scores and bounds
FULL = 4  # places of a matrix for each entry, up to which a sub-block is kept as one
STEP = 256  # left vectors without gaps that are multiplied at a time


def _width(idx: list, val: list) -> int:
    """The length of the vectors if all have it and no gaps, and their entries are numbers, else 0."""
    n = len(idx[0]) if len(idx) else 0
    return n if n and all(len(i) == n and i[-1] == n - 1 for i in idx) and all(np.isfinite(v).all() for v in val) else 0


class Rights:
    """Right vectors of one block, in sub-blocks, or as one matrix if they have no gaps."""

    def __init__(self, right: pd.DataFrame, right_id: str, complete: bool):
        if not complete:
            right = right[right["norm"] > 0]
        right = right.sort_values(right_id, ignore_index=True)
        self.keys = right[right_id].to_numpy()
        self.idx, self.val = [np.asarray(i, np.int64) for i in right["idx"]], [np.asarray(v, np.float64) for v in right["val"]]
        self.norm = right["norm"].where(right["norm"] > 0, 1.0).to_numpy()
        self.complete, self.width = complete, _width(self.idx, self.val)
        self._parts = None

    @property
    def parts(self) -> list[_SubBlock]:
        if self._parts is None:
            heaviest = np.array([i[np.argmax(np.abs(v))] if len(i) else -1 for i, v in zip(self.idx, self.val)])
            order = np.arange(len(self.keys)) if self.complete else np.argsort(heaviest, kind="stable")
            self._parts = [_SubBlock(np.sort(order[a : a + SUB_BLOCK]), self.idx, self.val, self.norm) for a in range(0, len(order), SUB_BLOCK)]
        return self._parts


class Matches:
    """Best matches of left vectors among right ones that come block by block.

    Right vectors are put in order of their heaviest term and cut into sub-blocks. What a left vector
    can score in one is bounded by the term weights there; sub-blocks are taken by falling bound, and
    the rest is passed over once the bound is below the k-th score known so far. That score, a number
    for each left vector, is kept from block to block. With ``complete`` or no k nothing is passed over.
    ``met`` and ``passed`` count pairs of a left vector and a sub-block.
    """

    def __init__(self, left: pd.DataFrame, left_id: str, right_id: str, complete: bool):
        left = left if complete else left[left["norm"] > 0]
        self.names, self.complete = (left_id, right_id), complete
        self.keys = left[left_id].to_numpy()
        self.idx = [np.asarray(i, np.int64) for i in left["idx"]]
        self.val = [np.asarray(v, np.float64) for v in left["val"]]
        self.norm = left["norm"].where(left["norm"] > 0, 1.0).to_numpy()
        self.k = left["k"].to_numpy()
        self.places = np.concatenate(([0], np.cumsum([len(i) for i in self.idx]))).astype(np.int64)
        self.all_idx = np.concatenate([*self.idx, np.zeros(0, np.int64)])
        self.all_val = np.concatenate([*self.val, np.zeros(0)])
        self.floor = np.full(len(self.keys), -np.inf)
        self.met = self.passed = 0
        self.width = _width(self.idx, self.val)

    def among(self, right: pd.DataFrame | Rights) -> list[pd.DataFrame]:
        """Matches in one block that can be among the k best of all blocks so far."""
        right = right if isinstance(right, Rights) else Rights(right, self.names[1], self.complete)
        if not len(self.keys) or not len(right.keys):
            return []
        if right.width and right.width == self.width:
            found = self._products(right)
        else:
            bounds = np.stack([p.bounds(self.all_idx, self.all_val, self.places) for p in right.parts], axis=1) / self.norm[:, None]
            found = (self._best(i, right.parts, bounds[i]) for i in range(len(self.keys)))
        rows, scores = zip(*found)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        if not len(owner):
            return []
        return [pd.DataFrame({self.names[0]: self.keys[owner], self.names[1]: right.keys[np.concatenate(rows)], "cos": np.concatenate(scores)})]

    def _products(self, right: Rights):
        """The same for vectors without gaps: matrices are multiplied, and only what can be among the k best is rounded and sorted."""
        theirs = (np.stack(right.val) / right.norm[:, None]).T
        for first in range(0, len(self.keys), STEP):
            mine = np.stack(self.val[first : first + STEP]) / self.norm[first : first + STEP, None]
            for i, raw in enumerate(mine @ theirs, first):
                k = int(self.k[i])
                rows = np.arange(len(raw)) if k < 0 or self.floor[i] == -np.inf else np.flatnonzero(raw >= self.floor[i] - SLACK)
                if 0 < k < len(rows):
                    kept = raw[rows]
                    rows = rows[kept >= np.partition(kept, len(kept) - k)[len(kept) - k] - SLACK]
                scores = np.round(raw[rows], DIGITS) + 0.0
                if not self.complete:
                    rows, scores = rows[scores > 0], scores[scores > 0]
                best = np.lexsort((rows, -scores))[: k if k >= 0 else None]
                if 0 < k == len(best):
                    self.floor[i] = max(self.floor[i], scores[best[-1]])
                yield rows[best], scores[best]

    def _best(self, i: int, parts: list[_SubBlock], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = int(self.k[i])
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        if k == 0:
            return rows, scores
        order = np.argsort(-bounds, kind="stable")
        for seen, p in enumerate(order):
            if not self.complete and (bounds[p] <= SLACK / 100 or (k > 0 and bounds[p] + SLACK < self.floor[i])):
                self.passed += len(order) - seen
                break
            self.met += 1
            found = parts[p].scores(self.idx[i], self.val[i], self.norm[i])
            hit = np.arange(len(found)) if self.complete else np.flatnonzero(found > max(0.0, self.floor[i] - SLACK))
            rows, scores = np.concatenate((rows, parts[p].rows[hit])), np.concatenate((scores, found[hit]))
            if 0 < k < len(rows):
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows) == k:
                self.floor[i] = max(self.floor[i], scores.min())
        best = np.lexsort((rows, -scores))
        return rows[best], scores[best]


def top_cosine(
    left: DataFrame,
    right: DataFrame,
    k: int | Column | None,
    left_id: str,
    right_id: str,
    left_block: int = LEFT_BLOCK,
    right_block: int = RIGHT_BLOCK,
    complete: bool = False,
    in_place: bool = False,
) -> DataFrame:
    """(left_id, right_id, cos, rank): for each left vector its ``k`` most similar right ones.

    Exact. Only similarities above zero are returned, or with ``complete`` k of them whenever there
    are k right vectors: zeros by key and negatives in order, a vector without length being at zero
    to all. ``k`` may be a column of ``left``, or ``None`` for all of them.

    Left vectors that are measured to fit one block go to the executors, and the right side is read
    where it lies. Otherwise both sides are hashed into blocks of bounded size and each pair of blocks
    is multiplied in one task. Either way ``Matches`` passes over what cannot be among the k best and
    returns at most k rows per left vector and block: joining on terms would instead shuffle one row
    per pair and shared term, and a frequent term would be one huge group. No block depends on how
    often a term or key occurs.

    ``in_place``: left vectors are many, wide and made as they are read. If the right ones are measured to
    fit one block, these go to the executors, and every left vector is read once, where it is made:
    neither counted, nor stored, nor moved. ``k`` is then cut where the vector is.
    """
    ids = (left.schema[left_id].dataType, right.schema[right_id].dataType)
    schema = T.StructType(
        [T.StructField(left_id, ids[0]), T.StructField(right_id, ids[1]), T.StructField("cos", T.DoubleType())]
    )
    limit = F.lit(-1) if k is None else (F.lit(k) if isinstance(k, int) else k)
    lefts = left.select(left_id, "idx", "val", "norm", limit.cast("long").alias("k"))
    if in_place:
        if entries_of(right) <= right_block:
            return _against_all(lefts, right, left_id, right_id, schema, complete)
        left = store(left, "left-vectors")  # read several times from here on
        lefts = left.select(left_id, "idx", "val", "norm", limit.cast("long").alias("k"))
    entries = entries_of(lefts)
    if entries <= left_block:
        shared = left.sparkSession.sparkContext.broadcast(lefts.toArrow().to_pandas())  # one block, as measured

        def read_on(frames):
            matches = Matches(shared.value, left_id, right_id, complete)
            for pdf in frames:
                yield from matches.among(pdf)

        scored = right.select(right_id, "idx", "val", "norm").mapInPandas(read_on, schema)
    else:
        scored = _multiply_blocks(lefts, right, left_id, right_id, schema, left_block, right_block, complete)
    place = F.row_number().over(W.partitionBy(left_id).orderBy(F.desc("cos"), F.asc(right_id)))
    ranked = scored.withColumn("rank", place)
    if k is None:
        return ranked
    if isinstance(k, int):
        return ranked.filter(F.col("rank") <= k)
    return (
        ranked.join(left.select(left_id, k.alias("_k")), left_id).filter(F.col("rank") <= F.col("_k")).drop("_k")
    )


def entries_of(vectors: DataFrame) -> int:
    """Entries of all vectors and one more for each."""
    return vectors.agg(F.coalesce(F.sum(F.size("idx") + 1), F.lit(0)).alias("n")).first()["n"]


def _against_all(lefts: DataFrame, right: DataFrame, left_id: str, right_id: str, schema: T.StructType, complete: bool) -> DataFrame:
    """Ranked matches of left vectors, batch by batch, with right ones that fit one block and are sent."""
    shared = lefts.sparkSession.sparkContext.broadcast(right.select(right_id, "idx", "val", "norm").toArrow().to_pandas())
    schema = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])

    def read_on(frames):
        rights = Rights(shared.value, right_id, complete)
        for pdf in frames:
            for found in Matches(pdf, left_id, right_id, complete).among(rights):
                yield found.assign(rank=found.groupby(left_id, sort=False, dropna=False).cumcount() + 1)

    return lefts.mapInPandas(read_on, schema)


def _multiply_blocks(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, schema: T.StructType, left_block: int, right_block: int, complete: bool
) -> DataFrame:
    """Best matches of all pairs of blocks."""
    n_left, n_right = _blocks(left, left_block), _blocks(right, right_block)

    def others(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    lefts = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), n_left)).withColumn("_rb", others(n_right))
    rights = (
        right.select(right_id, "idx", "val", "norm")
        .withColumn("_rb", F.pmod(F.xxhash64(right_id), n_right))
        .withColumn("_lb", others(n_left))
    )

    def multiply(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = Matches(l, left_id, right_id, complete).among(r)
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=schema.names)

    pairs = [spread(side, "_lb", "_rb").groupBy("_lb", "_rb") for side in (lefts, rights)]
    return pairs[0].cogroup(pairs[1]).applyInPandas(multiply, schema)


def cosine_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """All similarities above zero between two sets of vectors."""
    return top_cosine(left, right, None, left_id, right_id).drop("rank")


PART = 256  # members combined in one call
LEVEL = 64  # partial sums added in one call
SLICE_ROWS = 1 << 16  # rows that meet their items' vectors in one task


def _sum_entries(idx: list, val: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum of sparse vectors; ids are sorted and unique within each."""
    total = np.zeros(max((int(i[-1]) for i in idx if len(i)), default=-1) + 1)
    for i, v, w in zip(idx, val, weights):
        total[i] += w * np.asarray(v)
    terms = np.flatnonzero(total)
    return terms.astype(np.int32), total[terms]


class Places(dict):
    """A vector's position by item, the last one of an item with several; ``every`` lists all of them."""

    def __init__(self, items):
        super().__init__((k, i) for i, k in enumerate(items))
        self.every: dict = {}
        for i, k in enumerate(items):
            self.every.setdefault(k, []).append(i)


def meet_vectors(rows: DataFrame, item_vectors: DataFrame, keys: tuple[str, ...], item: str, schema, work, every: bool = False, slices: int = 1) -> DataFrame:
    """``work(rows, place, idx, val, norm)`` for slices of ``rows`` (keys, item, ...) with the vectors that they need.

    Rows are hashed into slices by their keys. Routes, the distinct (slice, item), send each slice
    every vector that it needs once, so neither the driver nor any task holds the whole matrix and
    no vector is copied for each row. ``place`` is a vector's position by item; ``work`` gives
    tuples or a frame. ``every``: rows without an item come too. The number of slices follows the rows, and is ``slices`` at least; no key should have many times ``SLICE_ROWS`` rows.
    """
    kind = item_vectors.schema[item].dataType
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn(item, F.col(item).cast(kind))
    kept = store(rows if every else rows.filter(F.col(item).isNotNull()), "rows-to-vectors")
    n = max(least, kept.count() // SLICE_ROWS + 1, slices)
    placed = kept.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(n)))
    routes = placed.select(F.col("_slice").alias("_to"), item).distinct()
    moved = item_vectors.select(item, "idx", "val", "norm").join(routes, item)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def one(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        place = Places(r[item])
        vectors = [np.asarray(x) for x in r["idx"]], [np.asarray(x) for x in r["val"]], r["norm"].to_numpy()
        found = work(l, place, *vectors)
        return found if isinstance(found, pd.DataFrame) else pd.DataFrame(list(found), columns=schema.names)

    tasks = min(n, MOST_PARTITIONS)
    sides = [side.repartition(tasks, by).groupBy(by) for side, by in ((placed, "_slice"), (moved, "_to"))]
    return sides[0].cogroup(sides[1]).applyInPandas(one, schema)


SLICE_ENTRIES = 1 << 22  # entries of the sums that one task makes of its slice: some 50 MB
SENT_ENTRIES = 1 << 20  # entries of sums that leave a task together: some 12 MB
LIST_ROWS = 1 << 20  # members in one task that has its items' vectors


def combine_vectors(members: DataFrame, item_vectors: DataFrame, group: str, item: str = "item", weight: str = "w") -> DataFrame:
    """(group, idx, val, norm): the weighted sum of each group's item vectors.

    ``members`` has one row per (group, item). Entries are summed as arrays inside tasks, so no row
    per group and term is ever shuffled. A group with many members is cut into parts of about
    ``PART`` and the parts are summed afterwards, so that none is worked on as a whole. Only such partial
    sums are stored: the sums of all groups may be many times the items' vectors, so those of
    one part are made as they are read. Item vectors that are measured to fit one block go to as few slices of
    the member lists as there are cores. Otherwise lists are cut into slices, by what their sums will
    measure, which get the vectors that they need, each once (``meet_vectors``).
    """
    kind = members.schema[group].dataType.simpleString()
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PART))).alias("_parts"))
    rows = members.select(group, item, F.col(weight).cast("double").alias("_w")).join(sizes, group)
    rows = store(rows.withColumn("_part", F.pmod(F.xxhash64(item), F.col("_parts"))), "members")
    schema = f"{group} {kind}, _parts long, _part long, idx array<int>, val array<double>, norm double"
    keys = [group, "_parts", "_part"]

    def packed(idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return idx, val, float(np.sqrt(np.cumsum(val * val)[-1])) if len(val) else 0.0

    def add_members(rows: pd.DataFrame, place: dict, idx: list, val: list, norm: np.ndarray):
        rows = rows[rows[item].isin(list(place))]
        for (g, parts, part), mine in rows.groupby(keys, sort=False):
            at = [place[i] for i in mine[item]]
            yield g, parts, part, *packed(*_sum_entries([idx[i] for i in at], [val[i] for i in at], mine["_w"].to_numpy()))

    entries = entries_of(item_vectors)
    size = item_vectors.agg(F.coalesce(F.avg(F.size("idx")), F.lit(0.0)).alias("n")).first()["n"]

    def summed(some: DataFrame) -> DataFrame:
        if entries <= RIGHT_BLOCK:
            return _sums_in_few_slices(some, item_vectors, keys, item, schema, packed)
        lists = some.select(*keys).distinct().count()
        return meet_vectors(some, item_vectors, (group, "_part"), item, schema, add_members, slices=int(lists * size) // SLICE_ENTRIES + 1)

    def add_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        total = packed(*_sum_entries(pdf["idx"].to_list(), pdf["val"].to_list(), np.ones(len(pdf))))
        return pd.DataFrame([(pdf[group].iloc[0], pdf["_parts"].iloc[0], pdf["_part"].iloc[0], *total)], columns=[*keys, "idx", "val", "norm"])

    # Most groups have one part. The others' parts are added ``LEVEL`` at a time, level by level.
    done = summed(rows.filter("_parts = 1"))
    split = rows.filter("_parts > 1")
    if not split.isEmpty():
        split = store(summed(split).filter(F.size("idx") > 0), "partial-sums")
    while not split.isEmpty():
        parts = split.withColumn("_part", F.expr(f"_part div {LEVEL}")).withColumn("_parts", F.expr(f"(_parts + {LEVEL - 1}) div {LEVEL}"))
        split = store(parts.groupBy(group, "_part").applyInPandas(add_parts, schema), "partial-sums")
        done = done.unionByName(split.filter("_parts = 1"))
        split = split.filter("_parts > 1")
    return done.filter(F.size("idx") > 0).select(group, "idx", "val", "norm")


def _sums_in_few_slices(members: DataFrame, item_vectors: DataFrame, keys: list[str], item: str, schema: str, packed) -> DataFrame:
    """(keys, idx, val, norm): the weighted sums of all lists (equal ``keys``) of ``members`` (keys, item, _w).

    A task reads the vectors that its slice needs, each once, and then its lists; sums leave it as they are
    made. So slices need not be as many as their sums would fill, each with vectors of its own.
    """
    known = members.withColumn(item, F.col(item).cast(item_vectors.schema[item].dataType)).filter(F.col(item).isNotNull())
    n = max(members.sparkSession.sparkContext.defaultParallelism, known.count() // LIST_ROWS + 1)
    known = known.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    lists = known.groupBy("_slice", *keys).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col("_w").alias("w"))).alias("_m"))
    lists = lists.select("_slice", F.lit(1).alias("_kind"), *keys, F.col("_m.i").alias("_items"), F.col("_m.w").alias("_weights"))
    moved = item_vectors.select(item, "idx", "val").join(known.select("_slice", item).distinct(), item)
    moved = moved.select("_slice", F.lit(0).alias("_kind"), F.col(item).alias("_item"), "idx", "val")
    both = moved.unionByName(lists, allowMissingColumns=True).repartitionById(n, F.col("_slice")).sortWithinPartitions("_kind")

    def run(batches):
        place, idx, val = {}, [], []
        for batch in batches:
            vectors, rows = (batch.filter(pc.equal(batch.column("_kind"), k)) for k in (0, 1))
            for i, terms, weights in zip(*(vectors.column(c) for c in ("_item", "idx", "val"))):
                place[i.as_py()] = len(idx)
                idx.append(terms.values.to_numpy())
                val.append(weights.values.to_numpy(zero_copy_only=False))
            out, held, first = [], 0, 0
            for r, (items, weights) in enumerate(zip(rows.column("_items").to_pylist(), rows.column("_weights").to_pylist())):
                mine = [(place[i], w) for i, w in zip(items, weights) if i in place]
                out.append(packed(*_sum_entries([idx[i] for i, _ in mine], [val[i] for i, _ in mine], np.array([w for _, w in mine], float))))
                held += len(out[-1][0]) + 1
                if held > SENT_ENTRIES or r + 1 == rows.num_rows:
                    ends = pa.array(np.cumsum([0, *(len(i) for i, _, _ in out)]), pa.int32())
                    entries = (pa.array(np.concatenate(c), t) for c, t in zip(list(zip(*out))[:2], (pa.int32(), pa.float64())))
                    sums = [*(pa.ListArray.from_arrays(ends, e) for e in entries), pa.array([norm for _, _, norm in out], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(first, len(out)) for c in keys), *sums], names=[*keys, "idx", "val", "norm"])
                    out, held, first = [], 0, r + 1

    return both.mapInArrow(run, schema)


def _known_members(members: DataFrame, item_vectors: DataFrame, item: str) -> DataFrame:
    return keep_known(members, item_vectors, item)


def taste_vectors(seeds: DataFrame, item_vectors: DataFrame, group: str, item: str = "item", rating: str = "rating") -> DataFrame:
    """Per group the mean of its items' vectors, weighted by rating / 10 (10 if there is none), packed.

    The plain mean if the weights add up to zero. Items without a profile are ignored.
    """
    rated = seeds.select(group, item, (F.coalesce(F.col(rating).cast("double"), F.lit(10.0)) / 10.0).alias("_r"))
    known = _known_members(rated, item_vectors, item).groupBy(group, item).agg(
        F.sum("_r").alias("_r"), F.count(F.lit(1)).alias("_m")
    )
    totals = known.groupBy(group).agg(F.sum("_r").alias("_tr"), F.sum("_m").alias("_tm"))
    share = F.when(F.col("_tr") > 0, F.col("_r") / F.col("_tr")).otherwise(F.col("_m") / F.col("_tm"))
    return combine_vectors(known.join(totals, group).select(group, item, share.alias("w")), item_vectors, group, item)


def mean_vectors(members: DataFrame, item_vectors: DataFrame, group: str, item: str = "item") -> DataFrame:
    """Plain mean of the members' vectors, packed; an item given twice counts twice."""
    known = _known_members(members.select(group, item), item_vectors, item).groupBy(group, item).agg(F.count(F.lit(1)).alias("_m"))
    totals = known.groupBy(group).agg(F.sum("_m").alias("_tm"))
    share = F.col("_m") / F.col("_tm")
    return combine_vectors(known.join(totals, group).select(group, item, share.alias("w")), item_vectors, group, item)


def intra_list_diversity(lists: DataFrame, item_vectors: DataFrame, group: str, item: str = "item") -> DataFrame:
    """(group, ild): one minus the mean cosine over all pairs of a list; zero below two items.

    No pairs are formed: the cosines of all pairs add up to (|sum of unit vectors|^2 - number of
    non-zero vectors) / 2. Items without a profile do not count as members.
    """
    norms = item_vectors.select(item, "norm")
    known = cut_lineage(lists.select(group, item).distinct().join(norms, item))
    sizes = known.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("norm") > 0).alias("n_units")
    )
    units = known.filter("norm > 0").select(group, item, (F.lit(1.0) / F.col("norm")).alias("w"))
    sums = combine_vectors(units, item_vectors, group, item).select(group, (F.col("norm") * F.col("norm")).alias("length2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    shared = (F.coalesce(F.col("length2"), F.lit(0.0)) - F.coalesce("n_units", F.lit(0))) / 2
    return (
        lists.select(group).distinct().join(sizes, group, "left").join(sums, group, "left")
        .select(group, F.when(F.col("n") >= 2, F.lit(1.0) - shared / pairs).otherwise(0.0).alias("ild"))
    )
