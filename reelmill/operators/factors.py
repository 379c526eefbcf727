"""Latent factors of the user x item rating matrix: randomised subspace iteration on Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from reelmill.operators.ranking import keep_known, min_support
from reelmill.operators.sampling import dense_ids
from reelmill.session import discard, shuffles_dropped, small_side, store, stored_side

BLOCK = 256  # rows of a factor block: some 330 KB at 160 columns
CELLS = 1 << 17  # cells of a part: some blocks of rows, or a share of one
PARTS = 1 << 8  # parts of a group, which gets the other side's rows that it needs, each once
STEP = 1 << 10  # cells that are multiplied at a time
SENT = 64 << 20  # bytes of factor rows that are sent to every executor whole
HELD = 192 << 20  # bytes of factor rows that a task holds at a time
ROWS = 1 << 22  # rows that a task scores
LAST = (1 << 63) - 1  # sorts after every block


def rating_cells(reviews: DataFrame, min_user_rows: int = 0) -> DataFrame:
    """(user, item, r): the sum of a user's ratings of an item; users with enough rows only."""
    rows = reviews.filter(F.col("user").isNotNull() & F.col("item").isNotNull())
    if min_user_rows > 1:
        rows = keep_known(rows, min_support(rows, "user", min_user_rows), "user")
    return rows.groupBy("user", "item").agg(F.sum(F.col("rating").cast("double")).alias("r"))


def _sum_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """Element-wise sum of arrays per key, with partial sums before the shuffle."""
    total = Summarizer.metrics("sum").summary(array_to_vector(column))
    return df.groupBy(key).agg(total.alias("s")).select(key, vector_to_array(F.col("s.sum")).alias(column))


def _start(ids: DataFrame, width: int, seed: int) -> DataFrame:
    """Random rows (id, v) that depend on the item's name and the seed only: uniform in (-1, 1)."""
    draw = F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda j: F.xxhash64(F.col("item").cast("string"), j, F.lit(seed)).cast("double") / float(1 << 63),
    )
    return ids.select("id", draw.alias("v"))


def _pack(rows: DataFrame, width: int) -> DataFrame:
    """Rows (id, v) as stored blocks (b, m) of ``BLOCK`` rows each; missing rows are zero."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((BLOCK, width))
        block[pdf["id"].to_numpy() % BLOCK] = np.stack(pdf["v"].to_list())
        return pd.DataFrame({"b": [pdf["id"].iloc[0] // BLOCK], "m": [block.tobytes()]})

    return store(rows.groupBy(F.expr(f"id div {BLOCK}")).applyInPandas(pack, "b long, m binary"), "blocks")


class _Side:
    """Factor rows of one side as stored blocks (b, m), and ``whole`` if they are measured to fit ``SENT``."""

    def __init__(self, blocks: DataFrame, n: int, width: int):
        self.blocks, self.n, self.width, self.whole = blocks, n, width, None
        if n * width * 8 <= SENT:
            self.whole = np.zeros((-(-n // BLOCK) * BLOCK, width))
            listed = blocks.toArrow()
            for b, m in zip(listed["b"].to_pylist(), listed["m"].to_pylist()):
                self.whole[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(m).reshape(BLOCK, -1)

    def gram(self, turn: np.ndarray | None) -> np.ndarray:
        if self.whole is None:
            return _block_gram(self.blocks, turn, self.width)
        rows = self.whole if turn is None else self.whole @ turn
        return rows.T @ rows


class _Stripes:
    """Cells packed by groups of rows of one side (``near``), and where the other side's rows (``far``) are needed.

    ``packed``: (g, near, far, r), near in order; one row is a part of some ``CELLS`` cells, and a group holds about
    ``PARTS`` parts. A block of rows with more cells than a part is in several, by hash of the far row.
    ``routes``: (b, g, far), for each block of the other side and each group the rows that go there.
    """

    def __init__(self, cells: DataFrame, near: str, far: str, total: int):
        parts = total // CELLS + 1
        self.groups = -(-parts // PARTS)
        keyed = cells.withColumn("b", F.expr(f"{near} div {BLOCK}"))
        shares = store(keyed.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CELLS))).alias("parts")), "parts")
        keyed = keyed.join(stored_side(shares), "b").withColumn("part", F.pmod(F.xxhash64(far), F.col("parts")))
        keyed = keyed.withColumn("p", F.pmod(F.xxhash64("b", "part"), F.lit(parts)))
        listed = F.sort_array(F.collect_list(F.struct(F.col(near).alias("n"), F.col(far).alias("f"), "r")))
        packed = keyed.groupBy("p").agg(listed.alias("c"))
        group = (F.col("p") % self.groups).alias("g")
        self.packed = store(packed.select(group, F.col("c.n").alias("near"), F.col("c.f").alias("far"), F.col("c.r").alias("r")), "stripes")
        discard(shares)
        needed = self.packed.select("g", F.explode(F.array_distinct("far")).alias("f"))
        self._needed = needed.groupBy(F.expr(f"f div {BLOCK}").alias("b"), "g").agg(F.sort_array(F.collect_set("f")).alias("far"))
        self._routes, self._most = None, 0

    @property
    def routes(self) -> DataFrame:
        if self._routes is None:
            self._routes = store(self._needed, "routes")
        return self._routes

    @property
    def most(self) -> int:
        """Rows of the other side that the group with most of them needs."""
        if not self._most:
            self._most = self.routes.groupBy("g").agg(F.sum(F.size("far")).alias("n")).agg(F.max("n")).first()[0] or 1
        return self._most

    def drop(self) -> None:
        discard(self.packed, *([] if self._routes is None else [self._routes]))


def _squeeze(values: np.ndarray) -> bytes:
    """64-bit values compressed with equal bytes of all values side by side."""
    return zlib.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _multiply(near: np.ndarray, spot: np.ndarray, r: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    """Blocks of the near side: for every cell its rating times the far row at ``spot``, added up by near row."""
    out: dict[int, np.ndarray] = {}
    for i in range(0, len(near), STEP):
        n, s, w = near[i : i + STEP], spot[i : i + STEP], r[i : i + STEP]
        first = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
        sums = np.add.reduceat(w[:, None] * rows[s], first, axis=0)
        for b in np.unique(n[first] // BLOCK):
            block = out.setdefault(int(b), np.zeros((BLOCK, rows.shape[1])))
            mine = n[first] // BLOCK == b
            block[n[first][mine] % BLOCK] += sums[mine]
    return [(b, m.tobytes()) for b, m in out.items()]


def _half(stripes: _Stripes, far: _Side, turn: np.ndarray | None, n: int) -> _Side:
    """The near side's rows: the cells times the far side's rows, turned by a small matrix.

    Far rows that fit ``SENT`` are sent to all tasks. Otherwise a task has a group's cells and one slice of the
    columns of the far rows on its route, at most ``HELD`` bytes; the cells go to each slice, squeezed. Sums are
    made inside the task, so that only blocks of the near side move on, to meet their other slices.
    """
    schema = "b long, s int, m binary"
    if far.whole is not None:
        cuts = np.array([0, far.width])
        rows = far.whole if turn is None else far.whole @ turn
        shared = far.blocks.sparkSession.sparkContext.broadcast(rows)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for near, spot, r in zip(pdf["near"], pdf["far"], pdf["r"]):
                    yield pd.DataFrame(_multiply(near, spot, r, shared.value), columns=["b", "m"]).assign(s=0)[["b", "s", "m"]]

        found = stripes.packed.mapInPandas(run, schema)
    else:
        cores = far.blocks.sparkSession.sparkContext.defaultParallelism
        slices = max(-(-stripes.most * far.width * 8 // HELD), -(-cores // stripes.groups))
        slices = min(slices, far.width)
        cuts = np.linspace(0, far.width, slices + 1).astype(int)
        found = _routed(stripes, far, turn, cuts).mapInPandas(_sliced_sums(cuts, stripes.most), schema)

    def whole_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((BLOCK, cuts[-1]))
        for s, m in zip(pdf["s"], pdf["m"]):
            block[:, cuts[s] : cuts[s + 1]] += np.frombuffer(m).reshape(BLOCK, -1)
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "m": [block.tobytes()]})

    blocks = store(found.groupBy("b").applyInPandas(whole_blocks, "b long, m binary"), "blocks")
    if far.whole is not None:
        shared.destroy()
    return _Side(blocks, n, far.width)


def _routed(stripes: _Stripes, far: _Side, turn: np.ndarray | None, cuts: np.ndarray) -> DataFrame:
    """(t, b, ids, m), a partition for each t, which is a group and a slice of the columns: first the far rows in order, then the cells."""
    slices = len(cuts) - 1
    schema = "t long, b long, ids binary, m binary"

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for b, g, ids, m in zip(pdf["b"], pdf["g"], pdf["far"], pdf["m"]):
                rows = np.frombuffer(m).reshape(BLOCK, -1)[ids % BLOCK]
                rows = rows if turn is None else rows @ turn
                cut = [rows[:, i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
                yield pd.DataFrame({"t": g * slices + np.arange(slices), "b": b, "ids": [(ids % BLOCK).astype("<u4").tobytes()] * slices, "m": cut})

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for g, near, spot, r in zip(pdf["g"], pdf["near"], pdf["far"], pdf["r"]):
                pair = _squeeze(np.concatenate([np.diff(near, prepend=0), spot]))
                yield pd.DataFrame({"t": g * slices + np.arange(slices), "b": LAST, "ids": [pair] * slices, "m": [_squeeze(r)] * slices})

    sent = far.blocks.join(stripes.routes, "b").select("b", "g", "far", "m").mapInPandas(pick, schema)
    both = sent.unionByName(stripes.packed.mapInPandas(copy, schema))
    return both.repartitionById(stripes.groups * slices, F.col("t").cast("int")).sortWithinPartitions("t", "b")


def _sliced_sums(cuts: np.ndarray, most: int):
    """What a task makes of ``_routed``: (b, s, m), sums of a part's cells for blocks of the near side and one slice of the columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = None
        for pdf in frames:
            for t, b, ids, m in zip(pdf["t"], pdf["b"], pdf["ids"], pdf["m"]):
                if t != task:
                    task, s, n = t, t % (len(cuts) - 1), 0
                    known, rows = np.empty(most, np.int64), np.empty((most, cuts[s + 1] - cuts[s]))
                if b != LAST:
                    found = np.frombuffer(ids, "<u4")
                    known[n : n + len(found)] = b * BLOCK + found
                    rows[n : n + len(found)] = np.frombuffer(m).reshape(len(found), -1)
                    n += len(found)
                else:
                    near, spot = _unsqueeze(ids, np.int64).reshape(2, -1)
                    if known[n - 1] != n - 1:  # else no row is missing
                        spot = np.searchsorted(known[:n], spot)
                    sums = _multiply(np.cumsum(near), spot, _unsqueeze(m, np.float64), rows)
                    yield pd.DataFrame(sums, columns=["b", "m"]).assign(s=s)[["b", "s", "m"]]

    return run


def _block_gram(blocks: DataFrame, turn: np.ndarray | None, width: int) -> np.ndarray:
    """Z'Z of the blocks' rows after ``turn``: one small matrix per task, summed on the cluster."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in frames:
            for m in pdf["m"]:
                block = np.frombuffer(m).reshape(BLOCK, -1)
                block = block if turn is None else block @ turn
                total += block.T @ block
        yield pd.DataFrame({"i": np.arange(width), "g": list(total)})

    return _collect_gram(blocks.select("m").mapInPandas(run, "i int, g array<double>"), width)


def factor_gram(vectors: DataFrame) -> DataFrame:
    """(i, j, g): the products of entries i and j of ``factors``, summed over all rows. A task adds up one small matrix.

    Null entries give no product; g is null where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = met = np.zeros((0, 0))
        for batch in batches:
            lists = batch.column("factors").drop_null()
            sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
            width = max(len(total), int(sizes.max(initial=0)))
            total, met = (np.pad(x, (0, width - len(x))) for x in (total, met))
            inside = np.arange(width) < sizes[:, None]
            for x, entries in ((total, flat.fill_null(0.0)), (met, flat.is_valid().cast(pa.float64()))):
                rows = np.zeros(inside.shape)
                rows[inside] = entries.to_numpy(zero_copy_only=False)
                x += rows.T @ rows
        i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel(), pa.float64(), mask=met.ravel() == 0)], names=["i", "j", "g"])

    rows = vectors.select(F.col("factors").cast("array<double>").alias("factors"))
    return rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def _collect_gram(parts: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for row in _sum_vectors(parts, "i", "g").collect():  # as many rows as factors
        out[row["i"]] = row["g"]
    return out


def _whitener(gram: np.ndarray) -> np.ndarray:
    """T with (Z T)'(Z T) = I, from Z'Z; directions without length become zero columns."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > values.max() * 1e-14 if values.max() > 0 else np.zeros(len(values), bool)
    scale = np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    return vectors * scale


def _orthonormal_turn(side: _Side) -> np.ndarray:
    """The small matrix that makes the rows' columns orthonormal, by way of Gram matrices, twice for accuracy."""
    turn = _whitener(side.gram(None))
    return turn @ _whitener(side.gram(turn))


def truncated_svd(
    cells: DataFrame, k: int = 150, n_iter: int = 10, seed: int = 42, oversampling: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(user, factors) = U S and (item, factors) = V of the rating cells.

    Each iteration multiplies k + oversampling columns by A'A: cells packed by users give rows of users
    from those of items, cells packed by items the other way round. Orthonormalising needs only a
    small Gram matrix; the turn it asks for is applied as rows are read. Stages that are no longer needed are deleted on the way.
    """
    with shuffles_dropped(cells.sparkSession):
        return _truncated_svd(cells, k, n_iter, seed, oversampling)


def _truncated_svd(cells: DataFrame, k: int, n_iter: int, seed: int, oversampling: int) -> tuple[DataFrame, DataFrame]:
    item_ids, user_ids = (store(dense_ids(cells, c, "id"), f"{c}-ids") for c in ("item", "user"))
    numbered = cells.select("user", "item", F.col("r").cast("double").alias("r"))
    for key, ids, number in (("user", user_ids, "u"), ("item", item_ids, "i")):
        numbered = numbered.join(stored_side(ids.withColumnRenamed("id", number)), key)
    numbered = store(numbered.select("u", "i", "r"), "cells")
    n_items, n_users, total = item_ids.count(), user_ids.count(), numbered.count()
    width = min(k + oversampling, n_items)
    by_item, by_user = _Stripes(numbered, "i", "u", total), _Stripes(numbered, "u", "i", total)

    items = _Side(_pack(_start(item_ids, width, seed), width), n_items, width)
    turn = _orthonormal_turn(items)
    for _ in range(n_iter):
        users = _half(by_user, items, turn, n_users)
        discard(items.blocks)
        items = _half(by_item, users, None, n_items)
        discard(users.blocks)
        turn = _orthonormal_turn(items)
    users = _half(by_user, items, turn, n_users)
    values, vectors = np.linalg.eigh(users.gram(None))
    rotation = vectors[:, np.argsort(values)[::-1][:k]]
    for done in (by_item, by_user):
        done.drop()
    discard(numbered)
    return _block_factors(users.blocks, user_ids, "user", rotation), _block_factors(items.blocks, item_ids, "item", turn @ rotation)


def _block_factors(blocks: DataFrame, ids: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """(key, factors) from blocks times a small matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for b, m in zip(pdf["b"], pdf["m"]):
                yield pd.DataFrame({"id": np.arange(b * BLOCK, (b + 1) * BLOCK), "factors": list(np.frombuffer(m).reshape(BLOCK, -1) @ matrix)})

    return blocks.mapInPandas(run, "id long, factors array<double>").join(stored_side(ids), "id").select(key, "factors")


def explained_variance(user_factors: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of the factor columns' variances over that of the matrix columns, absent cells being 0."""
    stats = user_factors.agg(
        Summarizer.metrics("mean", "normL2", "count").summary(array_to_vector("factors")).alias("s")
    )
    pairs = F.arrays_zip(vector_to_array(F.col("s.mean")).alias("m"), vector_to_array(F.col("s.normL2")).alias("l"))
    n = F.col("s.count").cast("double")
    captured = F.aggregate(pairs, F.lit(0.0), lambda acc, c: acc + c["l"] * c["l"] / n - c["m"] * c["m"])
    n_users = cells.select("user").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    by_item = cells.groupBy("item").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("s2"))
    whole = by_item.agg(F.sum(F.col("s2") / n_users - F.pow(F.col("s") / n_users, F.lit(2.0))).alias("v"))
    return stats.select((captured / whole.scalar()).alias("explained_variance"))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _vector_blocks(side: DataFrame, key: str) -> DataFrame:
    """Vectors as stored blocks (b, keys, sizes, m), padded with zeros; size -1 is a vector that gives no product."""
    schema = StructType([StructField("b", LongType()), StructField("keys", ArrayType(side.schema[key].dataType))])
    schema = schema.add("sizes", ArrayType(IntegerType())).add("m", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 28
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                keys, vectors = (c.slice(at, BLOCK) for c in batch.columns)
                vectors = [None if v is None else v.values for v in vectors]
                sizes = [-1 if v is None or v.null_count else len(v) for v in vectors]
                m = np.zeros((len(sizes), max(0, *sizes)))
                for i, n in enumerate(sizes):
                    if n > 0:
                        m[i, :n] = vectors[i].to_numpy()
                lists = [pa.ListArray.from_arrays([0, len(sizes)], x) for x in (keys, pa.array(sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([b]), *lists, pa.array([m.tobytes()])], names=["b", "keys", "sizes", "m"])
                b += 1

    rows = side.filter(F.col(key).isNotNull()).select(key, F.col("factors").cast("array<double>").alias("factors"))
    return store(rows.mapInArrow(run, schema), "vectors")


def _vectors_sent(blocks: DataFrame, rows: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """(t, b, ids, m): of each block's vectors those that rows of task ``t`` need, each once; and their stored routes (b, t, spots)."""
    routes = rows.groupBy(F.expr(f"{number} div {BLOCK}").alias("b"), "t").agg(F.sort_array(F.collect_set(F.expr(f"{number} % {BLOCK}"))).alias("spots"))
    routes = store(routes, "routes")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for b, t, spots, n, m in zip(pdf["b"], pdf["t"], pdf["spots"], pdf["n"], pdf["m"]):
                picked = np.frombuffer(m).reshape(n, -1)[spots]
                yield pd.DataFrame({"t": [t], "b": [b], "ids": [(b * BLOCK + spots).astype("<i8").tobytes()], "m": [picked.tobytes()]})

    sent = blocks.join(routes, "b").select("b", "t", "spots", F.size("sizes").alias("n"), "m")
    return sent.mapInPandas(pick, "t int, b long, ids binary, m binary"), routes


def _products(width: int, most: int, names: list[str]):
    """What a task makes of item vectors, and then of blocks of user vectors each with its rows: the rows and u . v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held, n, order = np.empty(most, np.int64), np.zeros((most, width)), 0, None
        users, mine = np.empty(0, np.int64), np.zeros((0, width))
        for batch in batches:
            kind, u, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "_u", "_v"))
            rows = kind == 2
            score = np.zeros(len(kind))
            marks = np.flatnonzero(~rows)
            for i, j in zip([-1, *marks], [*marks, len(kind)]):
                if i >= 0:  # the vectors that come before these rows
                    ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i8")
                    vectors = np.frombuffer(batch.column("m")[i].as_buffer()).reshape(len(ids), -1)
                    if kind[i]:
                        users, mine = ids.copy(), np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
                    else:
                        items[n : n + len(ids)], held[n : n + len(ids), : vectors.shape[1]] = ids, vectors
                        n += len(ids)
                for k in range(i + 1, j, STEP):
                    if order is None:
                        order = np.argsort(items[:n])
                        items = items[:n][order]
                    part = slice(k, min(k + STEP, j))
                    ours = mine[np.searchsorted(users, u[part].astype(np.int64))]
                    theirs = held[order[np.searchsorted(items, v[part].astype(np.int64))]]
                    if width:  # added up from left to right, as ``dot`` does
                        score[part] = np.cumsum(ours * theirs, axis=1)[:, -1]
            if rows.any():
                out = batch.column("row").filter(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.flatten(), pa.array(score[rows])], names=names)

    return run


def factor_scores(candidates: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Add ``factor_score`` = u . v to (user, item) rows; zero where either side is unknown.

    Rows are joined with the numbers of their vectors only. A task holds a share of the item vectors, at
    most some ``HELD`` bytes, and goes through its rows in the order of their users; it gets every vector that
    its rows need once, so that no vector moves with a row. A key with several vectors gives a row for each.
    """
    with shuffles_dropped(candidates.sparkSession):
        return _factor_scores(candidates, user_factors, item_factors)


def _factor_scores(candidates: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    columns = ["item", "user", *(c for c in candidates.columns if c not in ("user", "item"))]
    known, blocks = candidates, {}
    for key, side, number in (("user", user_factors, "_u"), ("item", item_factors, "_v")):
        blocks[key] = _vector_blocks(side, key)
        listed = blocks[key].select("b", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("sizes").alias("size"))).alias("at", "x"))
        ids = listed.select(F.col("x.key").alias(key), (F.col("b") * BLOCK + F.col("at")).alias(number), F.col("x.size").alias(f"{number}_size"))
        known = known.join(small_side(ids), key, "left")
    known = store(known, "candidates")
    both = F.coalesce((F.col("_u_size") >= 0) & (F.col("_u_size") == F.col("_v_size")), F.lit(False))
    zero = known.filter(~both).select(*columns, F.lit(0.0).alias("factor_score"))

    n_rows = known.filter(both).count()
    if not n_rows:
        return zero
    sizes = blocks["item"].select(F.explode("sizes").alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    n_users = blocks["user"].agg(F.sum(F.size("sizes"))).first()[0]
    width, n_items, cores = max(sizes[0], 0), sizes[1], known.sparkSession.sparkContext.defaultParallelism
    least = -(-n_items * max(width, 1) * 8 // HELD)
    # User vectors may go to every share of the items, item vectors to every group of users. What a task sorts should fit its memory.
    fit = -(-n_users * max(width, 1) * 8 // (2 * HELD))
    groups_of = {n: max(fit, -(-cores // n), -(-n_rows // (n * ROWS))) for n in range(least, max(least, cores) + 1)}
    shares, groups = min(groups_of.items(), key=lambda x: x[0] * n_users + x[1] * n_items)
    # whole blocks of users and of items stay together
    share, group = (F.pmod(F.xxhash64(F.expr(f"{c} div {BLOCK}")), F.lit(n)) for c, n in (("_v", shares), ("_u", groups)))
    rows = known.filter(both).withColumn("t", (share * groups + group).cast("int"))
    needed = rows.select("t", "_u", "_v")
    of_users, _ = _vectors_sent(blocks["user"], needed, "_u")
    of_items, routes = _vectors_sent(blocks["item"], needed, "_v")
    most = routes.groupBy("t").agg(F.sum(F.size("spots")).alias("n")).agg(F.max("n")).first()[0]

    kinds = [
        of_items.select("t", F.lit(-1).cast("long").alias("b"), F.lit(0).alias("kind"), "ids", "m"),
        of_users.select("t", "b", F.lit(1).alias("kind"), "ids", "m"),
        rows.select("t", F.expr(f"_u div {BLOCK}").alias("b"), F.lit(2).alias("kind"), "_u", "_v", F.struct(*columns).alias("row")),
    ]
    both_kinds = kinds[0].unionByName(kinds[1]).unionByName(kinds[2], allowMissingColumns=True)
    ordered = both_kinds.repartitionById(shares * groups, F.col("t")).sortWithinPartitions("b", "kind")
    names = [*columns, "factor_score"]
    schema = StructType([*known.select(*columns).schema.fields, StructField("factor_score", DoubleType())])
    return ordered.mapInArrow(_products(width, most, names), schema).unionByName(zero)
