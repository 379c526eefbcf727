"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts, as many of each label, becomes a term-document matrix of hashed
terms: runs of three character kinds, words, and the share of repeated three-word runs. Each
family is weighted by square roots of relative frequencies and inverse document frequencies and
brought to unit length. A truncated SVD gives the latent space. The sample's vectors in it and their
labels are broadcast (``SAMPLE`` rows of ``RANK`` numbers for each label, 2 MB as set). Every text
is projected and multiplied with all of them in blocks; its nearest neighbours vote with their
cosine to the power ``SHARPNESS`` as weight.

The sample is the only bound: the rows of each label with the least hash of their id. Score and
features never see lang, source, doc_id or labels of the scored rows.

Defined results: null and empty texts and those without any term have score 0; equal texts have equal
scores; without labelled rows of both kinds every text has the score of the only label (1 without
any); null labels are no labels; other columns are kept apart by name; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from reelmill.llm.batches import buffer, text_slices
from reelmill.llm.words import Powers, mix, windows, word_hashes

#: Rows of each label that the model is fitted on, at most.
SAMPLE = 3000
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 4
THRESHOLD = 0.3
KIND_TERMS, WORD_TERMS, REPEAT_TERMS = 2048, 2048, 2
TERMS = KIND_TERMS + WORD_TERMS + REPEAT_TERMS
FAMILIES = ((0, KIND_TERMS, 1.0), (KIND_TERMS, KIND_TERMS + WORD_TERMS, 0.5), (KIND_TERMS + WORD_TERMS, TERMS, 1.0))
#: Texts that are handled side by side, and bytes of text in a slice.
ROWS, SLICE = 256, 1 << 20


def character_kinds() -> np.ndarray:
    """A number below 32 for each byte: small, capital, digit, beyond ASCII, blank, line end, or the symbol's own."""
    symbols = {c: 7 + i for i, c in enumerate("!#$%&*|<>.,;:?-_/=+@'\"()")}
    out = np.full(256, 6, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 3 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else symbols.get(c, 6)
    return out


KINDS = character_kinds()
FOLDED = (mix(np.arange(1 << 15, dtype=np.uint64)) % np.uint64(KIND_TERMS)).astype(np.int64)


def term_matrix(data: np.ndarray, places: np.ndarray, powers: Powers) -> np.ndarray:
    """Square roots of relative term frequencies, one row per text."""
    n = len(places) - 1
    counts = np.zeros(n * TERMS, np.float32)
    if len(data) >= 3:
        kind = KINDS[data]
        owner = np.repeat(np.arange(n), np.diff(places))
        same = owner[:-2] == owner[2:]
        run = FOLDED[(kind[:-2] << 10 | kind[1:-1] << 5 | kind[2:])[same]]
        counts += np.bincount(owner[:-2][same] * TERMS + run, minlength=n * TERMS)
    words, before = word_hashes(data, places, powers)
    if len(words):
        owner = np.repeat(np.arange(n), np.diff(before))
        counts += np.bincount(owner * TERMS + KIND_TERMS + (words % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * TERMS)
        runs, owner = windows(words, before, 3)
        if len(runs):
            _, back, often = np.unique(mix(runs + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            repeated = (often[back] > 1).astype(np.int64)
            counts += np.bincount(owner * TERMS + KIND_TERMS + WORD_TERMS + repeated, minlength=n * TERMS)
    counts = counts.reshape(n, TERMS)
    for lo, hi, _ in FAMILIES:
        total = counts[:, lo:hi].sum(axis=1, keepdims=True)
        counts[:, lo:hi] /= np.maximum(total, 1)
    return np.sqrt(counts)


def weigh(terms: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Weighted terms with every family at its own length."""
    out = np.multiply(terms, idf, out=out)
    for lo, hi, share in FAMILIES:
        size = np.linalg.norm(out[:, lo:hi], axis=1, keepdims=True)
        out[:, lo:hi] *= share / np.where(size > 0, size, 1)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def latent_basis(rows: np.ndarray, rank: int, passes: int = 4) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration with a fixed start."""
    rank = max(1, min(rank, *rows.shape))
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], min(rank + 8, min(rows.shape)))).astype(np.float32)
    for _ in range(passes):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    small = rows @ basis
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    return (basis @ turn.T)[:, :rank].astype(np.float32)


class Model:
    """What is broadcast: weights, basis, reference vectors and their labels."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, order: np.ndarray | None = None):
        """``terms`` is overwritten; ``order`` is that of its rows in the model."""
        self.fixed = None
        if len(np.unique(labels)) < 2:
            self.fixed = float(labels[0]) if len(labels) else 1.0
            return
        present = np.count_nonzero(terms, axis=0)
        self.idf = (np.log((1 + len(terms)) / (1 + present)) + 1).astype(np.float32)
        self.idf[KIND_TERMS + WORD_TERMS :] = 1
        weighted = weigh(terms, self.idf, out=terms)
        if order is not None:
            weighted, labels = weighted[order], labels[order]
        self.basis = latent_basis(weighted, RANK)
        self.references = unit(weighted @ self.basis).astype(np.float32)
        self.labels = labels.astype(np.float32)

    def score(self, terms: np.ndarray) -> np.ndarray:
        some = terms.any(axis=1)
        if self.fixed is not None:
            return np.where(some, self.fixed, 0.0)
        cosine = unit(weigh(terms, self.idf) @ self.basis) @ self.references.T
        k = min(NEIGHBOURS, cosine.shape[1])
        # Ties at the k-th place count in full, so that the order of the sample does not matter.
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        vote = np.where(cosine >= least - 1e-6, np.clip(cosine, 0, 1), 0).astype(np.float64) ** SHARPNESS
        total = vote.sum(axis=1)
        score = np.where(total > 0, (vote @ self.labels) / np.where(total > 0, total, 1), 0.5)
        return np.where(some, np.clip(score, 0, 1), 0.0)


def blocks(batches):
    """Slices of rows with their bytes, bounded in bytes and rows."""
    for rows in text_slices(batches, limit=SLICE):
        for first in range(0, rows.num_rows, ROWS):
            yield rows.slice(first, ROWS)


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the texts of at most ``sample`` ids of each label in ``labelled`` (doc_id, label).

    The sample is drawn from the labels alone; only its texts are read out, counted in tasks, and
    come to the driver as sparse rows. Of rows that share an id the least text counts.
    """
    chosen = None
    for label in (0, 1):
        part = labelled.where(F.col("label") == label).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    schema = StructType([StructField("label", chosen.schema["label"].dataType), StructField("at", ArrayType(FloatType())), StructField("value", ArrayType(FloatType()))])

    def count(batches):
        powers = Powers()
        for rows in blocks(batches):
            terms = term_matrix(*buffer(rows.column("text")), powers)
            spots = [np.flatnonzero(r) for r in terms]
            yield pa.RecordBatch.from_arrays(
                [rows.column("label"), pa.array([s.astype(np.float32) for s in spots], pa.list_(pa.float32())), pa.array([r[s] for r, s in zip(terms, spots)], pa.list_(pa.float32()))],
                names=schema.names,
            )

    found = chosen.mapInArrow(count, schema).toArrow().combine_chunks()
    labels = found["label"].to_numpy().astype(np.int64)
    terms = np.zeros((found.num_rows, TERMS), np.float32)
    for at, value in zip(found["at"].chunks, found["value"].chunks):  # one chunk, or none
        row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
        terms[row, at.flatten().to_numpy().astype(np.int64)] = value.flatten().to_numpy()
    del found
    # The order of rows follows the tasks; sort it, so that the model does not.
    order = np.lexsort(terms[:, ::97].T) if len(terms) else np.zeros(0, np.int64)
    return Model(terms, labels, order)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in ``column``, which must not be one of its own."""
    if column in docs.columns:
        raise ValueError(f"column {column} exists")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def vote(batches):
        powers, model = Powers(), shared.value
        for rows in blocks(batches):
            found = model.score(term_matrix(*buffer(rows.column("text")), powers))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], names=schema.names)

    return docs.mapInArrow(vote, schema)


def held_out(doc_id):
    """Whether a row's label must not be learned: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows whose quality may be learned."""
    return labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
