"""N-grams of whole batches of documents as numbers: counted by 128-bit hashes, named or weighed where they are wanted.

A corpus has several times more different n-grams than words, and nearly all of them are too rare for a
vocabulary. So the texts' words are numbered per Arrow batch, n-grams are chains of these numbers, and what
is shuffled is two hashes and two counts for each n-gram of a batch. Only those that are frequent enough get
their text, from a second reading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.functions.text import tokens
from reelmill.session import partitions_for, spread

RANGES = 16  # hash ranges that are merged, for each partition of the texts
SENT = 4_000_000  # n-grams whose hashes, 64 MB, are sent to the executors
TEXT_BYTES = 8 << 20  # text that is taken apart at a time: some 200 MB of numbers
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_lists(docs: DataFrame, doc_id: str, text: str, raw: bool, keep: tuple[str, ...] = (), partitioned: bool = False) -> DataFrame:
    """(doc_id, [kept], texts): the words of all texts of an id, joined by blanks. Null texts are left out."""
    docs = docs.select(doc_id, *keep, text)
    if not partitioned:
        docs = spread(docs, doc_id)
    words = F.array_join(tokens(F.col(text), raw), " ")
    return docs.groupBy(doc_id, *keep).agg(F.collect_list(words).alias("texts"))


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``size`` bytes of text; a longer row is one run."""
    for b in batches:
        texts = b.column("texts")
        ends = np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))
        read = np.cumsum(np.concatenate(([0], pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False))))
        run = read[ends] // size
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else []
        for a, z in zip(starts, [*starts[1:], len(run)]):
            yield b.slice(a, z - a)


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each word."""
    digests = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words)
    pair = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _chained(before: np.ndarray, word: np.ndarray, lane: int) -> np.ndarray:
    """The hash of an n-gram from that of its first words and that of its last."""
    x = before * _MIX[lane] + (word ^ (before >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * _SPREAD[0]
    x = (x ^ (x >> np.uint64(27))) * _SPREAD[1]
    return x ^ (x >> np.uint64(31))


class _Batch:
    """The n-grams of a batch of documents, each a list of texts. ``docs`` counts the documents with a text."""

    def __init__(self, texts: pa.Array):
        self.size = len(texts)
        per_doc = texts.value_lengths().to_numpy(zero_copy_only=False)
        self.docs = int((per_doc > 0).sum())
        split = pc.split_pattern(texts.flatten(), " ")
        flat = split.flatten()
        lengths = split.value_lengths().to_numpy(zero_copy_only=False)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        owner = np.repeat(np.arange(self.size), per_doc)
        coded = flat.dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a text without words is split into one empty one
        self.codes, self.piece = codes[full], piece[full]
        self.doc = owner[self.piece] if len(owner) else self.piece
        self.hashes = _hashes(self.words.to_pylist())

    def orders(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For every n: (number of each n-gram, its document, the different n-grams' two hashes, their words)."""
        spot = np.arange(len(self.codes))  # where the n-grams of this n begin
        gram, first, second, parts = self.codes, self.hashes[0], self.hashes[1], [np.arange(len(self.words))]
        for n in range(1, high + 1):
            if n > 1:
                inside = spot + n - 1 < len(self.codes)
                inside[inside] = self.piece[spot[inside] + n - 1] == self.piece[spot[inside]]
                spot, gram = spot[inside], gram[inside]
                key = gram * max(len(self.words), 1) + self.codes[spot + n - 1]
                known, gram = np.unique(key, return_inverse=True)
                front, last = known // max(len(self.words), 1), known % max(len(self.words), 1)
                first = _chained(first[front], self.hashes[0][last], 0)
                second = _chained(second[front], self.hashes[1][last], 1)
                parts = [p[front] for p in parts] + [last]
            if n >= low:
                yield gram, self.doc[spot], first, second, parts

    def named(self, parts: list[np.ndarray]) -> pa.Array:
        """The texts of n-grams."""
        return pc.binary_join_element_wise(*[self.words.take(pa.array(p)) for p in parts], " ")


def _counts(gram: np.ndarray, doc: np.ndarray, n: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each of n n-grams, and occurrences."""
    pairs = np.unique(gram * max(docs, 1) + doc)
    return np.bincount(pairs // max(docs, 1), minlength=n), np.bincount(gram, minlength=n)


def _summed(one: np.ndarray, two: np.ndarray, df: np.ndarray, ctf: np.ndarray) -> pd.DataFrame:
    """One row per pair of hashes, counts added."""
    order = np.argsort(one, kind="stable")
    same = one[order][1:] == one[order][:-1]
    if (same & (two[order][1:] != two[order][:-1])).any():  # n-grams that differ in the second hash alone
        order = np.lexsort((two, one))
    one, two = one[order], two[order]
    starts = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    return pd.DataFrame({
        "h1": one[starts].view(np.int64), "h2": two[starts].view(np.int64),
        "df": np.add.reduceat(df[order], starts), "ctf": np.add.reduceat(ctf[order], starts),
    })


def hashed_statistics(lists: DataFrame, low: int, high: int, min_df: int) -> DataFrame:
    """(h1, h2, df, ctf) of n-grams in ``min_df`` documents or more; with both hashes null, the number of documents as ``df``."""
    ranges, size = RANGES * partitions_for(lists), TEXT_BYTES
    schema = pa.schema([("p", pa.int32()), ("docs", pa.int64()), *[(c, pa.binary()) for c in ("h1", "h2", "df", "ctf")]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, size):
            batch = _Batch(b.column("texts"))
            found = [[], [], [], []]
            for gram, doc, first, second, _ in batch.orders(low, high):
                for kept, values in zip(found, (first, second, *_counts(gram, doc, len(first), batch.size))):
                    kept.append(values)
            one, two, df, ctf = (np.concatenate(f) for f in found)
            seen = ctf > 0  # the empty word is no n-gram
            one, two, df, ctf = one[seen], two[seen], df[seen].astype(np.int64), ctf[seen].astype(np.int64)
            place = (one % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            at, starts = np.unique(place[order], return_index=True)
            ends = [*starts[1:], len(order)]
            rows = [[c[order[a:z]].tobytes() for a, z in zip(starts, ends)] for c in (one, two, df, ctf)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *at], pa.int32()), pa.array([batch.docs] + [0] * len(at), pa.int64()), *[pa.array([b"", *r], pa.binary()) for r in rows]],
                schema=schema,
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["p"].iloc[0] < 0:
            return pd.DataFrame({"h1": [None], "h2": [None], "df": [pdf["docs"].sum()], "ctf": [pdf["docs"].sum()]})
        one, two = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("h1", "h2"))
        df, ctf = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("df", "ctf"))
        out = _summed(one, two, df, ctf)
        return out[out["df"] >= min_df]

    parts = lists.select("texts").mapInArrow(count, "p int, docs long, h1 binary, h2 binary, df binary, ctf binary")
    return parts.groupBy("p").applyInPandas(merge, "h1 long, h2 long, df long, ctf long")


class _Wanted:
    """Hashes of wanted n-grams in order, and a value for each."""

    def __init__(self, one: np.ndarray, two: np.ndarray, value: np.ndarray):
        order = np.lexsort((two, one))
        self.one, self.two, self.value = one[order], two[order], value[order]

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each pair of hashes, or -1."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.searchsorted(self.one, one)
        out = np.full(len(one), -1)
        while True:
            hit = np.minimum(at, len(self.one) - 1)
            equal = (at < len(self.one)) & (self.one[hit] == one)
            right = equal & (self.two[hit] == two)
            out[right] = hit[right]
            more = equal & ~right & (out < 0)  # the first hash alone is equal
            if not more.any():
                return out
            at = np.where(more, at + 1, len(self.one))


def named_terms(lists: DataFrame, wanted: DataFrame, low: int, high: int) -> DataFrame:
    """(term, df, ctf) of hashed n-grams, from a second reading of the texts.

    Up to ``SENT`` hashes are sent to the executors; more are joined with the n-grams of every batch.
    """
    few, size = wanted.count() <= SENT, TEXT_BYTES
    shared = None
    if few:
        listed = wanted.select("h1", "h2").toArrow()
        one, two = (listed[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        shared = lists.sparkSession.sparkContext.broadcast(_Wanted(one, two, np.zeros(len(one), bool)))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(len(shared.value.one), bool) if few else None
        for b in _slices(batches, size):
            batch = _Batch(b.column("texts"))
            for gram, _, first, second, parts in batch.orders(low, high):
                here = np.bincount(gram, minlength=len(first)) > 0
                if few:
                    at = shared.value.find(first, second)
                    here &= (at >= 0) & ~told[at]
                    told[at[here]] = True
                columns = [pa.array(h[here].view(np.int64)) for h in (first, second)]
                yield pa.RecordBatch.from_arrays([*columns, batch.named([p[here] for p in parts])], names=["h1", "h2", "term"])

    found = lists.select("texts").mapInArrow(name, "h1 long, h2 long, term string")
    return found.join(wanted, ["h1", "h2"]).groupBy("h1", "h2", "df", "ctf").agg(F.min("term").alias("term")).select("term", "df", "ctf")


def known_terms(lists: DataFrame, vocab: DataFrame, low: int, high: int) -> DataFrame:
    """``lists`` with (idx, tf) in place of the texts: a document's known terms and how often each is in it.

    ``vocab`` (term, term_id) goes to the executors as hashes: at most ``SENT`` rows.
    """
    listed = vocab.select("term", "term_id").toArrow()
    words = [t.split(" ") for t in listed["term"].to_pylist()]
    hashes = np.zeros((2, len(words)), np.uint64)
    for n in {len(w) for w in words}:
        rows = np.array([i for i, w in enumerate(words) if len(w) == n])
        one, two = _hashes([words[i][0] for i in rows])
        for k in range(1, n):
            last = _hashes([words[i][k] for i in rows])
            one, two = _chained(one, last[0], 0), _chained(two, last[1], 1)
        hashes[0, rows], hashes[1, rows] = one, two
    shared = lists.sparkSession.sparkContext.broadcast(_Wanted(*hashes, listed["term_id"].to_numpy().astype(np.int32)))
    size = TEXT_BYTES
    others = [f for f in lists.schema.fields if f.name != "texts"]
    schema = T.StructType([*others, T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, size):
            batch = _Batch(b.column("texts"))
            pairs = []
            for gram, doc, first, second, _ in batch.orders(low, high):
                at = shared.value.find(first, second)[gram]
                pairs.append(doc[at >= 0] * len(shared.value.one) + at[at >= 0])
            known, tf = np.unique(np.concatenate(pairs), return_counts=True)
            wide = max(len(shared.value.one), 1)
            places = pa.array(np.searchsorted(known // wide, np.arange(batch.size + 1)), pa.int32())
            lists_of = (pa.ListArray.from_arrays(places, pa.array(v)) for v in (shared.value.value[known % wide], tf.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], *lists_of], names=[*[f.name for f in others], "idx", "tf"])

    return lists.mapInArrow(weigh, schema)
