"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold, for each symbol that is still there, the rank of the pair it forms with
its right neighbour; inner nodes hold the least of their children, ties to the left. The root is
therefore the leftmost pair of lowest rank. A merge changes three leaves, and each change climbs to
the root in logarithmic time. Merging ends when the root holds no rank.

Words of up to ``WIDE`` bytes are merged many at a time, one tree per row of a matrix; longer ones
each in a tree of their own. Both give the same ids.

Defined results: a null or empty text has no ids and decodes to an empty text; other columns are
ignored; equal texts have equal ids; an empty table gives an empty one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from reelmill.llm.batches import text_slices, texts

WIDE = 64
#: Words that are merged side by side; bounds the memory of the trees.
ROWS = 1 << 14
#: Words whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Fixed value: the published split of byte-level BPE, white space by its Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level tokenizer read from its published JSON form."""

    def __init__(self, tokenizer_json: str):
        import regex

        spec = json.loads(tokenizer_json)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.symbols: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        added = spec.get("added_tokens") or []
        if spec["pre_tokenizer"].get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added blanks and blank-absorbing special tokens are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.symbols |= {i: t.encode() for t, i in self.added.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(SPLIT).findall
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.pair_rank.setdefault((vocab[a], vocab[b]), rank)
        self.merged = np.asarray([vocab[a + b] for a, b in pairs] or [0], np.int64)
        keys = np.asarray([(a << 32) | b for a, b in self.pair_rank] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.asarray(list(self.pair_rank.values()) or [NONE], np.int64)[order]
        self.known: dict[str, bytes] = {}

    def encode(self, documents: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self._cut(t) for t in documents]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for content, i in self.added.items():
            self.known[content] = np.asarray([i], "<i4").tobytes()
        self._learn(list(set().union(*cut).difference(self.known)))
        known = self.known.__getitem__
        return [b"".join(map(known, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        found = map(self.symbols.__getitem__, np.frombuffer(ids, "<i4").tolist())
        return b"".join(found).decode("utf-8", "replace")

    def _cut(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words(text[at:])

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in new]
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if len(w) > WIDE:
                self.known[new[i]] = np.asarray(self.merge_long(w), "<i4").tobytes()
            else:
                groups.setdefault(max(1, len(w) - 1).bit_length(), []).append(i)
        for level, members in groups.items():
            for first in range(0, len(members), ROWS):
                part = members[first : first + ROWS]
                ids, counts = self.merge_many([raw[i] for i in part], 1 << level)
                flat, at = ids.astype("<i4").tobytes(), 0
                for i, n in zip(part, counts.tolist()):
                    self.known[new[i]] = flat[at : at + 4 * n]
                    at += 4 * n

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[spot] == key) & (left >= 0) & (right >= 0), self.ranks[spot], NONE)

    def merge_many(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of up to ``size`` bytes (a power of two), joined, and their counts."""
        n, bits = len(words), size.bit_length()
        flat = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        long_ = np.asarray([len(w) for w in words])[:, None]
        ids = np.full((n, size + 1), -1, np.int64)  # one column more: no neighbour
        ids[:, :size] = np.where(np.arange(size) < long_, self.of_byte[flat], -1)
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        before[:, 0] = size
        tree = np.full((n, 2 * size), NONE, np.int64)
        rank = self._rank(ids[:, :size].ravel(), ids[:, 1:].ravel()).reshape(n, size)
        tree[:, size:] = np.where(rank == NONE, NONE, (rank << bits) | np.arange(size))
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + size
            tree[row, node] = value
            for _ in range(bits - 1):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def leaf_value(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            rank = self._rank(left, right)
            return np.where(rank == NONE, NONE, (rank << bits) | at)

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            root = tree[row, 1]
            at = root & ((1 << bits) - 1)
            gone = after[row, at]
            joined = self.merged[root >> bits]
            ids[row, at], ids[row, gone] = joined, -1
            right = np.minimum(after[row, gone], size)
            after[row, at], before[row, right] = right, at
            put(row, gone, np.full(len(row), NONE))
            put(row, at, leaf_value(joined, ids[row, right], at))
            left = before[row, at]
            has = left < size
            r, l_ = row[has], left[has]
            put(r, l_.copy(), leaf_value(ids[r, l_], joined[has], l_))
            row = row[tree[row, 1] != NONE]
        kept = ids[:, :size]
        return kept[kept >= 0], (kept >= 0).sum(axis=1)

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one word of any length."""
        n = len(word)
        size = 1 << max(1, n - 1).bit_length()
        bits = size.bit_length()
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist() + [-1]
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        none, ranks, merged = int(NONE), self.pair_rank, self.merged.tolist()

        def leaf_value(left: int, right: int, at: int) -> int:
            rank = ranks.get((left, right))
            return none if rank is None else (rank << bits) | at

        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = leaf_value(ids[i], ids[i + 1], i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while (root := tree[1]) != none:
            at = root & ((1 << bits) - 1)
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone] = merged[root >> bits], -1
            after[at], before[right] = right, at
            put(gone, none)
            put(at, leaf_value(ids[at], ids[right], at))
            left = before[at]
            if left >= 0:
                put(left, leaf_value(ids[left], ids[at], left))
        return [i for i in ids if i >= 0]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_tokens", LongType()),
        StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType()),
    ])

    def code(batches):
        bpe = Bpe(shared.value)
        for rows in text_slices(batches):
            ids = bpe.encode(texts(rows.column("text")))
            n = np.asarray([len(x) // 4 for x in ids], np.int64)
            places = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), listed, decoded], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(code, schema)
