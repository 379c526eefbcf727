"""Phrase collocations from an FM-index per shard over word numbers.

Texts are lower-cased (A-Z only) and cut into pieces at ``. , ; : ! ?`` and line ends; words are what
lies between blanks and tabs. A task gathers the words of a language into shards of ``SHARD`` words,
with a mark between pieces, and builds the Burrows-Wheeler transform of each shard and of its
reverse, with suffixes in the order of their first words. Every phrase is an interval in both. It is
extended to the right through the reverse index, which keeps both intervals in step, and the
forward index tells the words on its left; so one walk yields phrases up to a depth with their
counts and with the only word that ever stands before or after them, if there is just one. Counts add up across
shards; an only word remains one if all shards name the same.

Three passes keep the sums small. Words are counted first; words that are too rare for any phrase
are marks from then on. The second pass adds up pairs, known by ``PAIR_BITS`` bits of a hash and
packed by ranges of it; the third walks along pairs that are frequent in all shards together. What is
frequent is sent as a table of 2^``MARK_BITS`` bits (8 MB at every size). A rare word or pair that
shares a hash or bit with a frequent one costs work and changes nothing, since phrases are kept by their exact sums.

A phrase that stands in a longer candidate with the same count is dropped. For phrases below the
full depth that is so if and only if a single word always precedes or always follows them: if any
longer phrase around one occurs as often, one that is longer by a word does.

Words are known by 64-bit hashes of language and word; two words of one language with the same hash
would count as one, which for ten million words has a chance of three in a million.

Defined results: a null or empty text has no words; a null lang is ``und``; equal rows count each;
ties in score and count are ordered by the phrase's bytes; other columns are ignored; an empty table gives an empty one. A task
holds ``SHARD`` words and, beyond them, one text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.batches import text_slices
from reelmill.llm.words import FACTOR, mix
from reelmill.session import small_side, store

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a shard, in all languages of a task together.
SHARD = 4 << 20
#: Words that a task remembers or counts before it starts anew.
KEPT = 400_000
#: Bits of the tables of frequent words and pairs, and of the blocks in which they are put together.
MARK_BITS = 26
BLOCK_BITS = 16
#: Bits by which pairs are known while they are looked for, and words of text for each range of them.
PAIR_BITS, RANGE_WORDS = 40, 1 << 20
#: Piece ends become line ends, tabs become blanks.
_CUTS = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n\n\n\n\n\n\n\n\n\n ")
BREAK = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, ``BREAK`` between pieces; empty ones mean nothing."""
    return text.lower().translate(_CUTS).replace(b"\n", b" \n ").split(b" ")


def read_texts(batches):
    """Slices of rows as (lang, text in bytes) pairs."""
    for rows in text_slices(batches):
        yield list(zip(rows.column("lang").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()))


def seed_of(lang: str) -> int:
    """Spark's ``xxhash64(lang, word)`` hashes a word with the language's hash as seed."""
    return xxhash.xxh64_intdigest(lang.encode(), seed=42)


def word_table(texts: DataFrame, least: int) -> DataFrame:
    """lang, word, n of words with ``least`` occurrences, and a row without a word: all occurrences; stored."""

    def packed(found):
        langs, words, n = [], [], []
        for lang, counter in found.items():
            for mark in (b"", BREAK):
                counter.pop(mark, None)
            langs += [lang] * (len(counter) + 1)
            words += [*counter, None]
            n += [*counter.values(), sum(counter.values())]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def count(batches):
        found: dict[str, Counter] = {}
        for rows in read_texts(batches):
            for lang, text in rows:
                found.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, found.values())) > KEPT:
                yield packed(found)
                found = {}
        if found:
            yield packed(found)

    counted = texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return store(counted.where((F.col("n") >= least) | F.col("word").isNull()), "words")


def mark_table(bits: DataFrame) -> np.ndarray:
    """The packed bits whose numbers are in column ``bit``: blocks are made by executors."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << BLOCK_BITS, np.uint8)
        block[pdf["bit"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"block": [int(pdf["bit"].iloc[0]) >> BLOCK_BITS], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    blocks = bits.distinct().groupBy(F.shiftright("bit", BLOCK_BITS)).applyInPandas(pack, "block long, bits binary").toArrow()
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for block, packed in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist()):
        out[block * step : (block + 1) * step] = np.frombuffer(packed, np.uint8)
    return out


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of some hashes are set."""
    bit = (hashes >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(FACTOR) + second)


class Codes(dict):
    """Number of each word in a shard: from 1 for words that are marked, 0 for others and breaks, -1 for none."""

    def __init__(self, lang: str, table: np.ndarray):
        super().__init__()
        self.seed, self.table = seed_of(lang), table
        self.numbers: dict[int, int] = {}

    def __missing__(self, word: bytes) -> int:
        if not word:
            code = -1
        elif word == BREAK:
            code = 0
        else:
            found = xxhash.xxh64_intdigest(word, seed=self.seed)
            bit = found >> (64 - MARK_BITS)
            code = self.numbers.setdefault(found, len(self.numbers) + 1) if self.table[bit >> 3] >> (bit & 7) & 1 else 0
        if len(self) >= KEPT:
            self.clear()
        self[word] = code
        return code

    def hashes(self) -> np.ndarray:
        """Hash of each number; 0 for 0."""
        return np.array([0, *self.numbers], np.uint64)


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of some intervals in a row, and where each interval begins among them."""
    n = hi - lo
    first = np.cumsum(n) - n
    return np.repeat(lo - first, n) + np.arange(int(n.sum())), first


def only(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of symbols the only one in it, or 0."""
    if not len(first):
        return np.zeros(0, symbols.dtype)
    low = np.minimum.reduceat(symbols, first)
    return np.where(low == np.maximum.reduceat(symbols, first), low, 0)


class Transform:
    """Burrows-Wheeler transform of a sequence whose suffixes are in the order of their first ``depth`` words."""

    def __init__(self, s: np.ndarray, depth: int):
        rank, reach = s, 1
        order = np.argsort(s, kind="stable") if depth == 1 else None
        while reach < depth:
            key = rank.astype(np.int64) * (int(rank.max()) + 1)
            key[:-reach] += rank[reach:]
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(len(s), np.int32)
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            reach *= 2
        self.last = s[order - 1]
        #: Places of each word in the transform, words in order: the rank of a place is found by bisection.
        self.places = np.sort(self.last.astype(np.int64) * len(s) + np.arange(len(s)))

    def extended(self, words: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Where the interval of a word and what follows begins, from the interval of what follows."""
        return np.searchsorted(self.places, words * len(self.last) + lo)


def walk(s: np.ndarray, longest: int, neighbours: bool = True):
    """For 2 to ``longest`` words: all phrases in ``s`` (a row each), counts, and the only words before and after.

    ``s`` has word numbers from 1, and 0 where a piece ends. The only words are those of ``s`` (0: a
    piece's end, or several); without ``neighbours`` they are all 0.
    """
    s = np.concatenate(([0], s, [0])).astype(np.int32)
    n_words = int(s.max()) + 1
    ahead, back = Transform(s, longest) if neighbours else None, Transform(s[::-1], longest)
    ends = np.cumsum(np.bincount(s, minlength=n_words))
    lo, back_lo, back_hi = ends[:-1], ends[:-1], ends[1:]
    phrases = np.arange(1, n_words, dtype=np.int32)[:, None]
    at, _ = spans(back_lo, back_hi)
    after = back.last[at]
    for length in range(2, longest + 1):
        owner = np.repeat(np.arange(len(lo)), back_hi - back_lo)
        found, n = np.unique(owner * n_words + after, return_counts=True)
        owner, word = found // n_words, found % n_words
        before = np.cumsum(n) - n
        begin = before[np.searchsorted(owner, np.arange(len(lo)))]  # every phrase has occurrences
        kept = word > 0
        lo = (lo[owner] + before - begin[owner])[kept]
        owner, word, n = owner[kept], word[kept], n[kept]
        phrases = np.concatenate((phrases[owner], word[:, None].astype(np.int32)), axis=1)
        left = right = np.zeros(len(n), np.int32)
        if length < longest or neighbours:
            back_lo = back.extended(word, back_lo[owner])
            back_hi = back_lo + n
            at, first = spans(back_lo, back_hi)
            after = back.last[at]
        if neighbours:
            right = only(after, first)
            at, first = spans(lo, lo + n)
            left = only(ahead.last[at], first)
        yield phrases, n, left, right
        if not len(phrases):
            return


def frequent_runs(s: np.ndarray, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``s`` cut between words whose pair is not marked; single words are left out."""
    apart = ~((s[:-1] > 0) & (s[1:] > 0) & marked(table, pair_hashes(hashes[s[:-1]], hashes[s[1:]])))
    run = np.concatenate(([0], np.cumsum(apart)))
    kept = (s > 0) & (np.bincount(run)[run] > 1)
    s, run = s[kept], run[kept]
    cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
    return np.insert(s, cuts, 0)


def gathered(batches, table: np.ndarray):
    """Shards of a task: word hashes by number, and the numbers with 0 between pieces."""
    found: dict[str, tuple[Codes, list]] = {}
    size = 0
    for rows in read_texts(batches):
        for lang, text in rows:
            if lang not in found:
                found[lang] = (Codes(lang, table), [])
            codes, parts = found[lang]
            words = tokens(text)
            s = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
            parts += [s[s >= 0], np.zeros(1, np.int32)]
            size += len(s)
            if size >= SHARD:
                yield from ((codes.hashes(), np.concatenate(parts)) for codes, parts in found.values())
                found, size = {}, 0
        if sum(len(codes) for codes, _ in found.values()) > KEPT:
            for codes, _ in found.values():
                codes.clear()
    yield from ((codes.hashes(), np.concatenate(parts)) for codes, parts in found.values())


def range_bits(total: int) -> int:
    """Leading bits of a hash that tell its range: ranges follow the number of words."""
    return min(max(int(total // RANGE_WORDS).bit_length(), 4), 16)


def frequent_pairs(texts: DataFrame, table, least: int, bits: int) -> DataFrame:
    """``bit``: that of every pair with ``least`` occurrences, and of few others.

    Every shard sends, for each range of the pairs' hashes, what lies in it and how often (up to 255,
    or ``least`` if that is more, which is enough to know). Ranges are added up each in one task.
    """
    low = PAIR_BITS - bits
    counts = np.uint8 if least <= 255 else np.uint32
    most = max(least, 255)

    def count(batches):
        for hashes, s in gathered(batches, table.value):
            if not s.any():
                continue
            phrases, n, _, _ = next(walk(s, 2, neighbours=False))
            key = pair_hashes(hashes[phrases[:, 0]], hashes[phrases[:, 1]]) >> np.uint64(64 - PAIR_BITS)
            order = np.argsort(key)
            key, n = key[order], np.minimum(n[order], most).astype(counts)
            places = np.searchsorted(key >> np.uint64(low), np.arange((1 << bits) + 1))
            rest = (key & np.uint64((1 << low) - 1)).astype(np.uint64 if low > 32 else np.uint32)
            some = np.flatnonzero(np.diff(places))
            packed = [(rest[places[i] : places[i + 1]].tobytes(), n[places[i] : places[i + 1]].tobytes()) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([p for p, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], names=["block", "pairs", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = np.frombuffer(b"".join(pdf["pairs"]), np.uint64 if low > 32 else np.uint32)
        n = np.frombuffer(b"".join(pdf["counts"]), counts)
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        enough = pairs[first][np.add.reduceat(n[order].astype(np.int64), first) >= least].astype(np.int64)
        return pd.DataFrame({"bit": ((int(pdf["block"].iloc[0]) << low) + enough) >> (PAIR_BITS - MARK_BITS)})

    return texts.mapInArrow(count, "block long, pairs binary, counts binary").groupBy("block").applyInPandas(add, "bit long")


def frequent_phrases(texts: DataFrame, table, pairs, least: int, bits: int) -> DataFrame:
    """gram (hashes of its words), a and inside (a longer candidate occurs as often) of phrases with ``least`` occurrences.

    Every shard walks along marked pairs and sends what it finds packed by length and range, with the
    only neighbours of each phrase (0: none or several). Ranges are added up each in one task.
    """
    names = ["block", "length", "words", "n", "before", "after"]

    def indexed(batches):
        for hashes, s in gathered(batches, table.value):
            s = frequent_runs(s, hashes, pairs.value)
            if not s.any():
                continue
            for phrases, n, left, right in walk(s, LONGEST):
                length = phrases.shape[1]
                if length == LONGEST:  # nothing longer is a candidate
                    left, right = np.zeros_like(left), np.zeros_like(right)
                words = hashes[phrases]
                key = np.zeros(len(words), np.uint64)
                for i in range(length):
                    key = pair_hashes(key, words[:, i])
                block = key >> np.uint64(64 - bits)
                order = np.argsort(block, kind="stable")
                places = np.searchsorted(block[order], np.arange((1 << bits) + 1))
                columns = (words[order], n[order].astype(np.int64), hashes[left[order]], hashes[right[order]])
                some = np.flatnonzero(np.diff(places))
                packed = [[c[places[i] : places[i + 1]].tobytes() for i in some] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([length] * len(some), pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], names=names)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        length = int(pdf["length"].iloc[0])
        words = np.frombuffer(b"".join(pdf["words"]), np.int64).reshape(-1, length)
        n, before, after = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in names[3:])
        order = np.lexsort(words.T)
        words = words[order]
        first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1))))
        a = np.add.reduceat(n[order], first)
        inside = (only(before[order], first) != 0) | (only(after[order], first) != 0)
        enough = a >= least
        return pd.DataFrame({"gram": pd.Series(words[first][enough].tolist(), dtype=object), "a": a[enough], "inside": inside[enough]})

    packed = texts.mapInArrow(indexed, "block long, length long, words binary, n binary, before binary, after binary")
    return packed.groupBy("block", "length").applyInPandas(add, "gram array<long>, a long, inside boolean")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to five words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = word_table(texts, least)
    words = table.where("word is not null").withColumn("h", F.xxhash64("lang", "word"))
    totals = table.where("word is null").select("lang", F.col("n").alias("total"))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    frequent = spark.sparkContext.broadcast(mark_table(words.select(F.shiftrightunsigned("h", 64 - MARK_BITS).alias("bit"))))
    bits = range_bits(total)
    along = spark.sparkContext.broadcast(mark_table(frequent_pairs(texts, frequent, least, bits)))
    grams = store(frequent_phrases(texts, frequent, along, least, bits), "phrases")
    return ranked(grams, words, totals, top)


def ranked(grams: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores of the phrases that are not inside others, by their weakest cut, and the first of each language."""
    counts = small_side(grams.select("gram", F.col("a").alias("c")).unionByName(words.select(F.array("h").alias("gram"), F.col("n").alias("c"))))
    left, right = (counts.withColumnsRenamed({"gram": name, "c": c}) for name, c in (("head", "l"), ("tail", "r")))
    kept = grams.where("not inside").select("gram", "a")
    named = kept.select("gram", F.posexplode("gram").alias("i", "h")).join(small_side(words.select("h", "lang", "word")), "h")
    named = named.groupBy("gram").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    cuts = kept.select("gram", "a", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("slice(gram, 1, k)")).withColumn("tail", F.expr("slice(gram, k + 1, size(gram) - k)"))
    cuts = cuts.join(left, "head").join(right, "tail").join(named, "gram").join(F.broadcast(totals.withColumnRenamed("total", "n")), "lang")
    # 17 digits each: the products fit in 38.
    wide = {c: f"cast({c} as decimal(17, 0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    rows = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
