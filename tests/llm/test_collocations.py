from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import canonical, connect, same
from reelmill.llm import collocations as C
from reelmill.llm.queries import ORACLE, op11_collocations

SF = "/root/testdata/sf0.001"


def by_counting(rows, least):
    """lang -> the rows of the contract, all phrases counted one by one."""
    counts, total = defaultdict(Counter), Counter()
    cuts = str.maketrans(".,;:!?\n\x0b\x0c\r", "\n" * 10)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in lowered.translate(cuts).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = [g for g, a in f.items() if a >= least and len(g) > 1]
        inside = {q[i : i + m] for q in candidates for m in range(2, len(q)) for i in range(len(q) - m + 1) if f[q] >= f[q[i : i + m]]}
        scored = []
        for g in set(candidates) - inside:
            score, k = min((1000 * f[g] * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored), 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_walk_finds_all_phrases_and_neighbours(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 5, 150).astype(np.int32)
    marked = [0, *s.tolist(), 0]
    counts, left, right = Counter(), defaultdict(set), defaultdict(set)
    for k in range(2, 6):
        for i in range(1, len(marked) - k):
            g = tuple(marked[i : i + k])
            if 0 not in g:
                counts[g] += 1
                left[g].add(marked[i - 1])
                right[g].add(marked[i + k])
    only = lambda x: next(iter(x)) if len(x) == 1 else 0
    got = {tuple(g.tolist()): (int(n), int(a), int(b)) for found in C.walk(s, 5) for g, n, a, b in zip(*found)}
    assert got == {g: (n, only(left[g]), only(right[g])) for g, n in counts.items()}


def test_runs_keep_marked_pairs():
    table = np.zeros(1 << (C.MARK_BITS - 3), np.uint8)
    hashes = C.mix(np.arange(6, dtype=np.uint64))
    for a, b in ((1, 2), (2, 3), (4, 5)):
        bit = int(C.pair_hashes(hashes[a : a + 1], hashes[b : b + 1])[0]) >> (64 - C.MARK_BITS)
        table[bit >> 3] |= 1 << (bit & 7)
    s = np.array([1, 2, 3, 1, 2, 3, 0, 4, 5, 0, 1, 2], np.int32)
    assert C.frequent_runs(s, hashes, table).tolist() == [1, 2, 3, 0, 1, 2, 3, 0, 4, 5, 0, 1, 2]


def test_spark_and_python_hash_alike(spark):
    for word in ("a", "réeux", "x" * 70):
        assert spark.range(1).select(F.xxhash64(F.lit("fr"), F.lit(word))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(word.encode(), seed=C.seed_of("fr"))


@pytest.mark.parametrize("shard", [C.SHARD, 50])
def test_against_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    rng = np.random.default_rng(1)
    words = ["the", "OF", "a", "red", "blue", "É", "x1", "-"]
    rows = [(("en", "fr", None)[i % 3], " ".join(rng.choice(words, 40)) + ".\n" + "once upon a time so long ago, " * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert {tuple(r) for r in C.collocations(df, least=8).collect()} == by_counting(rows, 8)


def test_same_as_sql(spark):
    df = op11_collocations(spark, "/root/testdata/sf0.01")
    cursor = connect("/root/testdata/sf0.01").execute(ORACLE["op11_collocations"])
    expected, names = cursor.fetchall(), [d[0] for d in cursor.description]
    assert names == df.columns
    rows = [tuple(r) for r in df.collect()]
    assert rows and same(canonical(rows, names), canonical(expected, names)) == ""


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame([([1, 2], 3_000_000_000_000, False)], "gram array<long>, a long, inside boolean")
    words = spark.createDataFrame([(1, "en", "x", 4_000_000_000_001), (2, "en", "y", 5_000_000_000_003)], "h long, lang string, word string, n long")
    total = 90_000_000_000_000
    row = C.ranked(grams, words, spark.createDataFrame([("en", total)], "lang string, total long"), 10).first()
    assert row.score == 1000 * 3_000_000_000_000 * total // (4_000_000_000_001 * 5_000_000_000_003)


def test_odd_rows(spark):
    long_text = "again and again " * 30_000
    rows = [(None, None, 1, 1), ("en", "", 2, 2), ("en", long_text, 3, 3), ("en", " \t . , ", 4, 4), ("und", "a b " * 60, 5, 5), (None, "a b " * 60, 6, 6), ("fr", "é" * 90_000, 7, 7)]
    df = spark.createDataFrame(rows, "lang string, text string, n long, h long")
    got = {tuple(r) for r in C.collocations(df).collect()}
    assert got == by_counting([r[:2] for r in rows], 100)
    assert {r[0] for r in got} == {"en", "und"}
    empty = C.collocations(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
