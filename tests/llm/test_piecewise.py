import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.llm import piecewise as pw
from reelmill.llm.queries import op4_piecewise


def slow_fingerprint(text: bytes) -> str:
    """The same definition, byte by byte."""
    n = len(text)
    if not n:
        return "3::"
    hashes = []
    for i in range(n):
        window = [text[i - a] if i - a >= 0 else 0 for a in range(7)]
        total = sum(window) + sum(c * (7 - a) for a, c in enumerate(window))
        mixed = 0
        for a, c in enumerate(window):
            mixed ^= c << (5 * a) & 0xFFFFFFFF
        hashes.append((total + mixed) & 0xFFFFFFFF)

    def ends(size):
        at = [i for i, h in enumerate(hashes) if (h + 1) % size == 0]
        return at if at and at[-1] == n - 1 else at + [n - 1]

    def letters(at):
        if len(at) > 64:
            at = at[:63] + at[-1:]
        out, start = "", 0
        for end in at:
            value = 0
            for i, c in enumerate(text[start : end + 1]):
                value += (c + 1) * pow(pw.FACTOR, i, 1 << 64)
            value %= 1 << 64
            value = (value ^ (value >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
            out += chr(pw.ALPHABET[value >> 58])
            start = end + 1
        return out

    size = 3
    while size * 64 < n:
        size *= 2
    while size > 3 and len(ends(size)) < 32:
        size //= 2
    return f"{size}:{letters(ends(size))}:{letters(ends(2 * size))}"


def test_as_byte_by_byte():
    rng = random.Random(7)
    make = pw.Piecewise()
    for n in [0, 1, 2, 6, 7, 8, 50, 191, 192, 193, 500, 2000, 5000]:
        for alphabet in (b"ab", bytes(range(256)), b"the quick brown fox "):
            text = bytes(rng.choice(alphabet) for _ in range(n))
            assert make.fingerprint(text) == slow_fingerprint(text)
    assert make.fingerprint(b"a" * 3000) == slow_fingerprint(b"a" * 3000)


def test_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABCD") for _ in range(rng.randint(1, 64))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert pw.common_length(a, b) == table[-1, -1]


def brute(rows):
    rows = sorted(rows)
    make, out = pw.Piecewise(), {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other = make.fingerprint(text.encode()), make.fingerprint(edited.encode())
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, pw.likeness(own, other), pw.likeness(own, make.fingerprint(after.encode())))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op4_piecewise(spark, sf).collect()}
    assert got == brute(texts)
    near = np.mean([v[4] for v in got.values()])
    unlike = np.mean([v[5] for v in got.values()])
    assert near > 0.4 and unlike < 0.1


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_ranges_do_not_matter(spark, ranges):
    texts = [(i * i, "x" * (i % 9) + chr(200 + i) * (i % 50) + "\U0001f600") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert {r.doc_id: tuple(r)[1:] for r in pw.fingerprints(df, ranges).collect()} == brute(texts)


@pytest.mark.parametrize("ranges, null_ranges", [(1, 1), (6, 3), (40, 7)])
def test_rows_of_one_id_and_of_none_are_cut_by_hash(spark, ranges, null_ranges):
    ids = [None] * 60 + [7] * 90 + [7 + i for i in range(1, 30)] + [1, 2, 3]
    df = spark.createDataFrame([(d, f"{i} " + "text " * (i % 40)) for i, d in enumerate(ids)], "doc_id long, text string").repartition(5)
    order = df.withColumn("hash", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text").collect()
    make = pw.Piecewise()
    expected = []
    for i, r in enumerate(order):
        after = order[(i + 1) % len(order)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        expected.append((str(r.doc_id), hashlib.sha256(edited.encode()).hexdigest(), make.fingerprint(r.text.encode())))
    got = pw.fingerprints(df, ranges, null_ranges).collect()
    assert sorted((str(r.doc_id), r.edited_sha256, r.fingerprint) for r in got) == sorted(expected)
    if ranges > 1:
        sizes = {(r["range"], r["doc_id"]): r["count"] for r in pw.with_successors(df, ranges, null_ranges).where("not borrowed").groupBy("range", "doc_id").count().collect()}
        assert sum(d is None for _, d in sizes) == null_ranges and sum(d == 7 for _, d in sizes) > 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, None, 2), (5, None, 3), (5, "b", 4), (5, "b", 4)], "doc_id long, text string, range int")
    rows = pw.fingerprints(df, 4).collect()
    assert len(rows) == 5 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert pw.fingerprints(df.limit(0)).count() == 0
    alone = pw.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
