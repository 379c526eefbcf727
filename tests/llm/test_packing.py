import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelmill.llm.packing import ChunkTokenizer, pack
from reelmill.llm.queries import op2_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check(library, rows, texts, window):
    """Pieces against ids made by the library; no gaps, nothing twice."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = expected(library, texts[doc]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for seq, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or seq == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(library, op2_packing(spark, sf).collect(), texts, 2048)


def test_odd_texts(spark, library):
    from pyspark.sql import functions as F

    texts = {0: None, 1: "", 2: " \n\t ", 3: "a" * 9000, 4: "it's <|endoftext|>x", 5: "x", 6: "x", 7: "ΣΑΣ  é é \U0001f600", 8: "word " * 5000}
    df = spark.createDataFrame([(k, v, 5, b"x") for k, v in texts.items()], "doc_id long, text string, part int, ids binary").repartition(3)
    rows = pack(df, PATH, 64).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(library, rows, texts, 64)
    assert pack(df.limit(0), PATH, 64).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    rows = pack(df, PATH, 4).collect()
    assert sum(r.length for r in rows) == 5 * 3 and max(r.sequence_id for r in rows) == 3


def test_chunks_as_the_library(library):
    rng = random.Random(1)
    own = ChunkTokenizer(library.to_str())
    for alphabet in ("ab'sAé\u0301 \n\t ßΣ1²٣!.<|>endoftx|\x1c\x85\u200bあ\u0130", "abcdefghinorst ABCÉÀÿßÞ×÷ªµº \n\t\x85\xa0\xad12²¼.,!$&#*|<_-\x1c\x00"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
            assert np.frombuffer(own.encode(text), "<u4").tolist() == expected(library, text)[:-1], repr(text)


def test_all_plain_characters(library):
    own = ChunkTokenizer(library.to_str())
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f"É{c}", f" {c} {c}{c}", f"1{c}2"):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == expected(library, text)[:-1], repr(text)
