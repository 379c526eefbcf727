import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelmill.llm.bpe import Bpe, encode_decode
from reelmill.llm.queries import op8_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own(library):
    return Bpe(library.to_str())


def ids_of(own, text):
    return np.frombuffer(own.encode([text])[0], "<i4").tolist()


def test_as_the_library(library, own):
    rng = random.Random(3)
    alphabet = "abcdefthein   '\n\tsÉßΣ²٣!.-<|\x1c\x85​　あ\U0001f600é"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        text += rng.choice(["", "", "", "<|endoftext|>", "it's we'll  "])
        assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(own.encode([text])[0]) == text


def test_long_words_and_ties(library, own):
    rng = random.Random(4)
    for text in ("a" * 5000, "ab" * 3000, "!" * 4097, "".join(rng.choice("etaoinsh") for _ in range(20000)), "a" * 64, "a" * 65, " " * 300, "é" * 500):
        assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids


def test_one_tree_and_many_agree(own):
    rng = random.Random(5)
    words = [bytes(rng.choice(b"thereinonat ") for _ in range(rng.randint(1, 32))) for _ in range(500)]
    ids, n = own.merge_many(words, 32)
    assert ids.tolist() == [i for w in words for i in own.merge_long(w)] and n.sum() == len(ids)


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (None, "a b", 9), (2, "", 8)], "doc_id long, text string, n_tokens int")
    rows = sorted(((r.doc_id or 0, r.n_tokens, list(r.ids), r.decoded) for r in encode_decode(df, PATH).collect()))
    assert rows[1:] == [(1, 0, [], ""), (2, 0, [], ""), (2, 0, [], "")] and rows[0][3] == "a b"
    assert encode_decode(df.limit(0), PATH).count() == 0
