"""N-grams as numbers against n-grams as rows, and the cleaning pattern against the published one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions import text as TX
from reelmill.operators import grams, tfidf
from reelmill.operators.reviews import clean_reviews

DOCS = [
    (1, "a", "red fish blue fish red fish"), (2, "a", "red fish blue bird"), (3, "b", "blue bird red fish"), (3, "b", "red fish"),
    (3, "c", "blue bird"), (None, "a", "red fish blue"), (None, "b", "bird red"), (4, "a", None), (5, "a", ""), (6, None, "the and of"),
    (7, "a", "one"), (8, "b", "fish red"), (9, "b", "it's 'red fish' -- x yy"), (10, "a", "red  fish blue bird red fish"), (1, "a", "fish"),
]


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, item string, clean_text string")


@pytest.mark.parametrize("sent", [grams.SENT, 0])
@pytest.mark.parametrize("cap, min_df, span, raw", [(None, 1, (1, 3), False), (5, 1, (1, 3), False), (4, 2, (2, 2), False), (50, 3, (1, 1), True), (3, 9, (1, 3), False)])
def test_vocabulary_of_documents_is_that_of_counts(spark, docs, monkeypatch, sent, cap, min_df, span, raw):
    monkeypatch.setattr(grams, "SENT", sent)
    counts = tfidf.term_counts(docs, ngram_range=span, raw=raw)
    assert rows(tfidf.fit_documents(docs, "doc_id", "clean_text", span, raw, cap, min_df, 0.9)) == rows(tfidf.fit_tfidf(counts, cap, min_df, 0.9))


@pytest.mark.parametrize("sent, size", [(grams.SENT, grams.TEXT_BYTES), (grams.SENT, 8), (0, 8)])
def test_weights_of_documents_are_those_of_counts(spark, docs, monkeypatch, sent, size):
    vocab = tfidf.fit_tfidf(tfidf.term_counts(docs), 12, 1, 0.9)
    want = tfidf.weigh(tfidf.term_counts(docs, keep=("item",)), vocab, "doc_id", ("item",))
    monkeypatch.setattr(grams, "SENT", sent)
    monkeypatch.setattr(grams, "TEXT_BYTES", size)
    assert rows(tfidf.fit_documents(docs, max_features=12, min_df=1)) == rows(vocab)
    assert rows(tfidf.transform_tfidf(docs, vocab, keep=("item",))) == rows(want)
    empty = docs.limit(0)
    assert tfidf.transform_tfidf(empty, vocab).count() == 0 and tfidf.fit_documents(empty).count() == 0
    assert tfidf.transform_tfidf(docs, vocab.limit(0)).count() == 0


def test_terms_are_no_rows_before_the_vocabulary_is_known(spark, docs):
    """The plan made a row for each of a document's terms, known or not, and shuffled and sorted them."""
    vocab = tfidf.fit_tfidf(tfidf.term_counts(docs), 12, 1, 0.9)
    plan = tfidf.transform_tfidf(docs, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "concat(" not in plan


def test_equal_first_hashes_stay_apart():
    one, two = np.array([7, 7, 7, 9], np.uint64), np.array([2, 1, 2, 1], np.uint64)
    got = grams._summed(one, two, np.array([1, 10, 100, 5]), np.array([2, 20, 200, 6]))
    assert got.values.tolist() == [[7, 1, 10, 20], [7, 2, 101, 202], [9, 1, 5, 6]]
    wanted = grams._Wanted(one[[0, 1, 3]], two[[0, 1, 3]], np.arange(3))
    assert wanted.find(np.array([7, 7, 7, 9, 10, 1], np.uint64), np.array([1, 2, 3, 1, 1, 1], np.uint64)).tolist() == [0, 1, -1, 2, -1, -1]


def test_cleaning_takes_words_out(spark):
    odd = [None, "", " ", "--", "It's GOOD. Not\tworth 3 Kelvin İstanbul café 'x' <br/> https://a.b/c well done!", "a" * 50 + " 1 " + "B'"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    text = TX.collapse_phrases(TX.collapse_phrases(F.regexp_replace(F.regexp_replace(F.lower("t"), TX.TAG, " "), TX.ADDRESS, " "), TX.POSITIVE_PHRASES), TX.NEGATIVE_PHRASES)
    published = F.trim(F.regexp_replace(text, r"[^a-zA-Z']+", " "))
    found = df.select(TX.clean_text(F.col("t")).alias("got"), published.alias("want")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]
    # looking for runs that are no word took nearly all of the time of a review's cleaning
    plan = clean_reviews(df.withColumnRenamed("t", "review"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-zA-Z']+" not in plan
