import re

import pytest
from pyspark.sql import functions as F

from reelmill.functions.scoring import snippet, stars
from reelmill.functions.text import clean_text, ngrams, normalize_title, tokens, word_count
from reelmill.operators import profiles, reviews, tfidf
from reelmill.params import ENGLISH_STOP_WORDS, FIRST, NEGATIONS, SECOND


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(expression).collect()]


def test_clean_text_order_and_phrases(spark):
    rows = ["A <b>MUST</b> see!", "must see http://x.y/z?q=1 now", "not worthy", "It's 10/10 été", "<a\nb>", "", "http://a too long"]
    assert values(spark, rows, clean_text(F.col("t"))) == [
        "a must see", "mustsee now", "notworthfilmy", "it's t", "a b", "", "toolongfilm",
    ]


def test_word_count_of_empty_text(spark):
    assert values(spark, ["", "a", "a b"], word_count(F.col("t"))) == [0, 1, 2]


def test_tokens_follow_the_word_pattern(spark):
    rows = ["don't rock'n' a 'tis zz", "café l'été naïve plain", "x_y a1b “quoted” —dash"]
    expected = [
        [w for w in re.findall(r"(?u)\b[a-zA-Z'][a-zA-Z']{1,}\b", t.lower()) if w not in set(ENGLISH_STOP_WORDS) - set(NEGATIONS)]
        for t in rows
    ]
    assert values(spark, rows, tokens(F.col("t"), raw=True)) == expected


def test_ngrams(spark):
    grams = F.filter(ngrams(F.split("t", " ")), lambda g: g.isNotNull())
    got = values(spark, ["a b c d", "a"], grams)
    assert sorted(got[0]) == sorted(["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"])
    assert got[1] == ["a"]


def test_titles(spark):
    rows = ["The X (1999)", "X (II)", "É"]
    assert values(spark, rows, normalize_title(F.col("t"))) == ["thex", "xii", ""]
    assert values(spark, rows, normalize_title(F.col("t"), True)) == ["thex", "x", ""]


def test_stars_round_half_to_even(spark):
    rows = [str(x) for x in (1, 3, 5, 7, 10)]
    assert [s.count("⭐") for s in values(spark, rows, stars(F.col("t")))] == [0, 2, 2, 4, 5]
    assert values(spark, ["abc", "abcd"], snippet(F.col("t"), 3)) == ["abc", "abc..."]


def test_canonical_and_coerced(spark):
    df = spark.createDataFrame(
        [(1, None, "fine", "7", "true"), (2, "a", "b", "x", "1"), (3, "a", None, "NaN", "0"), (4, "kept", "b", " 8.5 ", "2.9")],
        "Id long, Review string, TEXT string, Score string, spoiler string",
    )
    out = reviews.coerce_reviews(reviews.canonical_columns(df)).orderBy("id").collect()
    assert [(r["id"], r["review_detail"], r["rating"], r["spoiler_tag"]) for r in out] == [(1, "fine", 7.0, 0), (4, "kept", 8.5, 2)]
    with pytest.raises(KeyError):
        reviews.coerce_reviews(spark.createDataFrame([(1,)], "rating int"))
    flags = spark.createDataFrame([(7, "t", True)], "rating int, text string, is_spoiler boolean")
    assert reviews.coerce_reviews(reviews.canonical_columns(flags)).first()["spoiler_tag"] == 1


def test_empty_title_keys_match_nothing(spark):
    catalogue = spark.createDataFrame([("t", "movie", "É", None, "1999"), ("u", "movie", "Good", "Bon", "x"), ("v", "short", "Ok", "Ok", "2000")],
                                      "tconst string, titleType string, primaryTitle string, originalTitle string, startYear string")
    rows = spark.createDataFrame([("È",), ("OK (2000)",), ("Good",), (None,)], "item string")
    assert [r[0] for r in reviews.filter_by_catalogue(rows, catalogue).collect()] == ["OK (2000)"]


def test_vocabulary_limits_and_cap(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i < 3 else "alpha gamma gamma") for i in range(6)] + [(9, "")], "review_id long, clean_text string")
    counts = tfidf.term_counts(docs, "review_id", ngram_range=(1, 1))
    full = {r["term"]: (r["df"], r["ctf"]) for r in tfidf.fit_tfidf(counts, 10, 1, 1.0).collect()}
    assert full == {"alpha": (6, 6), "beta": (3, 3), "gamma": (3, 6)}
    assert {r["term"] for r in tfidf.fit_tfidf(counts, 10, 1, 0.8).collect()} == {"beta", "gamma"}  # 6 of 7 is above
    assert [r["term"] for r in tfidf.fit_tfidf(counts, 1, 1, 1.0).collect()] == ["alpha"]  # tie goes by term
    assert [r["term"] for r in tfidf.fit_tfidf(counts, 2, 1, 1.0).orderBy("term_id").collect()] == ["alpha", "gamma"]


def test_tfidf_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb")], "review_id long, clean_text string")
    counts = tfidf.term_counts(docs, "review_id", ngram_range=(1, 1))
    vocab = tfidf.fit_tfidf(counts, 10, 1, 1.0)
    got = {(r["review_id"], r["term_id"]): r["weight"] for r in tfidf.weigh(counts, vocab, "review_id").collect()}
    a, b = (1 + math.log(2)) * (math.log(3 / 2) + 1), 1.0
    assert got[(1, 0)] == pytest.approx(a / math.hypot(a, b)) and got[(1, 1)] == pytest.approx(b / math.hypot(a, b))
    assert got[(2, 1)] == pytest.approx(1.0)


def test_item_texts_in_parts_are_whole(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold", f"w{i}") for i in range(300)], "review_id long, item string, clean_text string")
    one = {r["item"]: r["clean_text"] for r in profiles.item_texts(rows).collect()}
    parts = profiles.item_texts(rows, texts_per_part=20).orderBy("item", "part").collect()
    assert len(parts) > 10 and max(r["n_texts"] for r in parts) < 60
    for item, text in one.items():
        assert " ".join(r["clean_text"] for r in parts if r["item"] == item) == text


def test_configurations():
    assert (FIRST.max_features, SECOND.max_features) == (50_000, 60_000)
    assert SECOND.svd_min_user_rows == 3 and SECOND.year_to == 2021 and len(NEGATIONS) == 23 and len(ENGLISH_STOP_WORDS) == 179


@pytest.mark.parametrize("ranked", [1, 3, 100_000])
def test_terms_that_tie_at_the_cap(spark, monkeypatch, ranked):
    monkeypatch.setattr(tfidf, "RANKED", ranked)
    words = sorted({f"{a}{b}{c}" for a in ("x", "xy", "é", "aa") for b in ("", "b", "bb", "bbb") for c in ("", "q", "z ")})
    rows = [(w, 5, 7) for w in words] + [("first", 9, 90), ("rare", 1, 1)]
    stats = spark.createDataFrame(rows, "term string, df long, ctf long")
    for n in (1, 2, 5, 17, len(words), len(words) + 1):
        got = sorted(r["term"] for r in tfidf.cap_terms(stats, n).collect())
        assert got == sorted(["first", *words[: n - 1]])


def test_numbered_and_uncapped_vocabulary(spark):
    counts = spark.createDataFrame([(d, f"t{i % 40}", 1) for d in range(9) for i in range(d, 40)] + [(d, "", 1) for d in range(9)], "doc_id long, term string, tf long").distinct()
    rows = tfidf.fit_tfidf(counts, None, 1, 1.0).collect()
    assert [r["term"] for r in sorted(rows, key=lambda r: r["term_id"])] == sorted(r["term"] for r in rows) and len(rows) == 40
    assert sorted(r["term_id"] for r in rows) == list(range(40))
