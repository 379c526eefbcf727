import math
import re
from collections import Counter

import numpy as np
import pytest

from reelmill.llm import divergence as dv
from reelmill.llm.queries import op3_divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base counts, one text at a time."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def histograms(text, lang):
    blank = len(re.findall(r"[\x20\x09-\x0D]", text))
    kinds = [blank, *(len(re.findall(p, re.sub(r"[\x20\x09-\x0D]", "", text))) for p in dv.KINDS.values())]
    kinds.append(len(text) - sum(kinds))
    words = [w.lower().strip(dv.TRIMMED) for w in WORD.findall(text)]
    listed = dv.COMMON.get(lang)
    commons = None if listed is None else [words.count(c) for c in listed] + [sum(w not in listed for w in words)]
    return kinds, commons


def js(p, q):
    p, q = np.asarray(p, float) / sum(p), np.asarray(q, float)
    m = (p + q) / 2
    with np.errstate(all="ignore"):
        return math.sqrt(max(0.0, (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum() / 2))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_divergence(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id].text)
    # References by hand: medians over the documents that pass.
    counted = {r.doc_id: histograms(docs[r.doc_id].text, docs[r.doc_id].lang) for r in rows}
    for lang in {d.lang for d in docs.values()}:
        passed = [r.doc_id for r in rows if docs[r.doc_id].lang == lang and not r.base_failed]
        refs = []
        for side in (0, 1):
            shares = np.asarray([np.asarray(counted[i][side]) / sum(counted[i][side]) for i in passed])
            middle = np.median(shares, axis=0)
            refs.append(middle / middle.sum())
        for r in rows:
            if docs[r.doc_id].lang == lang and r.n_words:
                for side, got in ((0, r.kind_distance), (1, r.word_distance)):
                    if got is not None:
                        assert got == pytest.approx(js(counted[r.doc_id][side], refs[side]), abs=0.02)
    for r in rows:
        far = any(d is not None and d > a + b / math.sqrt(max(1, r.n_words)) for d, (a, b) in ((r.kind_distance, dv.KIND_LIMIT), (r.word_distance, dv.WORD_LIMIT)))
        assert r.kept == (not r.base_failed and not far)


def test_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.1"
    rows = op3_divergence(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.999 and sum(bad) / len(bad) < 0.1


def test_odd_rows(spark):
    texts = [None, "", " \t\n\v\f\r ", "a b c a b c", "x " * 3000, "line\nline\n \n\nline\n", "é \x00   \U0001f600 #*$%&|<>", "a b", "one two three one two three one two", "a " * 49 + "a", "\x1c \x85 \xa0"]
    df = spark.createDataFrame([(i, t, lang, 1, 2) for i, t in enumerate(texts) for lang in ("en", None, "xx")], "doc_id long, text string, lang string, kept int, n_words int")
    rows = dv.rules(df).collect()
    assert len(rows) == 3 * len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept is not None
    assert dv.rules(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op3_divergence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_verdicts_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, *others = (sorted((r.doc_id, r.kept, r.kind_distance, r.word_distance) for r in dv.rules(df.repartition(n)).collect()) for n in (1, 7, 40))
    assert all(x == first for x in others)


def test_own_columns_keep_their_values(spark):
    df = spark.createDataFrame([(1, "word " * 10 + "other words here " * 30, "en", "a", "b", "c")], "doc_id long, text string, lang string, _key string, __key string, _lang string")
    out = dv.accepted(df)
    assert out.columns == df.columns and [tuple(r)[3:] for r in out.collect()] in ([], [("a", "b", "c")])
