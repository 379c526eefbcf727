import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from reelmill.llm import contexts, divergence, near_copies

SF = "/root/testdata/sf0.01"


def stages(spark, docs, names):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            docs = stage(spark, docs, SF).cache()
            out[name] = docs
    return out


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = stages(spark, docs, [n for n, _ in corpus_pipeline.STAGES])
    rows = {n: df.collect() for n, df in got.items()}
    for name in ("quality_classifier", "quality_rules", "near_copies", "personal_data"):
        assert got[name].columns == docs.columns and got[name].dtypes == docs.dtypes
    before = docs.collect()
    good = {r.doc_id for r in before if labels.get(r.doc_id) == 1}
    bad = {r.doc_id for r in before if labels.get(r.doc_id) == 0}
    first = {r.doc_id for r in rows["quality_classifier"]}
    assert len(good & first) >= 0.98 * len(good) and len(bad & first) <= 0.1 * len(bad)
    # Each further stage as its operator on what the one before kept.
    verdict = {r.doc_id: r.kept for r in divergence.rules(got["quality_classifier"]).collect()}
    assert {r.doc_id for r in rows["quality_rules"]} == {d for d, k in verdict.items() if k}
    keepers = {r.doc_id for r in near_copies.near_classes(got["quality_rules"]).where("keeper").collect()}
    assert {r.doc_id for r in rows["near_copies"]} == keepers
    texts = {r.doc_id: r.text for r in rows["near_copies"]}
    found = {r.doc_id: r.findings for r in contexts.find(got["near_copies"]).collect()}
    clean = {r.doc_id: r for r in rows["personal_data"]}
    assert set(clean) == set(texts)
    for doc, text in texts.items():
        out, at = "", 0
        for f in sorted(found[doc], key=lambda f: (f.start, f.end)):
            if f.start >= at:
                out, at = out + text[at : f.start] + f"<{f.kind.upper()}>", f.end
            at = max(at, f.end)
        assert clean[doc].text == out + text[at:] and clean[doc].n_chars == len(clean[doc].text)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for p in rows["packing"]:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(clean)
    for doc, parts in pieces.items():
        ids = library.encode(clean[doc].text, add_special_tokens=False).ids + [1]
        joined = b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start))
        assert np.frombuffer(joined, "<u4").tolist() == ids


def test_run_is_the_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    def key(df):
        return sorted((r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in df.collect())
    assert sum(r[2] for r in key(corpus_pipeline.run(spark, sf))) == sum(r[2] for r in key(docs))


def test_odd_rows_go_through(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long_text = " ".join(f"word{i} the" for i in range(400))
    rows = [(1, long_text, "en", "s", 5, 1), (1, long_text, "en", "s", 5, 1), (2, "BAD!! " * 200, None, None, None, 2), (None, long_text, "en", None, 1, 3), (None, None, None, None, None, 4), (4, "", "xx", "s", 0, 5), (5, "y" * 100000, "de", "s", 1, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _n int")
    for start in (df, df.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            if name != "packing":
                assert docs.columns == df.columns
        docs.collect()


def test_one_of_each_with_repeated_and_nameless_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + "."), (3, "other words here"), (None, text), (None, "nobody"), (None, "nobody")]
    kept = near_copies.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[:6]) for r in kept) == [(0, "nobody"), (1, text[:6]), (3, "other ")]


def test_clashing_names_go_through(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["_score", "__score", "score", "_key", "__key", "__found", "__n", "_n", "_chars", "label", "kept"]
    rows = [(1, " ".join(f"word{i} the" for i in range(400)), "en", "s", 5, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns
        assert [tuple(r)[5:] for r in docs.collect()] == [tuple(names)], name


def test_copies_that_share_no_band_go(spark):
    """Texts and copies that differ in one word of 50: shingles are alike by 41 / 51, so a few of the pairs share no band."""
    rows = []
    for i in range(600):
        words = [f"a{i}x{j}" for j in range(50)]
        rows += [(i, " ".join(words)), (600 + i, " ".join([*words[:20], f"b{i}", *words[21:]]))]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert {r.doc_id for r in kept} == set(range(600))
