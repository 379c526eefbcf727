import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reelmill.llm import near_copies as nc
from reelmill.llm.components import components
from reelmill.llm.queries import op6_near_copies
from reelmill.llm.words import Powers


def words_of(text):
    return [w.lower() for w in re.findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", text or "")]


def shingles_of(text):
    words = words_of(text)
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else Counter([tuple(words)])


def brute_classes(rows, similarity=0.8):
    """All pairs of different texts by exact weighted Jaccard with exact document frequencies."""
    sets = {d: shingles_of(t) for d, t in rows}
    df = Counter(s for x in sets.values() for s in x)
    n = sum(bool(x) for x in sets.values())
    idf = {s: float(nc.rarity(c, n)) for s, c in df.items()}
    where = {}
    for d, x in sets.items():
        for s in x:
            where.setdefault(s, []).append(d)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)

    raw = {}
    for d, t in rows:
        if not sets[d]:
            join(raw.setdefault(t or "", d), d)
    similar, border = {}, set()
    for a, x in sets.items():
        for b in {d for s in x for d in where[s] if d > a}:
            y = sets[b]
            low = sum(min(x[s], y[s]) * idf[s] for s in x if s in y)
            j = low / (sum(c * idf[s] for s, c in x.items()) + sum(c * idf[s] for s, c in y.items()) - low)
            if j >= similarity - 0.02:
                similar[a, b] = j
            if abs(j - similarity) < 0.02:
                border.add((a, b))
            if j >= similarity:
                join(a, b)
    return {d: root(d) for d in sets}, similar, border


def test_shingles_by_hand():
    texts = ["One two, three four FIVE six", "", "one two", "One two!", "!!", "one two three four five six one two three four five", None]
    s = nc.Shingles(pa.array(texts), Powers())
    assert np.diff(s.places).tolist() == [len(shingles_of(t)) for t in texts]
    assert s.times.sum() == sum(sum(shingles_of(t).values()) for t in texts)
    names = [tuple(x) for x in s.names().tolist()]
    assert names[2] == names[3] and names[1] == names[6] and len(set(names)) == 5


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 48, 300).astype(np.uint64)
    w = rng.uniform(0.5, 5, (2, 300))
    w[1, :200] = w[0, :200]
    jaccard = np.minimum(*w).sum() / np.maximum(*w).sum()
    sampler = nc.Sampler(bands=1, rows=3000)
    got = sampler.samples(np.concatenate([keys, keys]), np.concatenate(w), np.asarray([0, 300, 600]))
    assert abs((got[0] == got[1]).mean() - jaccard) < 0.03


def test_exact_similarity():
    idf = np.full(nc.COUNTERS, 1.5, np.float32)
    def packed(d):
        return np.asarray(sorted(d), np.uint64).tobytes(), np.asarray([d[k] for k in sorted(d)], np.uint32).tobytes()
    assert nc.weighted_jaccard(*packed({1: 2, 5: 1, 9: 4}), *packed({5: 3, 9: 1, 70: 1}), idf) == pytest.approx(2 / (2 + 3 + 4 + 1))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 60)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == 100 and all(got[500 + i] == 500 for i in range(60))


def made(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, doc = [], 0
    for g in range(groups):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200, 400]))]
        for copy in range(rng.choice([1, 2, 5, 30])):
            other = list(text)
            for _ in range(0 if copy % 3 == 0 else max(1, len(text) // 70)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(other) + rng.choice(["", ".", "\n"])))
            doc += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_classes_as_brute_force(spark, seed):
    rows = made(seed)
    expected, _, border = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in nc.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {d for d in got if got[d] != expected[d]}
    assert len(wrong) <= len({x for p in border for x in p})


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected, _, border = brute_classes(rows)
    out = op6_near_copies(spark, sf).collect()
    got = {r.doc_id: r.class_id for r in out}
    assert len(out) == len(rows) and all(r.keeper == (r.doc_id == r.class_id) for r in out)
    assert sum(got[d] != expected[d] for d in got) <= len({x for p in border for x in p})


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    text = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(600):
        other = list(text)
        other[rng.randrange(150)] = f"u{i}"
        rows.append((i, " ".join(other)))
    got = nc.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.keeper for r in got) == 1


def test_pairs_far_apart_in_a_bucket_of_texts_like_nobody(spark):
    """Texts share a passage (0.6 or so); in one large bucket, some have a copy that neither leader nor neighbours meet."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(120)]
    rows, pairs = [], []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(36)]
        rows.append((i, " ".join(passage + own)))
        if i % 30 == 7:
            own[rng.randrange(5, 30)] = f"c{i}"
            rows.append((1000 + i, " ".join(passage + own)))
            pairs.append((i, 1000 + i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequency, n = nc.document_frequencies(docs)
    idf = spark.sparkContext.broadcast(nc.rarity(frequency, n).astype(np.float32))
    # One bucket, in whose order the copies lie apart; the leader is like nobody.
    reps = spark.createDataFrame([(d, [1, d % 1000 + 10 * d, d]) for d, _ in rows], "doc_id long, bands array<long>")
    links = nc.find_links(docs, reps, idf, spark.sparkContext.broadcast(frequency.astype(np.uint32)), nc.SIMILARITY)
    assert sorted((r.a, r.b) for r in links.collect()) == pairs


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "!!", 0), (4, "?!", 0), (5, "!!", 0), (None, "a b", 0), (6, "A, b", 0), (7, "a b", 0), (7, "a b", 0), (None, "unseen", 0)], "doc_id long, text string, class_id int")
    got = sorted((r.doc_id or 0, r.class_id) for r in nc.near_classes(df).collect() if r.class_id is not None)
    assert got == [(0, 6), (1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (6, 6), (7, 6), (7, 6)]
    assert nc.near_classes(df.limit(0)).count() == 0


def test_a_large_group_is_not_compared_with_itself_again(spark, monkeypatch):
    compared, verified = [], nc.verified
    monkeypatch.setattr(nc, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    passage = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*passage[:i], f"own{i}", *passage[i + 1 :]])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in nc.near_classes(docs).collect()} == {0}
    assert sum(compared) <= 2 * len(rows)


def barely_alike(n=600, shingles=46):
    """(rows, pairs): texts and copies that differ in one word, just above the similarity; some of these pairs share no band."""
    rows = []
    for i in range(n):
        words = [f"a{i}x{j}" for j in range(shingles + 4)]
        rows.append((i, " ".join(words)))
        rows.append((n + i, " ".join([*words[:20], f"b{i}", *words[21:]])))
    return rows


def test_links_that_no_band_leads_to(spark, tmp_path):
    rows = barely_alike()
    expected, similar, border = brute_classes(rows)
    assert len(similar) == 600 and min(similar.values()) > 0.8
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.class_id for r in op6_near_copies(spark, str(tmp_path)).collect()} == expected


def test_a_shingle_of_many_texts_is_split(spark, monkeypatch):
    """The same pairs whatever a task compares, and all that are alike are among them."""
    rows = made(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequency, n = nc.document_frequencies(docs)
    idf = spark.sparkContext.broadcast(nc.rarity(frequency, n).astype(np.float32))
    counts = spark.sparkContext.broadcast(frequency.astype(np.uint32))
    members = docs.select("doc_id", docs["doc_id"].alias("label"))
    whole, found = brute_classes(rows)[1], []
    for together in (1 << 24, 16):
        monkeypatch.setattr(nc, "TOGETHER", together)
        found.append({(r.a, r.b) for r in nc.unmet_pairs(members, nc.shingle_sets(docs), idf, counts, 0.8).collect()})
    assert found[0] == found[1] and {p for p, j in whole.items() if j >= 0.8} <= found[0]


def test_labels_after_further_links(spark):
    labels = components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long"))
    further = spark.createDataFrame([(3, 11), (30, 31), (31, 21), (1, 3)], "a long, b long")
    got = {r.node: r.label for r in nc.joined(labels, further).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 31: 20}
    assert {r.node: r.label for r in nc.joined(labels, further.limit(0)).collect()} == {r.node: r.label for r in labels.collect()}
