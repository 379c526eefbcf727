import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelmill.llm import sharding
from reelmill.llm.queries import op10_sharding


def one_at_a_time(places, shards, nodes, balance):
    """Place keys in ring order, each on its own."""
    points = sharding.ring(shards, nodes)
    room = sharding.capacities(len(places), shards, balance)

    def ordered(place):
        cell = place >> (sharding.PLACE_BITS - sharding.RING_BITS)
        node = next((i for i, (c, _) in enumerate(points) if c >= cell), 0)
        return node, cell <= points[-1][0], place

    load, out = [0] * shards, {}
    for place in sorted(places, key=ordered):
        node = ordered(place)[0]
        while load[points[node % len(points)][1]] >= room[points[node % len(points)][1]]:
            node += 1
        shard = points[node % len(points)][1]
        out[place] = (shard, load[shard])
        load[shard] += 1
    return out


@pytest.mark.parametrize("balance,shards", [(1.0, 16), (1.25, 5)])
def test_same_as_one_at_a_time(spark, balance, shards):
    df = spark.range(0, 1500).select((F.col("id") * 7).alias("doc_id"), F.lit("x").alias("text"))
    places = {r.doc_id: r.p for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - sharding.PLACE_BITS).alias("p")).collect()}
    expected = one_at_a_time(list(places.values()), shards, 8, balance)
    got = sharding.shard_rows(df, shards, 8, balance).collect()
    assert len(got) == 1500
    for r in got:
        assert (r.shard, r.slot) == expected[places[r.doc_id]]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_sharding(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None


def test_more_room_moves_fewer_keys(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))

    def moved(balance):
        a = {r.doc_id: r.shard for r in sharding.shard_rows(df, 8, 64, balance).collect()}
        b = {r.doc_id: r.shard for r in sharding.shard_rows(df, 9, 64, balance).collect()}
        return sum(a[k] != b[k] for k in a)

    assert moved(1.3) < 4000 * 0.35


def test_rows_alike_are_expanded_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(7, "hot")] * 300 + [(i, "x") for i in range(100)], "doc_id long, text string")
    want = sorted(map(tuple, sharding.shard_rows(df, 4, 8).collect()))
    monkeypatch.setattr(sharding, "COPIES", 16)
    assert sorted(map(tuple, sharding.shard_rows(df, 4, 8).collect())) == want and len(want) == 400


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "", 2), (1, "a", 3), (1, "a", 3), (1, "b", 3)] + [(7, "hot", 0)] * 300, "doc_id long, text string, shard int")
    rows = sharding.shard_rows(df, 4, 8).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == 305 and max(n.values()) - min(n.values()) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == 305
    assert sharding.shard_rows(df.limit(0)).count() == 0
    assert sharding.shard_rows(df.limit(1)).count() == 1
