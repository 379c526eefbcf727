"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many virtual nodes at hashed places of a ring. A key belongs to the first node
clockwise from its own place. Keys are taken in ring order; one whose shard is full goes on clockwise
to the next node whose shard has room. With ``balance`` 1 the shards' room adds up to the number of
rows, so counts are at most one apart; with more room fewer keys move on.

Only the counts of arcs (one per virtual node) reach the driver, which follows the keys round the
ring arc by arc: the result is the same as that of placing keys one at a time. A row's rank in its
arc then gives its shard and its slot. Texts are read once and never shuffled.

Defined results: a null text has size 1 and crc 0; a null doc_id is placed by its text's crc and
size; rows that are alike in doc_id, size and crc are interchangeable and each get a slot of their
own; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.session import store

PLACE_BITS = 60
#: Virtual nodes sit at the starts of 2 ** RING_BITS equal cells of the ring.
RING_BITS = 16
#: Rows that one cell holds on average at most; cells are ranked one by one.
CELL_ROWS = 1 << 14
#: Rows alike that one task expands at a time.
COPIES = 1 << 16


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise; a cell has one node at most."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        made, trial = 0, 0
        while made < nodes:
            place = hashlib.blake2b(f"{shard}/{trial}".encode(), digest_size=8).digest()
            cell = int.from_bytes(place, "big") >> (64 - RING_BITS)
            trial += 1
            if cell not in taken:
                taken[cell] = shard
                made += 1
    return sorted(taken.items())


def follow(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where each arc's keys end up."""
    load, out, n = [0] * len(room), [], len(owners)
    for arc in range(n):
        rank, end, node = 0, counts.get(arc, 0), arc
        while rank < end:
            shard = owners[node % n]
            take = min(end - rank, room[shard] - load[shard])
            if take > 0:
                out.append((arc, rank, rank + take, shard, load[shard]))
                rank, load[shard] = rank + take, load[shard] + take
            node += 1
    return out


def capacities(rows: int, shards: int, balance: float) -> list[int]:
    """Rows that each shard may hold; at least an even share."""
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [max(e, int(balance * rows / shards)) for e in even]


def shard_rows(docs: DataFrame, shards: int = 16, nodes: int = 64, balance: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in each shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("place", F.shiftrightunsigned(key, 64 - PLACE_BITS))
    alike = store(rows.groupBy("doc_id", "size", "text_crc32", "place").agg(F.count(F.lit(1)).alias("copies")), "alike")

    points = ring(shards, nodes)
    owners = [s for _, s in points]
    total = alike.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    bits = max(RING_BITS, (total // CELL_ROWS).bit_length())
    alike = alike.withColumn("cell", F.shiftright("place", PLACE_BITS - bits))
    cells = alike.groupBy("cell").agg(F.sum("copies").alias("n"))

    arcs = [(first, points[i][0], i) for i, first in enumerate([0, *(c + 1 for c, _ in points[:-1])])]
    arcs.append((points[-1][0] + 1, (1 << RING_BITS) - 1, 0))  # beyond the last node: on to the first
    arc_of = spark.createDataFrame([(c, a, p) for p, (lo, hi, a) in enumerate(arcs) for c in range(lo, hi + 1)], "coarse int, arc int, part int")
    coarse = F.shiftright("cell", bits - RING_BITS).cast("int").alias("coarse")
    cells = cells.select("cell", "n", coarse).join(F.broadcast(arc_of), "coarse")
    # The first arc has two parts: the ring's end comes before its start.
    ahead = Window.partitionBy("arc").orderBy(F.desc("part"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))

    counts = {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    segments = follow(counts, owners, capacities(total, shards, balance))
    plan = spark.createDataFrame(segments, "arc int, lo long, hi long, shard int, base long")
    plan = plan.groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("segments"))

    inside = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    ranked = ranked.join(cells.select("cell", "arc", "ahead"), "cell")
    ranked = ranked.withColumn("first", F.col("ahead") + F.col("inside"))
    ranked = ranked.withColumn("end", F.col("first") + F.col("copies")).drop("copies")
    # Large groups of rows alike are cut into blocks, which other tasks expand.
    many = F.col("end") - F.col("first") > COPIES
    blocks = ranked.where(many).withColumn("first", F.explode(F.sequence("first", F.col("end") - 1, F.lit(COPIES).cast("long"))))
    blocks = blocks.withColumn("end", F.least("end", F.col("first") + COPIES)).repartition("arc", "first")
    ranked = ranked.where(~many).unionByName(blocks)
    ranked = ranked.withColumn("rank", F.explode(F.sequence("first", F.col("end") - 1)))
    found = ranked.join(F.broadcast(plan), "arc").withColumn("s", F.expr("filter(segments, s -> rank >= s.lo and rank < s.hi)[0]"))
    return found.select("doc_id", "size", "text_crc32", F.col("s.shard").alias("shard"), (F.col("s.base") + F.col("rank") - F.col("s.lo")).alias("slot"))
