import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from checks.compare import canonical, connect, same
from reelmill.llm import tries
from reelmill.llm.queries import ORACLE, op12_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_by_node(rows):
    """The contract's rows, from a plain dictionary of prefixes; turns of a conversation must differ in number."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members, enders = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple([*own.get(c - c % 100, [])[:h], *own[c][h:]])
        enders[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    inner = {k[:-1] for k in members if k}
    out = set()
    for node, convs in members.items():
        below = [k for k in members if k[: len(node)] == node]
        children = sum(len(k) == len(node) + 1 for k in below)
        leaves = sum(k not in inner for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        sha = hashlib.sha256(",".join(map(str, enders.get(node, []))).encode()).hexdigest()
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, sha))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def some_conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = rng.choice([i, i + 100, i * 3])
        if any(r[0] == conv for r in rows):
            continue
        for turn in rng.sample([None, *range(9)], rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there", None, ""])))
    return rows


@pytest.mark.parametrize("seed, turns, paths", [(0, 10**6, 4096), (1, 5, 4), (2, 1, 1000)])
def test_against_a_dictionary(spark, seed, turns, paths):
    rows = some_conversations(seed)
    got = tries.prefix_trie(frame(spark, rows), turns, paths)
    assert got.columns == COLUMNS
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == node_by_node(rows)


@pytest.mark.parametrize("cut", [1, 2, 3, 7])
def test_forests_meet_at_any_border(cut):
    """Partitions of any size, contracted and merged, give the nodes of the whole."""
    rng = random.Random(cut)
    convs = [b"".join(bytes([rng.randint(0, 1)] * 16) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    listed = sorted((path, i) for i, path in enumerate(convs))
    sizes = [1] * 9
    whole = tries.Forest([tries.Path.of(p, i, sizes[: len(p) // 16]) for p, i in listed], True, False).rows
    first = [tries.Forest([tries.Path.of(p, i, sizes[: len(p) // 16]) for p, i in listed[a : a + cut]], False, False) for a in range(0, len(listed), cut)]
    open_ = sorted((p for f in first for p in f.open), key=lambda p: p.path)
    rest = tries.Forest(open_, True, True).rows
    by_key = {r[4]: r[0] for r in rest}
    merged = [[*r[:2], by_key[r[3]] if r[3] is not None else r[2], *r[5:]] for r in [x for f in first for x in f.rows] + rest]
    assert sorted(map(str, merged)) == sorted(str([*r[:3], *r[5:]]) for r in whole)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = op12_prefix_trie(spark, sf)
    cursor = connect(sf).execute(ORACLE["op12_prefix_trie"])
    expected, names = cursor.fetchall(), [d[0] for d in cursor.description]
    assert names == df.columns
    assert same(canonical([tuple(r) for r in df.collect()], names), canonical(expected, names)) == ""


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (7, None, None, None), (7, 0, "user", "y" * 200_000), (-5, 3, "a", "b"), (300, 1, "user", "z")]
    rows += [(301 + i, 1, "user", "z") for i in range(60)]
    df = frame(spark, rows)
    assert {tuple(r) for r in tries.prefix_trie(df.selectExpr("*", "'x' AS path", "1 AS ender"), 3).collect()} == node_by_node(rows)
    assert tries.prefix_trie(df.limit(0)).collect() == []
    assert tries.prefix_trie(df.where("conv_id is null")).collect() == []


def test_repeated_rows_are_turns(spark):
    rows = [(500, 1, "user", "a")] * 4 + [(500, 1, "user", "b")]
    got = sorted(tuple(r)[:2] for r in tries.prefix_trie(frame(spark, rows)).collect())
    assert got == [(500, d) for d in range(6)]
