"""Prefix trie of conversations by union-find over neighbours in sorted order.

A conversation is the path of its turns' digests (of role and text). Paths are sorted by ranges, so
that those with a common beginning lie next to each other, copies too, and no beginning is one task's
work. In each partition the edges between neighbours, as long as their common beginning, are taken
in descending depth: an edge unites the components on either side, and every union is a branching
node at that depth. What a component had below it is then a finished chain of nodes and is written out.

Only the nodes on a partition's first and last path can go on in another partition. They stay open: the
partition's forest is contracted to these two paths, with what is finished added up at their nodes. All
contracted paths, sorted as before, go through the same union-find in fewer partitions, until there is
one; it has two paths for each partition before it, ``PATHS`` at most.

A finished node whose parent stays open names the parent by its depth and digest, and gets its
conversation by a join with the nodes that were finished later.

Defined results: turns are in the order of their number, null first, then of role and text; a null
role or text is empty; repeated rows are turns of their own; rows without a conv_id are no
conversation; a conversation without turns is a member of the root; other columns are ignored; an
empty table gives an empty one. One conversation's path, 16 bytes a turn, is one value, as a text is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.session import small_side, store

#: One more than the turns of a shared beginning, and the conversations that share it.
SHARED, FAMILY = 6, 100
#: Bytes of a turn's digest.
WIDTH = 16
#: Turns that a task sorts and joins, and contracted paths in one task; for the number of tasks only.
TURNS, PATHS = 200_000, 4096
NONE = np.iinfo(np.int64).max
NOBODY = hashlib.sha256(b"").hexdigest()

PER_DEPTH = ("sizes", "members", "least", "children", "leaves", "saved", "enders")
NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, own_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ender long"
OPEN = "path binary, " + ", ".join(f"{c} array<long>" for c in PER_DEPTH)


class Path:
    """A component of paths: the digests that they share, and sums at every depth from 0 on.

    ``members`` and ``least``: number and least id of conversations through the node; ``children``,
    ``leaves`` and ``saved``: what finished subtrees add to it; ``enders``: the least id that ends there.
    ``waiting``: rows of finished children, by depth, that lack their parent's conversation. ``border``:
    0 for the first path of a partition, 1 for the last, ``None`` for components without either.
    """

    __slots__ = ("path", "border", "waiting", *PER_DEPTH)

    def __init__(self, path: bytes, columns, border: int | None = None):
        self.path, self.border, self.waiting = path, border, {}
        for name, column in zip(PER_DEPTH, columns):
            setattr(self, name, column)

    @classmethod
    def of(cls, path: bytes, conv: int, sizes) -> Path:
        """The path of one conversation."""
        n = len(path) // WIDTH + 1
        zero = np.zeros(n, np.int64)
        enders = np.full(n, NONE)
        enders[-1] = conv
        return cls(path, (np.concatenate(([0], np.asarray(sizes, np.int64))), zero + 1, zero + conv, zero, zero, zero, enders))

    @property
    def end(self) -> int:
        return len(self.members) - 1


def common(a: bytes, b: bytes) -> int:
    """Turns with which both paths begin."""
    n = min(len(a), len(b)) // WIDTH
    differ = np.flatnonzero(np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n))
    return int(differ[0]) // 2 if len(differ) else n


def node_keys(path: bytes, depths) -> dict[int, bytes]:
    """Depth and digest of the beginning of a path, for each of some depths."""
    running, out, at = hashlib.md5(), {}, 0
    for depth in sorted(depths):
        running.update(path[at * WIDTH : depth * WIDTH])
        at = depth
        out[depth] = depth.to_bytes(8, "big") + running.digest()
    return out


class Forest:
    """Union-find over the sorted paths of one partition; ``last``: there is no other partition.

    ``rows`` are the finished nodes, ``open`` the paths at the borders with what is known of their nodes.
    ``keyed``: nodes tell their own key, since finished ones of another forest may wait for them.
    """

    def __init__(self, paths: list[Path], last: bool, keyed: bool):
        self.rows: list[list] = []
        self.keyed = keyed
        self.parent, self.at = list(range(len(paths))), list(paths)
        self.open: list[Path] = []
        if not last:
            for border, place in enumerate(sorted({0, len(paths) - 1})):
                p = paths[place]
                p.border = border
                blank = [p.sizes, *(np.full(p.end + 1, NONE if name in ("least", "enders") else 0) for name in PER_DEPTH[1:])]
                self.open.append(Path(p.path, blank))
        depths = np.array([common(a.path, b.path) for a, b in zip(paths, paths[1:])], np.int64)
        order = np.argsort(-depths, kind="stable")
        for edges in np.split(order, np.flatnonzero(np.diff(depths[order])) + 1):
            if len(edges):
                self._unite(edges.tolist(), int(depths[edges[0]]))
        root = self.at[self._find(0)]
        if last:
            self._finish(root, 0)
        else:
            self._leave_open(root, 0)

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _unite(self, edges: list[int], depth: int) -> None:
        """Unions by all edges of one depth; each resulting component is one node at that depth."""
        parts: dict[int, list[int]] = {}
        for i in edges:
            a, b = self._find(i), self._find(i + 1)
            one, other = parts.pop(a, [a]), parts.pop(b, [b])
            if len(one) < len(other):  # the larger component's root stays
                a, b, one, other = b, a, other, one
            self.parent[b] = a
            one.extend(other)
            parts[a] = one
        for root, members in parts.items():
            self.at[root] = self._joined([self.at[m] for m in members], depth)

    def _joined(self, parts: list[Path], depth: int) -> Path:
        """The node that some components share; what they have below it is finished, or left open at a border."""
        columns = []
        for name in PER_DEPTH:
            listed = np.stack([getattr(p, name)[: depth + 1] for p in parts])
            columns.append(listed[0] if name == "sizes" else listed.min(axis=0) if name in ("least", "enders") else listed.sum(axis=0))
        borders = [p.border for p in parts if p.border is not None]
        whole = Path(parts[0].path[: depth * WIDTH], columns, min(borders, default=None))
        for p in parts:
            if p.end > depth:
                if p.border is not None:
                    self._leave_open(p, depth + 1)
                else:
                    top, leaves, saved = self._finish(p, depth + 1)
                    whole.children[depth] += 1
                    whole.leaves[depth] += leaves
                    whole.saved[depth] += saved
                    whole.waiting.setdefault(depth, []).append(top)
            for at, rows in p.waiting.items():
                if at <= depth:
                    whole.waiting.setdefault(at, []).extend(rows)
        return whole

    def _finish(self, p: Path, top: int) -> tuple[int, int, int]:
        """Write the nodes of a component from its end up to depth ``top``; that node's row, leaves and saved."""
        leaves = saved = 0
        keys = node_keys(p.path, range(top, p.end + 1)) if self.keyed else {}
        for d in range(p.end, top - 1, -1):
            children = int(p.children[d]) + (d < p.end)
            leaves = leaves + int(p.leaves[d]) if children else 1
            saved += int(p.saved[d]) + (int(p.members[d]) - 1) * int(p.sizes[d])
            conv, ender = int(p.least[d]), int(p.enders[d])
            above = int(p.least[d - 1]) if d > top else None
            self.rows.append([conv, d, above, None, keys.get(d), int(p.members[d]), children, leaves, saved, None if ender == NONE else ender])
            for row in p.waiting.get(d, ()):
                self.rows[row][2] = conv
        return len(self.rows) - 1, leaves, saved

    def _leave_open(self, p: Path, top: int) -> None:
        """What is known of a border component's nodes from depth ``top`` on goes to the border's path."""
        kept = self.open[p.border]
        for name in PER_DEPTH[1:]:
            getattr(kept, name)[top : p.end + 1] = getattr(p, name)[top:]
        depths = [d for d in p.waiting if d >= top]
        for d, key in node_keys(p.path, depths).items():
            for row in p.waiting[d]:
                self.rows[row][3] = key


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path and sizes of every conversation after it has got its family's beginning; stored.

    The first crc32(conv_id) mod ``SHARED`` turns are those of the conversation whose id is the last
    multiple of ``FAMILY``, the others its own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    own = store(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "turns")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(first == F.col("conv_id")).select(F.col("conv_id").alias("first"), F.slice("own", 1, SHARED).alias("head"))
    rows = own.withColumn("first", first).join(small_side(heads), "first", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    turned = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h), rest)
    rows = rows.select("conv_id", turned.alias("seq"))
    path = F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), ""))
    return store(rows.select("conv_id", path.alias("path"), F.transform("seq", lambda t: t["size"]).alias("sizes")), "paths")


def _steps(frames: DataFrame, read, last: bool, keyed: bool) -> DataFrame:
    """Finished nodes and open paths of the forest of every partition; stored."""
    names = [x.split()[0] for x in f"{NODE}, {OPEN}".split(", ")]
    n_node = len(NODE.split(", "))
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in f"{NODE}, {OPEN}".split(", ")]

    def batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def build(batches):
        paths = [p for rows in batches for p in read(rows)]
        if not paths:
            return
        forest = Forest(paths, last, keyed)
        for i in range(0, len(forest.rows), 20_000):
            part = forest.rows[i : i + 20_000]
            yield batch([*zip(*part), *([None] * len(part) for _ in range(len(names) - n_node))])
        if forest.open:
            none = [[None] * len(forest.open)] * n_node
            yield batch([*none, [p.path for p in forest.open], *([getattr(p, c) for p in forest.open] for c in PER_DEPTH)])

    return store(frames.mapInArrow(build, f"{NODE}, {OPEN}"), "forest")


def _read_conversations(rows):
    for path, conv, sizes in zip(*(rows.column(c).to_pylist() for c in ("path", "conv_id", "sizes"))):
        yield Path.of(path, conv, sizes)


def _read_open(rows):
    for path, *columns in zip(*(rows.column(c).to_pylist() for c in ("path", *PER_DEPTH))):
        yield Path(path, [np.array(c, np.int64) for c in columns])


def ends(paths: DataFrame) -> DataFrame:
    """ender and ends_sha256: for each node where conversations end, the least of them and the digest of all ids.

    The digest is one of a text in order, so the ids of a node pass through one task, row by row.
    """
    rows = paths.select(F.md5("path").alias("node"), "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")

    def digest(batches):
        node, ender, running, out = None, None, None, []
        for rows in batches:
            for key, conv in zip(rows.column("node").to_pylist(), rows.column("conv_id").to_pylist()):
                if key == node:
                    running.update(b",%d" % conv)
                    continue
                if node is not None:
                    out.append((ender, running.hexdigest()))
                node, ender, running = key, conv, hashlib.sha256(b"%d" % conv)
            yield packed(out)
            out = []
        if node is not None:
            yield packed([(ender, running.hexdigest())])

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["ender", "ends_sha256"])

    return rows.mapInArrow(digest, "ender long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns_per_task: int = TURNS, paths_per_task: int = PATHS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    spark = conversations.sparkSession
    paths = rebuilt_paths(conversations)
    turns = paths.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0)).alias("n")).first()["n"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // turns_per_task + 1)
    ordered = paths.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes, read, keyed = None, _read_conversations, False
    while True:
        last = tasks == 1
        found = _steps(ordered, read, last, keyed)
        finished = found.where("path is null").select(*(x.split()[0] for x in NODE.split(", ")))
        nodes = finished if nodes is None else nodes.unionByName(finished)
        if last:
            break
        open_ = found.where("path is not null").select("path", *PER_DEPTH)
        tasks = max(1, min(open_.count() // paths_per_task, tasks // 2))
        ordered = (open_.coalesce(1) if tasks == 1 else open_.repartitionByRange(tasks, "path")).sortWithinPartitions("path")
        read, keyed = _read_open, True
    keys = small_side(nodes.where("own_key is not null").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("_above")))
    above = nodes.join(keys, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ended = above.where("ender is not null").join(ends(paths), "ender").select(*columns)
    return ended.unionByName(above.where("ender is null").withColumn("ends_sha256", F.lit(NOBODY)).select(*columns))
