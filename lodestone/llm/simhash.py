"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint bit is set where over half the hashes of a text's word shingles
have it. Equal fingerprints are one node. Nodes are dealt into shards: the 64
bits are cut into `blocks` blocks, and two fingerprints that differ in at most
`radius` bits agree on all of some `blocks - radius` of them, so each node goes
to one shard for each choice of blocks, named by its bits there. A shard's nodes
form a BK-tree whose children are keyed by their Hamming distance to the parent;
a search follows only the edges within the radius of its own distance.

Large shards: their nodes are dealt into several trees. Links inside of each
tree are contracted to components first; then only nodes outside of a shard's
largest component form trees again, which are sent to all blocks of the shard's
nodes. A unit hands on a spanning set of its links, at most one for each node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm import textkit as tk
from lodestone.operators.components import connected_components
from lodestone.shared import Scratch

BITS = 64
#: Nodes of a tree.
TREE = 8192
#: Nodes whose trees a task searches together.
FOREST = 1 << 16
#: Pairs of query and node that a step of a search may look at.
STEP = 1 << 21
#: Shingles whose bits are counted together.
SHINGLES = 1 << 16
#: Expected nodes of a shard, from which the number of blocks follows.
SHARD = 2048


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of some texts with one space after each; starts and ends of the words there; where each text's words begin."""
    start, end = tk.words(data, offsets)
    ends = np.cumsum(end - start + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = tk.lowered(data)[~tk._WHITE[data]]
    return out.tobytes(), ends - (end - start), ends, np.searchsorted(start, offsets)


def fingerprints(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text (uint64); 0 of one without words."""
    out = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for low, high, data, offsets in tk.chunks(column):
        text, start, end, first = _spaced(data, offsets)
        own = np.zeros(high - low, np.uint64)
        for i in range(high - low):
            a, z = int(first[i]), int(first[i + 1])
            n = max(z - a - shingle + 1, min(z - a, 1))
            counts = np.zeros(BITS, np.int64)
            for lo in range(a, a + n, SHINGLES):
                hi = min(lo + SHINGLES, a + n)
                last = np.minimum(np.arange(lo, hi) + shingle, z) - 1
                hashes = [digest(text[s:e], seed) for s, e in zip(start[lo:hi].tolist(), end[last].tolist(), strict=True)]
                counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            own[i] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
        out.append(own)
    return np.concatenate(out)


class Forest:
    """BK-trees of distinct numbers; unit gives the tree of each and is sorted. A tree's first number is its root, and a child stands after its parent."""

    def __init__(self, values: np.ndarray, unit: np.ndarray):
        self.values = values
        n = len(values)
        root = np.searchsorted(unit, unit)
        at, parent, edge = root.copy(), np.full(n, -1), np.zeros(n, np.int64)
        rest = np.flatnonzero(np.arange(n) != root)
        while len(rest):
            distance = np.bitwise_count(values[rest] ^ values[at[rest]]).astype(np.int64)
            _, first, place = np.unique(at[rest] * (BITS + 1) + distance, return_index=True, return_inverse=True)
            child = rest[first]
            parent[child], edge[child] = at[child], distance[first]
            at[rest] = child[place]
            fresh = np.zeros(len(rest), bool)
            fresh[first] = True
            rest = rest[~fresh]
        below = np.flatnonzero(parent >= 0)
        key = parent[below] * (BITS + 1) + edge[below]
        order = np.argsort(key, kind="stable")
        self.keys, self.children = key[order], below[order]

    def search(self, query: np.ndarray, root: np.ndarray, radius: int, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of a query, node) within the radius, from each query's root down, level by level; with before, nodes before a query's own only."""
        q, node = np.arange(len(query)), root
        if before is not None:
            q, node = q[node < before], node[node < before]
        while len(q):
            distance = np.bitwise_count(self.values[node] ^ query[q]).astype(np.int64)
            near = distance <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(distance - radius, 0))
            n = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(distance + radius, BITS), "right") - low
            q = np.repeat(q, n)
            node = self.children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(q))]
            if before is not None:
                keep = node < before[q]
                q, node = q[keep], node[keep]


class _Spanning:
    """Labels of nodes by the links so far; add() returns those links of a batch that join two labels."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]
        self.up = np.arange(self.label.max(initial=-1) + 1)

    def _top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places in a and b of the links that are new."""
        x, y = self.label[a], self.label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return []
        _, first = np.unique(np.minimum(x[apart], y[apart]) * len(self.up) + np.maximum(x[apart], y[apart]), return_index=True)
        out = []
        for i in apart[first].tolist():
            p, q = self._top(int(x[i])), self._top(int(y[i]))
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append(i)
        if out:
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]
            self.label = self.up[self.label]
        return out


def _steps(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of queries whose trees have at most STEP nodes together; one query at least."""
    total, lo = np.cumsum(cost), 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEP, "right")))
        yield lo, hi
        lo = hi


_LINKS = "a long, b long"


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _inside(values: np.ndarray, unit: np.ndarray, radius: int) -> pa.RecordBatch:
    forest, spanning = Forest(values, unit), _Spanning(np.arange(len(values)))
    root = np.searchsorted(unit, unit)
    own, a, b = np.arange(len(values)), [], []
    for lo, hi in _steps(np.searchsorted(unit, unit, "right") - root):
        for q, node in forest.search(values[lo:hi], root[lo:hi], radius, own[lo:hi]):
            for i in spanning.add(q + lo, node):
                a.append(int(values[q[i] + lo].view(np.int64)))
                b.append(int(values[node[i]].view(np.int64)))
    return _links(a, b)


def _trees(radius: int):
    """Rows sorted by shard and part: the links inside of each part. Holds some whole parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def take(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            cut = size if last else int(change[-1]) if len(change) else 0
            if cut:
                unit = np.zeros(cut, np.int64)
                unit[change[change < cut]] = 1
                yield _inside(columns[3][:cut], np.cumsum(unit), radius)
            held, size = [[c[cut:] for c in columns]], size - cut

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append([*columns[:3], columns[3].view(np.uint64)])
            size += len(batch)
            if size >= FOREST:
                yield from take(False)
        if size:
            yield from take(True)

    return run


def _across(radius: int):
    """A tree of a shard's nodes outside of its largest component and a block of all its nodes: a spanning set of the links that are new."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, side = (table.column(c).to_numpy() for c in ("fingerprint", "comp", "side"))
        order = np.argsort(side, kind="stable")
        value, n = node[order].view(np.uint64), int((side == 0).sum())
        tree, query = value[:n], value[n:]
        forest, spanning = Forest(tree, np.zeros(n, np.int64)), _Spanning(comp[order])
        a, b = [], []
        for lo, hi in _steps(np.full(len(query), max(n, 1))) if n else ():
            for q, at in forest.search(query[lo:hi], np.zeros(hi - lo, np.int64), radius):
                for i in spanning.add(q + lo + n, at):
                    a.append(int(query[q[i] + lo].view(np.int64)))
                    b.append(int(tree[at[i]].view(np.int64)))
        return pa.Table.from_batches([_links(a, b)])

    return run


def shard_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius of the blocks, the mask of their bits as a signed number."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks_for(nodes: int, radius: int, shard: int = SHARD) -> int:
    """The fewest blocks with which a shard of evenly spread nodes has at most `shard` of them; three more than the radius at most."""
    for blocks in range(radius + 1, radius + 4):
        if nodes >> (BITS * (blocks - radius) // blocks) <= shard:
            return blocks
    return radius + 3


def linked_fingerprints(nodes: DataFrame, radius: int, *, blocks: int | None = None, tree: int = TREE) -> DataFrame:
    """(node, component) of the nodes with a link: distinct numbers in the column fingerprint (long) that differ in at most `radius` bits are linked."""
    scratch = Scratch(nodes.sparkSession, "bk")
    if not 0 <= radius < BITS:
        raise ValueError("radius is from 0 to 63")
    blocks = blocks or blocks_for(nodes.count(), radius)
    value = F.col("fingerprint")
    shards = [F.struct(F.lit(i).alias("choice"), value.bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(shard_masks(blocks, radius))]
    entries = nodes.select(value, F.explode(F.array(*shards)).alias("s")).select("s.choice", "s.key", "fingerprint")
    hot = scratch.write(entries.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > tree), "hot")
    part: Column = F.lit(0)
    dealt = entries
    if is_hot := not hot.isEmpty():
        dealt = entries.join(hot, ["choice", "key"], "left")
        part = F.coalesce(F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("n") / tree)).cast("int"), F.lit(0))
    dealt = dealt.select("choice", "key", part.alias("part"), "fingerprint").repartition("choice", "key", "part").sortWithinPartitions("choice", "key", "part", "fingerprint")
    links = scratch.write(tk.mapped(dealt, _trees(radius), _LINKS), "links")
    found = connected_components(links)
    if not is_hot:
        return found
    found = scratch.write(found, "found")
    member = entries.join(hot, ["choice", "key"]).join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    member = scratch.write(member.select("choice", "key", "fingerprint", F.coalesce("component", "fingerprint").alias("comp")), "member")
    sizes = member.groupBy("choice", "key", "comp").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("choice", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("few")).where("few > 0")
    rows = member.join(shape, ["choice", "key"]).withColumn("h", F.xxhash64("fingerprint"))
    trees, queries = F.ceil(F.col("few") / tree).cast("int"), F.ceil(F.col("all") / tree).cast("int")
    own = ["choice", "key", "fingerprint", "comp"]
    left = rows.where("comp <> big").select(*own, F.lit(0).alias("side"), F.pmod("h", trees).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), queries - 1)).alias("q"))
    right = rows.select(*own, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("p"), F.pmod("h", queries).cast("int").alias("q"))
    more = left.unionByName(right).groupBy("choice", "key", "p", "q").applyInArrow(_across(radius), _LINKS)
    more = scratch.write(more.where("a <> b"), "more")
    return connected_components(links.unionByName(more))


def _prints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), shingle, seed).view(np.int64))], names=["doc_id", "value"])

    return run


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4, blocks: int | None = None, tree: int = TREE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are runs of bytes other than x20 and x09 to x0D, A-Z lower-cased;
    shingles, repeats included, are joined by a space and hashed by XXH64 with
    the seed; a text with fewer words than a shingle has its whole sequence as
    the one shingle. Fingerprints that differ in at most `radius` bits are
    linked; component_id is the smallest doc_id reachable.

    Null, empty or wordless text: fingerprint zero, linked like any other. Null
    ids: fingerprint only, component_id null, linked with nothing. Rows that
    repeat an id are judged each by its own text. Other columns are ignored,
    whatever their names. An empty table gives no rows. Ids are integers.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = scratch.write(tk.mapped(base, _prints(shingle, seed), "doc_id long, value long"), "prints")
    nodes = scratch.write(rows.where("doc_id is not null").groupBy(F.col("value").alias("fingerprint")).agg(F.min("doc_id").alias("first")), "nodes")
    found = linked_fingerprints(nodes.select("fingerprint"), radius, blocks=blocks, tree=tree)
    named = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("comp"))
    named = scratch.write(named, "named")
    ids = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    labels = named.join(ids, "comp").select(F.col("fingerprint").alias("value"), "component_id")
    out = rows.join(labels, "value", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
