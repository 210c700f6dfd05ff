"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed once. Each of `registers` buckets
keeps, of its smallest hash, the leading-zero count and ten mantissa bits; an
empty bucket borrows from another by a fixed random order. Bands of registers
are the keys of the candidate search. Candidates pass a Jaccard estimate that is
corrected for chance register collisions, then are confirmed on the full sets.

Large groups: documents with equal sets are one node. In each band group every
node is compared with the smallest one, the links are contracted to components,
and only groups that still hold several components are compared further: nodes
outside of a group's largest component with all others, in blocks of bounded size. No pair of a group is
lost, no pair list is ever emitted, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import textkit as tk
from lodestone.operators.components import connected_components
from lodestone.shared import Scratch

MANTISSA_BITS = 10
EMPTY = np.uint16(65535)
#: Expected share of register collisions of equal-sized sets, times 2**MANTISSA_BITS.
COLLISION = 0.169919487159739
#: Ids up to this many are broadcast to pick texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Nodes on a side of a block when a group is compared in full, and members that share a star's unit.
BLOCK = 512
#: Shingles on a side of a block.
BLOCK_SHINGLES = 1 << 20


def registers(hashes: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """HyperMinHash registers (n x k, uint16) of sorted distinct hashes; rows of empty sets stay EMPTY."""
    n = len(begin) - 1
    out = np.full((n, k), EMPTY, np.uint16)
    if not len(hashes):
        return out
    owner = np.repeat(np.arange(n), np.diff(begin))
    low, high = hashes & tk.U64(0xFFFFFFFF), hashes >> tk.U64(32)
    bucket = ((high * tk.U64(k) + (low * tk.U64(k) >> tk.U64(32))) >> tk.U64(32)).astype(np.int64)
    place = owner * k + bucket
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    rest = np.maximum(hashes[first] * tk.U64(k), tk.U64(4)).astype(np.float64).view(np.uint64)
    exponent = (rest >> tk.U64(52)).astype(np.int64) - 1023
    zeros = np.clip(63 - exponent, 0, 62)
    mantissa = (rest >> tk.U64(52 - MANTISSA_BITS)).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    flat = out.reshape(-1)
    flat[place[first]] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return _densified(out, k)


def _densified(table: np.ndarray, k: int) -> np.ndarray:
    full = table != EMPTY
    some = np.flatnonzero(full.any(1) & ~full.all(1))
    if not len(some):
        return table
    source, work = table[some], table[some].copy()
    for turn in range(24):
        hole = work == EMPTY
        if not hole.any():
            break
        lender = (tk._stream(90001 + turn, k) % tk.U64(k)).astype(np.int64)
        work = np.where(hole, source[:, lender], work)
    for row in np.flatnonzero((work == EMPTY).any(1)):  # sets of a few shingles
        have = source[row][source[row] != EMPTY]
        hole = np.flatnonzero(work[row] == EMPTY)
        home = np.flatnonzero(source[row] != EMPTY)
        ahead = (tk._stream(424243, k)[hole] % tk.U64(k)).astype(np.int64)
        work[row, hole] = have[np.searchsorted(home, ahead) % len(have)]
    table[some] = work
    return table


def band_keys(table: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of registers; the band's number is part of it."""
    n, k = table.shape
    width = k // bands
    out = np.empty((n, bands), np.uint64)
    keys = tk._stream(77003, width)
    for b in range(bands):
        cell = table[:, b * width : (b + 1) * width].astype(np.uint64)
        out[:, b] = tk.mix(tk.mix((tk.mix(cell + tk.U64(1)) * keys).sum(1, dtype=np.uint64)) + tk.U64(b + 1))
    return out


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, less the collisions that sets of these sizes have by chance."""
    share = (many == one).mean(1)
    ratio = n_one / np.maximum(n_many, 1)
    chance = COLLISION * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return (share - chance) / (1 - chance)


def _sketch(length: int, k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, mark = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, data, offsets in tk.chunks(text):
                sets, begin = tk.shingle_sets(data, offsets, length)
                n = np.diff(begin)
                marks = []
                for seed in (3, 5):
                    sums = np.concatenate([[tk.U64(0)], np.cumsum(tk.mix(sets + tk.U64(seed)), dtype=np.uint64)])
                    marks.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
                table = registers(sets, begin, k)
                keys = band_keys(table, bands).view(np.int64)
                rows = table.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        mark.slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        pa.array([rows[i * 2 * k : (i + 1) * 2 * k] for i in range(hi - lo)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "text_mark", "n_shingles", "s1", "s2", "sketch", "bands"],
                )

    return run


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _hopeful(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray, percent: int) -> np.ndarray:
    """Not ruled out by size or by an estimate that is over five standard errors too low."""
    k = many.shape[1]
    smaller, larger = np.minimum(n_one, n_many), np.maximum(n_one, n_many)
    p = percent / 100
    floor = p - 5.5 * (p * (1 - p) / k) ** 0.5
    return (100 * smaller >= percent * larger) & ((smaller < k) | (estimate(one, many, n_one, n_many) >= floor))


def _stars(length: int, percent: int, k: int):
    """Rows sorted by unit with the leader first: yields the confirmed (a, b). Holds one leader's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own, row, size = None, None, None, 0
        for batch in batches:
            unit, salt, side, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            table = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, k)
            wanted = np.ones(len(node), bool)
            now, now_row, now_size = leader, row, size
            edges = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(unit)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if side[lo] == 0:
                    now, now_row, now_size = (unit[lo], salt[lo]), table[lo], int(n[lo])
                members = np.arange(lo, hi)[side[lo:hi] == 1]
                if len(members):
                    wanted[members] = _hopeful(now_row, table[members], now_size, n[members], percent)
            a, b = [], []
            text = batch.column(6)
            text = pc.if_else(pa.array(wanted), text, pa.scalar("", text.type))
            for lo, hi, data, offsets in tk.chunks(text):
                sets, begin = tk.shingle_sets(data, offsets, length)
                for i in range(lo, hi):
                    mine = sets[begin[i - lo] : begin[i - lo + 1]]
                    if side[i] == 0:
                        leader, own = (unit[i], salt[i]), mine
                    elif wanted[i] and leader == (unit[i], salt[i]) and _alike(own, mine, percent):
                        a.append(int(unit[i]))
                        b.append(int(node[i]))
            row, size = now_row, now_size
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets on the left with sets on the right, by products of blocks of their incidence matrices."""
    n = len(left)
    sets = left + right
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    value = value[order]
    column = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((n, len(right)), np.float32)
    for lo in range(0, int(column.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[:n] @ m[n:].T
    return out.astype(np.int64)


def _blocks(length: int, percent: int, k: int, bands: int):
    """One unit of a group that is compared in full, nodes outside of its largest component against all: yields a spanning set of its new links."""

    def run(table: pa.Table) -> pa.Table:
        key, node, comp, n, side, big = (table.column(c).to_numpy() for c in ("key", "node", "comp", "n_shingles", "side", "big"))
        regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, k)
        keys = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, bands)
        mine = int(np.flatnonzero(keys[0] == key[0])[0])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hope = np.zeros((len(left), len(right)), bool)
        for row, i in enumerate(left):
            # Pairs outside of the largest component stand on both sides; one order counts.
            own = (comp[right] != comp[i]) & ((comp[right] == big[right]) | (node[right] > node[i]))
            own &= (keys[right] == keys[i]).argmax(1) == mine  # each pair is compared in its first common band only
            own[own] = _hopeful(regs[i], regs[right[own]], int(n[i]), n[right[own]], percent)
            hope[row] = own
        rows, columns = np.flatnonzero(hope.any(1)), np.flatnonzero(hope.any(0))
        a, b = [], []
        if len(rows):
            used = [*left[rows], *right[columns]]
            text = table.column("text").take(pa.array(used)).combine_chunks()
            sets = []
            for _, _, data, offsets in tk.chunks(text):
                found, begin = tk.shingle_sets(data, offsets, length)
                sets += [found[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
            both = _overlaps(sets[: len(rows)], sets[len(rows) :])
            link = hope[np.ix_(rows, columns)] & (100 * both >= percent * (n[left[rows]][:, None] + n[right[columns]] - both))
            at = {int(x): i for i, x in enumerate(np.unique(comp))}
            label = np.arange(len(at))
            for x, y in np.argwhere(link):
                i, j = left[rows[x]], right[columns[y]]
                p, q = label[at[int(comp[i])]], label[at[int(comp[j])]]
                if p != q:
                    label[label == q] = p
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = 160, bands: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of
    their sets of distinct lower-cased (A-Z) word shingles; component_id is the
    smallest doc_id reachable through links. kept marks the one document that a
    component keeps.

    Null or wordless text: an empty set, linked with nothing (component_id is
    its own id). Null ids: never linked, component_id null, kept true. Rows that
    repeat an id are judged each by its own text. Other columns
    of docs are ignored, whatever their names. An empty table gives no rows.

    Ids are integers. A link becomes a candidate with probability
    1 - (1 - J**(k/bands))**bands: over 0.999997 at J = 0.80 and 0.99999999 at
    J = 0.85 with the defaults; the estimate, which must be 5.5 standard errors
    too low to drop a candidate, loses another 1 in 10**7 at most. Links are
    confirmed on the whole sets of 64-bit shingle hashes, which mix words by
    their bytes and places: two different shingles of a pair are taken for one
    with a chance of 2**-61, as one of three words keeps 61 bits of its hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.withColumn("text_mark", F.xxhash64("text"))
    schema = "doc_id long, text_mark long, n_shingles long, s1 long, s2 long, sketch binary, bands array<long>"
    all_rows = scratch.write(tk.mapped(base, _sketch(shingle, k, bands), schema), "sketch")
    live = all_rows.where("doc_id is not null and n_shingles > 0")
    sets = scratch.write(live.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "sets")
    nodes = live.join(sets.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    entries = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    entries = scratch.write(entries, "entries")
    groups = entries.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    # Nothing above this join needs its keys together, so that the runtime may split a hot one.
    hits = scratch.write(entries.join(groups, "key"), "hits")
    scratch.drop("entries")
    pairs = scratch.write(hits.where("node <> leader").select("leader", "node").distinct(), "pairs")

    def texts(ids: DataFrame, tag: str) -> DataFrame:
        ids = scratch.write(ids.distinct(), f"{tag}-ids")
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        more = all_rows.select("doc_id", "text_mark", "s1", "s2", "n_shingles", "sketch", "bands").join(side, "doc_id", "left_semi").join(sets.withColumnRenamed("rep", "doc_id"), ["doc_id", "s1", "s2"], "left_semi")
        own = base.join(side, "doc_id", "left_semi").join(more.drop("s1", "s2"), ["doc_id", "text_mark"])
        return own.withColumnRenamed("doc_id", "node")

    held = texts(pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).withColumnRenamed("node", "doc_id"), "star")
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    members = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("salt"), "node")
    heads = members.select("leader", "salt").distinct().withColumn("node", F.col("leader"))
    units = heads.withColumn("side", F.lit(0)).unionByName(members.withColumn("side", F.lit(1)))
    units = units.join(held, "node").select("leader", "salt", "side", "node", "n_shingles", "sketch", "text")
    units = units.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "side", "node")
    links = scratch.write(tk.mapped(units, _stars(shingle, percent, k), "a long, b long"), "links")
    found = scratch.write(connected_components(links), "found")

    marked = hits.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    inside = marked.groupBy("key", "comp").agg(F.count("*").alias("n"))
    open_groups = inside.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("big")).where("comps > 1 and size > 2")
    rest = marked.join(open_groups.select("key", "big"), "key").join(live.select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.max("n_shingles").alias("n")), "node")
    rest = scratch.write(rest, "rest")
    if not rest.isEmpty():
        held = texts(rest.select(F.col("node").alias("doc_id")), "block")
        small = F.col("comp") != F.col("big")

        def parts(nodes, shingles):
            return F.ceil(F.greatest(nodes / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")

        shape = rest.groupBy("key").agg(parts(F.count_if(small), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0))).alias("l_parts"), parts(F.count("*"), F.sum("n")).alias("r_parts"))
        rows = rest.join(shape, "key").withColumn("h", F.xxhash64("node"))
        left = rows.where(small).select("key", "node", "comp", "big", F.lit(0).alias("side"), F.pmod("h", "l_parts").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1)).alias("q"))
        right = rows.select("key", "node", "comp", "big", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("l_parts") - 1)).alias("p"), F.pmod("h", "r_parts").cast("int").alias("q"))
        units = left.unionByName(right).join(held, "node")
        more = units.groupBy("key", "p", "q").applyInArrow(_blocks(shingle, percent, k, bands), "a long, b long")
        more = scratch.write(more, "more")
        found = scratch.write(connected_components(links.unionByName(more)), "found2")

    labels = sets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = all_rows.select("doc_id", "n_shingles", "s1", "s2").join(labels, ["s1", "s2"], "left")
    single = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.select("doc_id", "n_shingles", F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = scratch.write(out, "out")
    scratch.drop(*[t for t in scratch.paths if t != "out"])
    return out


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose document its near-duplicate group keeps; all columns stay.

    Rows with a null id stay. Rows that repeat a kept id stay once for each
    distinct row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "one-per-group")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("doc_id is not null")
    kept = found.groupBy(F.col("doc_id").alias("key")).agg(F.bool_or("kept").alias("kept"), (F.count("*") > 1).alias("repeated")).where("kept")
    kept = scratch.write(kept.drop("kept"), "kept")
    # One column for all of docs', so that theirs may have any names.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))

    def rows(ids: DataFrame) -> DataFrame:
        ids = ids.select("key")
        return own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "key", "left_semi")

    out = rows(kept.where("not repeated")).unionByName(own.where("key is null"))
    repeated = kept.where("repeated")
    out = out if repeated.isEmpty() else out.unionByName(rows(repeated).distinct())
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
