"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are packed into buckets of like length, longest first. Every query
meets the longest bucket first, which gives it a score to beat; a block of
queries is then paired, by lengths alone, with the buckets that can beat one of
its scores, and only these are shipped to it. For a query and a bucket the score
to beat, over the query's length and the bucket's greatest, is a cosine
threshold: over 1 the bucket is skipped; a high one prunes by the range that the
query's strongest coordinate leaves for a candidate's; a low one prunes by
length, a prefix of the bucket. What is left is multiplied out.

A bucket travels once for each block of queries that may need it, two bytes a
component where components fit, so blocks are large: what is shuffled follows
rows * queries / BLOCK, where lengths don't prune.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.shared import Scratch

#: Vectors in a bucket, queries in a block, buckets that a task streams for a block, queries multiplied at once.
BUCKET, BLOCK, STREAM, ROWS = 2048, 8192, 32, 512
#: Cosine threshold from which a bucket is pruned by coordinate.
BY_COORDINATE = 0.7
#: Blocks whose best scores a task holds at once.
HELD = 4


def quantised(vectors: DataFrame, scale: float, *, id_col: str, vec_col: str) -> DataFrame:
    """id, dim, v (floor(scale * x) of each component, as double), norm; only ids and components that are there and finite."""
    v = F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    raw = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    frame = vectors.where(F.col(f"`{id_col}`").isNotNull() & raw.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    frame = frame.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.size(raw).alias("dim"), v.alias("v"))
    return frame.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _packer(most: int):
    """Sorted rows into blocks of one dimension; a block's number holds its partition's."""
    names = ["block", "dim", "norm", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        dim = None

        def block() -> pa.RecordBatch:
            i, m = np.concatenate(ids), np.concatenate(rows)
            top = float(np.sqrt((m * m).sum(1).max(initial=0.0)))
            kind = "<i2" if np.abs(m).max(initial=0) < 1 << 15 else "<f8"
            values = ((part << 32 | number, pa.int64()), (dim, pa.int32()), (top, pa.float64()), (i.astype("<i8").tobytes(), pa.binary()), (m.astype(kind).tobytes(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=names)

        for batch in batches:
            i, d = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat = batch.column(2)
            values = flat.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(d)])
            lo = 0
            while lo < len(i):
                held = sum(len(x) for x in ids)
                if held and (d[lo] != dim or held >= most):
                    yield block()
                    ids, rows, held, number = [], [], 0, number + 1
                dim = int(d[lo])
                same = np.flatnonzero(d[lo:] != dim)
                hi = min(lo + (int(same[0]) if len(same) else len(d) - lo), lo + most - held)
                ids.append(i[lo:hi])
                rows.append(values[at[lo] : at[hi]].reshape(hi - lo, dim))
                lo = hi
        if ids:
            yield block()

    return run


_BLOCK = "block long, dim int, norm double, ids binary, data binary"


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """The vectors of a block, n x dim doubles."""
    kind = "<i2" if n and len(data) == 2 * n * dim else "<f8"
    return np.frombuffer(data, kind).astype(np.float64).reshape(n, dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _products(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query that the bucket may serve: its number, and ids and scores of candidates that reach its floor."""
    q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    top = c_norm.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(floor == -np.inf, -1.0, floor / (q_norm * top))
    cosine = np.where(np.isnan(cosine), -1.0, cosine)  # a zero query or bucket, score 0
    slack = 1e-9
    live = (cosine <= 1 + slack) | (floor <= 0)
    narrow = live & (floor > 0) & (cosine >= BY_COORDINATE)
    for i in np.flatnonzero(narrow):
        unit = q[i] / q_norm[i]
        f = int(np.abs(unit).argmax())
        t = min(float(cosine[i]), 1.0)
        strong = c_norm >= floor[i] / q_norm[i] * (1 - slack)
        share = np.divide(c[:, f], c_norm, out=np.zeros(len(c)), where=c_norm > 0)
        # The other coordinates add at most the product of their lengths to the cosine.
        others = np.sqrt(np.maximum(1 - unit[f] ** 2, 0) * np.maximum(1 - share**2, 0))
        fits = share * unit[f] + others >= t - 1e-6
        rows = np.flatnonzero(strong & fits)
        scores = c[rows] @ q[i]
        good = (scores >= floor[i]) & (c_ids[rows] != q_ids[i])
        yield int(i), c_ids[rows][good], scores[good]
    wide = np.flatnonzero(live & ~narrow)
    order = np.argsort(-c_norm, kind="stable")
    exact = np.float32 if q_norm.max(initial=0.0) * top < 1 << 24 else np.float64  # products of integers below 2**24 are exact in either
    for lo in range(0, len(wide), ROWS):
        part = wide[lo : lo + ROWS]
        need = np.where(floor[part] > 0, floor[part] / np.maximum(q_norm[part], 1e-300) * (1 - slack), 0.0)
        prefix = np.searchsorted(-c_norm[order], -need, "right")
        rows = order[: prefix.max(initial=0)]
        scores = q[part].astype(exact) @ c[rows].astype(exact).T
        for n, i in enumerate(part):
            own = rows[: prefix[n]]
            s = scores[n, : prefix[n]]
            good = (s >= floor[i]) & (c_ids[own] != q_ids[i])
            yield int(i), c_ids[own][good], s[good].astype(np.float64)


def _floors(k: int):
    """Rows of a query block and its dimension's longest bucket: the block with each query's k-th score there, and the length that a bucket needs to matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block, dim, q_ids, q_data, c_ids, c_data = (batch.column(n)[row].as_py() for n in range(6))
                ids, near = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                q, c = _matrix(q_data, len(ids), dim), _matrix(c_data, len(near), dim)
                floor = np.full(len(ids), -np.inf)
                for i, _, scores in _products(q, ids, c, near, floor.copy()):
                    if len(scores) >= k:
                        floor[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
                length = np.sqrt((q * q).sum(1))
                need = np.where((floor > 0) & (length > 0), floor / np.maximum(length, 1e-300) * (1 - 1e-9), 0.0)
                values = ((block, pa.int64()), (dim, pa.int32()), (float(need.min(initial=np.inf)), pa.float64()), (q_ids, pa.binary()), (q_data, pa.binary()), (floor.astype("<f8").tobytes(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["q_block", "dim", "need", "q_ids", "q_data", "floors"])

    return run


def _search(k: int):
    """Rows of a query block and a bucket: yields the best k of each query in what this task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def told(block: int) -> pa.RecordBatch:
            ids, _, _, best = held.pop(block)
            size = [len(x[0]) for x in best]
            columns = (np.repeat(ids, size), np.concatenate([x[0] for x in best]), np.concatenate([x[1] for x in best]))
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(len(batch)):
                block, dim = (batch.column(n)[row].as_py() for n in (0, 1))
                if block not in held:
                    if len(held) >= HELD:
                        yield told(next(iter(held)))
                    q_ids = np.frombuffer(batch.column(2)[row].as_py(), "<i8")
                    held[block] = [q_ids, _matrix(batch.column(3)[row].as_py(), len(q_ids), dim), np.frombuffer(batch.column(4)[row].as_py(), "<f8"), [(np.zeros(0, np.int64), np.zeros(0))] * len(q_ids)]
                q_ids, q, least, best = held[block]
                c_ids = np.frombuffer(batch.column(5)[row].as_py(), "<i8")
                c = _matrix(batch.column(6)[row].as_py(), len(c_ids), dim)
                floor = np.maximum(least, [s[k - 1] if len(s) >= k else -np.inf for _, s in best])
                for i, ids, scores in _products(q, q_ids, c, c_ids, floor):
                    if len(ids):
                        ids, scores = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores])
                        first = _best(scores, ids, k)
                        best[i] = (ids[first], scores[first])
        for block in list(held):
            yield told(block)

    return run


def top_k_products(vectors: DataFrame, queries: Column, *, k: int = 20, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query's quantised vector with every other row's: query_id, rank, vec_id, score.

    Components are floor(scale * x); scores are integers below 2**53 and exact.
    queries is a condition on rows. Ties go to the smaller id. A query with
    fewer candidates has all of them. Rows with a null id, a null vector or a
    null or non-finite component take no part; vectors only meet vectors of
    their own dimension; ids are integers; rows that share a query's id don't count for it,
    and rows that repeat an id and a vector count once.
    Other columns are ignored. No queries or an empty table give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    own = quantised(vectors, scale, id_col=id_col, vec_col=vec_col)
    asked = quantised(vectors.where(queries), scale, id_col=id_col, vec_col=vec_col)

    def blocks(frame: DataFrame, most: int, tag: str) -> DataFrame:
        frame = scratch.write(frame, f"{tag}-rows")
        n = max(1, -(-frame.count() // most))
        frame = frame.repartitionByRange(n, F.col("dim"), F.col("norm").desc(), F.col("id")).sortWithinPartitions("dim", F.col("norm").desc(), "id")
        return scratch.write(frame.select("id", "dim", "v").mapInArrow(_packer(most), _BLOCK), tag)

    buckets, asked = blocks(own, BUCKET, "buckets"), blocks(asked, BLOCK, "asked")
    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "data"), F.struct("norm", "block")).alias("first")).select("dim", "first.ids", "first.data")
    met = asked.select("block", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).join(longest, "dim").select("block", "dim", "q_ids", "q_data", "ids", "data")
    asked = scratch.write(met.mapInArrow(_floors(k), "q_block long, dim int, need double, q_ids binary, q_data binary, floors binary"), "floors")
    # Pairs of a block and a bucket, by their lengths, before anything large moves.
    splits = max(1, -(-buckets.count() // STREAM))
    split = F.pmod(F.xxhash64("block"), F.lit(splits)).cast("int")
    pairs = asked.select("q_block", "dim", "need").join(buckets.select("block", "dim", "norm"), "dim").where("norm >= need").select("q_block", "block", split.alias("split"))
    pairs = scratch.write(pairs, "pairs")
    sides = pairs.select("q_block", "split").distinct().join(asked.drop("need"), "q_block")
    units = pairs.join(buckets.select("block", "norm", "ids", "data"), "block").drop("block").join(sides.hint("shuffle_hash"), ["q_block", "split"])
    units = units.sortWithinPartitions("q_block", F.col("norm").desc()).select("q_block", "dim", "q_ids", "q_data", "floors", "ids", "data")
    found = units.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
