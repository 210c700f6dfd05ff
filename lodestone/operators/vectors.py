"""Scores of all pairs of vectors by blocks, and calibration of scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.shared import Scratch, small_batches

#: Vectors on a side of a block.
BLOCK = 4096
#: Bytes of candidates that a task holds, and tasks that queries are dealt over at most.
HELD, DEALT = 64 << 20, 256
_PACKED = "block string, ids binary, vectors binary"
_FOUND = "query_id long, ids array<long>, scores array<double>, most double, total double"


def _packed(block: int, dtype: str):
    """Rows of vectors as rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("id").to_numpy().astype(np.int64)
            values = table.column("vector").combine_chunks().flatten().to_numpy().astype(dtype)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["block", "ids", "vectors"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == block:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest scores with their ids, ties to smaller ids; -inf where there are fewer."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, 1)[:, -k]
        row, col = np.nonzero(score >= least[:, None])
    else:
        row, col = np.nonzero(score > -np.inf)
    value, who = score[row, col], ids[row, col]
    order = np.lexsort((who, -value, row))
    row, value, who = row[order], value[order], who[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    fit = place < k
    best, own = np.full((len(score), k), -np.inf), np.zeros((len(score), k), np.int64)
    best[row[fit], place[fit]], own[row[fit], place[fit]] = value[fit], who[fit]
    return own, best


def _products(k: int, scale: float | None, width: int, left: str, right: str):
    """Blocks of queries with blocks of candidates, those of a block of queries one after the other: of each query the k best, and the sum of exponentials that its softmax needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = who = None

        def out() -> pa.RecordBatch:
            fit = best > -np.inf
            offsets = pa.array(np.concatenate([[0], np.cumsum(fit.sum(1))]).astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x[fit])) for x in (own, best))
            return pa.RecordBatch.from_arrays([pa.array(who), *lists, pa.array(most), pa.array(total)], names=["query_id", "ids", "scores", "most", "total"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, qi, qv, ci, cv = (batch.column(c)[row] for c in ("block", "ids", "vectors", "c_ids", "c_vectors"))
                if block.as_py() != name:
                    if name is not None:
                        yield out()
                    name, who = block.as_py(), np.frombuffer(qi.as_buffer(), np.int64)
                    v = np.frombuffer(qv.as_buffer(), left).astype(np.float64).reshape(-1, width)
                    own, best = np.zeros((len(who), k), np.int64), np.full((len(who), k), -np.inf)
                    most, total = np.full(len(who), -np.inf), np.zeros(len(who))
                ids = np.frombuffer(ci.as_buffer(), np.int64)
                w = np.frombuffer(cv.as_buffer(), right).astype(np.float64).reshape(-1, width)
                for lo in range(0, len(who), 512):
                    at = slice(lo, min(lo + 512, len(who)))
                    score = v[at] @ w.T
                    score = score * scale if scale is not None else score
                    score[who[at][:, None] == ids[None, :]] = -np.inf  # no vector is its own partner
                    if scale is not None:
                        peak = np.maximum(most[at], score.max(1))
                        with np.errstate(invalid="ignore"):
                            total[at] = np.where(np.isfinite(peak), total[at] * np.exp(most[at] - peak) + np.exp(score - peak[:, None]).sum(1), 0.0)
                        most[at] = peak
                    more, value = _best(np.broadcast_to(ids, score.shape), score, k)
                    own[at], best[at] = _best(np.hstack([own[at], more]), np.hstack([best[at], value]), k)
        if name is not None:
            yield out()

    return run


def top_products(queries: DataFrame, candidates: DataFrame, *, id: str = "id", vector: str = "vector", k: int = 10, attention: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score, weight) of each query's k candidates with the largest products, ties to smaller ids; a vector isn't its own partner.

    With attention, scores are divided by the root of the width, and weight is
    the softmax over all of a query's candidates, not only the k; else null.
    Vectors of one width; those that are null, hold null or non-finite numbers
    or have another width than the most common take no part. Ids are integers
    and don't repeat on a side.

    Vectors are packed in blocks and written once; every block of queries meets
    every block of candidates in one product of matrices. A task reads its
    blocks from those files, so that no vector is shuffled to each block of the
    other side, and keeps k candidates a query over all of its candidates.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "products")
    small_batches(spark)

    def sound(df: DataFrame) -> tuple[DataFrame, str]:
        single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
        own = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
        own = own.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        return own, "f4" if single else "f8"

    (left, one), (right, two) = sound(queries), sound(candidates)
    widths = right.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width = widths["width"] if widths else 0

    def packed(df: DataFrame, dtype: str, tag: str, parts: Callable[[int], int]) -> DataFrame:
        own = df.where(F.size("vector") == width)
        return scratch.write(own.mapInArrow(_packed(block, dtype), _PACKED).repartition(max(1, parts(own.count()))), tag)

    l = packed(left, one, "left", lambda n: min(DEALT, -(-n // block)))
    r = packed(right, two, "right", lambda n: -(-n * width * 8 // HELD)).select(F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    pairs = l.hint("shuffle_replicate_nl").crossJoin(r)
    found = pairs.mapInArrow(_products(k, width**-0.5 if attention and width else None, width, f"<{one}", f"<{two}"), _FOUND)
    parts = found.groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("scores", "ids"))).alias("best"), F.collect_list(F.struct("most", "total")).alias("sums"), F.max("most").alias("peak"))
    order = F.transform("best", lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("id")))
    parts = parts.select("query_id", F.posexplode(F.slice(F.array_sort(order), 1, k)).alias("at", "x"), "peak", F.aggregate("sums", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["most"] - F.col("peak"))).alias("whole"))
    score = -F.col("x.s")
    weight = F.exp(score - F.col("peak")) / F.col("whole") if attention else F.lit(None).cast("double")
    return parts.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), score.alias("score"), weight.alias("weight"))


def fitted_temperature(df: DataFrame, logit: str, label: str, *, by: str | None = None, rounds: int = 12, least: float = 0.05, most: float = 20.0) -> DataFrame:
    """(by, temperature, loss_before, loss_after, n): the divisor of logits at which the mean cross-entropy of labels 0 and 1 is smallest, for each class of `by` or all.

    Newton's method on the inverse of the temperature, in which the loss is
    convex, from 1, kept between 1 / most and 1 / least; a round is one pass of
    sums over all rows, a row for each class. Rows with a null or non-finite
    logit or another label take no part; a null class is one of its own. A class
    that a threshold parts without error has no least loss and moves on towards
    its bound, a step a round; one whose logits are all 0 stays at 1.
    """
    scratch = Scratch(df.sparkSession, "temperature")
    key = F.col(by) if by else F.lit(0)
    own = df.select(key.alias("by"), F.col(logit).cast("double").alias("z"), F.col(label).cast("int").alias("y"))
    own = scratch.write(own.where("y in (0, 1) and z is not null and not isnan(z) and abs(z) < double('infinity')"), "rows")
    at = own.groupBy("by").agg(F.lit(1.0).alias("s"))

    def loss(s) -> F.Column:
        x = F.col("z") * s
        return F.avg(F.greatest(x, F.lit(0.0)) - x * F.col("y") + F.log1p(F.exp(-F.abs(x))))

    for turn in range(rounds):
        at = scratch.write(at, f"at{turn}")
        p = 1 / (1 + F.exp(-F.col("z") * F.col("s")))
        joined = own.withColumnRenamed("by", "k").join(at, F.col("k").eqNullSafe(F.col("by")))
        step = joined.groupBy("by", "s").agg(F.sum(F.col("z") * (p - F.col("y"))).alias("g"), F.sum(F.col("z") * F.col("z") * p * (1 - p)).alias("h"))
        # A step of at most a doubling or halving keeps the search from running past where the curve is flat.
        moved = F.least(F.greatest(F.col("s") - F.col("g") / (F.col("h") + 1e-12), F.col("s") / 2), F.col("s") * 2)
        at = step.select("by", F.least(F.greatest(moved, F.lit(1 / most)), F.lit(1 / least)).alias("s"))
    at = scratch.write(at, "at")
    joined = own.withColumnRenamed("by", "k").join(at, F.col("k").eqNullSafe(F.col("by")))
    out = joined.groupBy("by", "s").agg(loss(F.lit(1.0)).alias("loss_before"), loss(F.col("s")).alias("loss_after"), F.count("*").alias("n"))
    return out.select(*([F.col("by").alias(by)] if by else []), (1 / F.col("s")).alias("temperature"), "loss_before", "loss_after", "n")
