"""Toxicity by non-negative positive-unlabelled learning.

A sparse linear classifier over the presence of words and word beginnings, of
those that tell toxic from unlabelled texts, is trained from confirmed toxic
texts and all texts as unlabelled ones. The risk of the unlabelled texts, less
the share that the class prior puts down to hidden toxic ones, estimates the
risk on clean texts; where that estimate falls below zero the step goes the
other way, so the classifier can't fit the toxic texts by heart.

The corpus is read twice: for the number of texts that hold each feature, then
for each text's telling features, of which equal sets are one row with a count.
Every step sums risks and gradients over those rows in Spark and brings back as
many numbers as there are telling features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.linear import Adam, logistic, row_sums, sigmoid
from lodestone.shared import Scratch

BITS = 17
#: Bytes of word beginnings that are features beside the whole word.
STEMS = (4, 5, 6, 7)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of each text's distinct lower-cased words, and the n + 1 places where texts begin."""
    n = len(offsets) - 1
    data = tk.lowered(data)
    start, end = tk.runs_of(_LETTER[data], offsets)
    owner = np.searchsorted(offsets, start, "right") - 1
    whole = tk.slice_hashes(data, start, end)
    # One of each text's equal words: by text and the hash's upper bits.
    key = owner.astype(np.uint64) << tk.U64(40) | whole >> tk.U64(24)
    first = np.unique(key, return_index=True)[1]
    start, end, owner, whole = start[first], end[first], owner[first], whole[first]
    found, owners = [whole], [owner]
    for size in STEMS:
        long = end - start > size
        found.append(tk.slice_hashes(data, start[long], start[long] + size) + tk.U64(size))
        owners.append(owner[long])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    index = (tk.mix(found[order]) >> tk.U64(64 - BITS)).astype(np.int32)
    return index, np.searchsorted(owners[order], np.arange(n + 1))


def telling(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int, *, effect: float = 0.25, score: float = 3.0, least: int = 5) -> np.ndarray:
    """The features that are commoner in the positive texts, from the numbers of texts that hold each.

    By the difference of the shares over the unlabelled texts' deviation
    (`effect`) and its standard score; a feature of fewer than `least` positive
    texts isn't told. However many pass are taken.
    """
    p, u = positive / max(n_positive, 1), unlabelled / max(n_unlabelled, 1)
    size = (p - u) / np.sqrt(np.maximum(u * (1 - u), 0) + n_positive / max(n_unlabelled, 1) * u + 1e-6 * max(n_positive, 1))
    size[(positive < min(least, n_positive)) | (size * n_positive**0.5 < score)] = 0
    return np.flatnonzero(size >= min(effect, size.max())) if size.max() > 0 else np.zeros(0, np.int64)


@dataclass
class ToxicityModel:
    """A score is the logistic of slope * arcsinh(sum of weights + bias) + intercept: the odds of long toxic texts don't set the cut."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float
    prior: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        index, begin = features(data, offsets)
        # A feature counts once in a text.
        used = np.flatnonzero(self.weights[index])
        owner = np.searchsorted(begin, used, "right") - 1
        key = np.unique(owner.astype(np.int64) << BITS | index[used])
        index, begin = key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(begin)))
        return sigmoid(self.slope * np.arcsinh(row_sums(self.weights[index], begin) + self.bias) + self.intercept)


def risks(patterns: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows (places of telling features; numbers of positive and of unlabelled texts that have just these).

    Per feature and then for the bias: gradient of the losses of positive texts
    as toxic, of them as clean, of unlabelled texts as clean; then these losses.
    """
    m = len(w) - 1
    size = np.array([len(p) for p in patterns])
    place = np.concatenate([*patterns, np.zeros(0, np.int64)]).astype(np.int64)
    z = row_sums(w[place], np.concatenate([[0], np.cumsum(size)])) + w[m]
    parts = (-positive * sigmoid(-z), positive * sigmoid(z), unlabelled * sigmoid(z))
    losses = (positive * np.logaddexp(0, -z), positive * np.logaddexp(0, z), unlabelled * np.logaddexp(0, z))
    grads = [np.concatenate([np.bincount(place, np.repeat(g, size), m), [g.sum()]]) for g in parts]
    return np.concatenate([*grads, [x.sum() for x in losses]])


def nnpu(summed: Callable[[np.ndarray], np.ndarray], m: int, n_positive: float, n_unlabelled: float, prior: float, *, steps: int = 60, rate: float = 0.2, sparsity: float = 1e-3) -> np.ndarray:
    """m weights and a bias that minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with logistic losses.

    summed(w) gives risks() over all rows. Weights shrink towards 0 by
    `sparsity` at each step.
    """
    w = np.zeros(m + 1)
    w[m] = -1.0
    own = Adam(m + 1, rate)
    for _ in range(steps):
        total = summed(w)
        as_toxic, as_clean, unlabelled = total[: 3 * (m + 1)].reshape(3, -1) / np.array([[n_positive], [n_positive], [n_unlabelled]])
        clean_risk = total[-1] / n_unlabelled - prior * total[-2] / n_positive
        gradient = unlabelled - prior * as_clean
        own.step(w, prior * as_toxic + gradient if clean_risk >= 0 else -gradient)
        w[:m] = np.sign(w[:m]) * np.maximum(np.abs(w[:m]) - sparsity, 0)
    return w


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features in order, and the n + 1 places where texts begin."""
    index, begin = features(data, offsets)
    key = np.unique(np.repeat(np.arange(len(begin) - 1), np.diff(begin)) << BITS | index)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(begin)))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts with each feature; at 1 << BITS the number of texts."""
    count = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        count[-1] += len(batch)
        for _, _, data, offsets in tk.chunks(batch.column(0)):
            count[:-1] += np.bincount(_sets(data, offsets)[0], minlength=1 << BITS)
    place = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(count[place])], names=["place", "n"])


def _held(texts: DataFrame) -> np.ndarray:
    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in tk.mapped(texts, _holders, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def _patterns(chosen: np.ndarray):
    """Texts to (pattern, n): places of their telling features, equal ones of a batch together; marks after the text stay apart."""
    at = np.full(1 << BITS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = batch.column(1).to_numpy(zero_copy_only=False)
            found: Counter = Counter()
            for lo, hi, data, offsets in tk.chunks(batch.column(0)):
                index, begin = _sets(data, offsets)
                place = at[index]
                use = place >= 0
                begin = np.concatenate([[0], np.cumsum(use)])[begin]
                place = place[use]
                found.update((place[a:b].tobytes(), int(x)) for a, b, x in zip(begin[:-1], begin[1:], mark[lo:hi], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["pattern", "mark", "n"])

    return run


def _summed(patterns: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """risks() over a table of (pattern, positive, unlabelled)."""

    def total(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(3 * len(w) + 3)
            for batch in batches:
                rows = [np.frombuffer(p.as_buffer(), np.int32) for p in batch.column(0)]
                out += risks(rows, batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy().astype(float), w)
            place = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(out[place])], names=["place", "n"])

        out = np.zeros(3 * len(w) + 3)
        for r in patterns.mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r["place"]] = r["n"]
        return out

    return total


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    most_labelled: int = 20_000,
) -> ToxicityModel:
    """Fits a model from labels (id, 0 or 1; 1 are the confirmed toxic) and all texts of docs.

    Of each label at most `most_labelled` different texts are used, the first by
    a hash of the text: of five toxic ones four train and the fifth calibrates
    with the clean ones, each label weighing as among all labels. prior is the
    share of toxic texts in the corpus; without it the share among all labels is
    taken, which supposes that texts were picked for labelling at random.

    Null ids have no label; of an id's labels, and of a text's, the highest
    holds. Copies of a labelled text count once, unlabelled ones each. Without a
    toxic label every score is near 0. Null texts are empty; empty docs are fine.
    Other columns are ignored.
    """
    label = F.max(F.col(f"`{label_col}`").cast("int"))
    labels = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("id")).agg(label.alias("label"))
    known = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    if prior is None:
        prior = min(0.9, max(0.01, known["t"] / known["n"])) if known["n"] else 0.1
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    weights, bias = np.zeros(1 << BITS, np.float32), -8.0
    nothing = ToxicityModel(weights, bias, 1.0, 0.0, prior)
    marks = [F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    marked = base.select("id", F.struct(*marks).alias("mark")).join(labels, "id").groupBy("mark").agg(F.min("id").alias("id"), F.max("label").alias("label"))
    drawn = [marked.where(F.col("label") == v).orderBy(F.xxhash64("mark", F.lit(v)), "mark").limit(most_labelled) for v in (0, 1)]
    # The kinds of labelled texts: 1 trains, 2 is toxic and calibrates, 3 is clean.
    kind = F.when(F.col("label") == 0, 3).when(F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(5)) > 0, 1).otherwise(2)
    drawn = scratch.write(drawn[0].unionByName(drawn[1]).select("id", "mark", kind.alias("kind")), "drawn")
    chosen = base.withColumn("mark", F.struct(*marks)).join(F.broadcast(drawn), ["id", "mark"]).dropDuplicates(["mark"])
    chosen = scratch.write(chosen.select("text", "kind"), "labelled")
    positive, everything = _held(chosen.where("kind = 1").select("text")), _held(base.select("text"))
    if not positive[-1]:
        return nothing
    found = telling(positive[:-1], int(positive[-1]), everything[:-1], int(everything[-1]))
    texts = chosen.select("text", "kind").unionByName(base.select("text", F.lit(0).alias("kind")))
    counted = tk.mapped(texts, _patterns(found), "pattern binary, mark int, n long").groupBy("pattern")
    sums = {name: F.coalesce(F.sum(F.when(F.col("mark") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in enumerate(("unlabelled", "positive", "held", "clean"))}
    patterns = scratch.write(counted.agg(*sums.values()), "patterns")
    w = nnpu(_summed(patterns.select("pattern", "positive", "unlabelled")), len(found), int(positive[-1]), int(everything[-1]), prior)
    weights[found] = w[:-1]

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [float(w[np.frombuffer(p.as_buffer(), np.int32)].sum() + w[-1]) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), *batch.columns[1:]], names=["z", "held", "clean"])

    # Equal odds are one row, so what is fetched follows the labelled texts at most.
    cases = patterns.where("held + clean > 0").select("pattern", "held", "clean").mapInArrow(odds, "z double, held long, clean long")
    cases = np.array(sorted(tuple(r) for r in cases.groupBy("z").agg(F.sum("held"), F.sum("clean")).collect()), float).reshape(-1, 3)
    scratch.drop()
    z, y, n = np.tile(cases[:, 0], 2), np.repeat([1.0, 0.0], len(cases)), np.concatenate([cases[:, 1], cases[:, 2]])
    held, clean = cases[:, 1].sum(), cases[:, 2].sum()
    if not held or not clean:
        return ToxicityModel(weights, float(w[-1]), 1.0, 0.0, prior)
    weight = n * np.where(y == 1, known["t"] / held, (known["n"] - known["t"]) / clean)
    intercept, slope = logistic(np.arcsinh(z[n > 0])[:, None], y[n > 0], weight[n > 0])
    return ToxicityModel(weights, float(w[-1]), float(slope), float(intercept), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs' columns but the text, and score_col from 0 to 1 for each row's whole text, by its text alone.

    Null and empty texts are scored as texts without words. A column named as
    score_col is replaced; all others stay, whatever their names.
    """
    keep = [c for c in docs.columns if c not in (text_col, score_col)]
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(data, offsets) for _, _, data, offsets in tk.chunks(batch.column(len(keep)))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, score_col])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(score_col, F.lit(0.0)).schema
    return tk.mapped(frame, run, schema)
