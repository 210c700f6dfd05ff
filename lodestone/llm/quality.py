"""A quality classifier by co-training.

Two views of a document, each a naive Bayes classifier: its text content (byte
trigrams, and how it repeats, shouts and breaks lines) and its page metadata
(language, source, the length on record, and these crossed), which reads nothing
of the text. In each round both views score every document; those that one view
is surest of are pseudo-labels for the other, which weigh by how much oftener
than by chance that view is right there on labels it hasn't seen. So a round is
one pass over the corpus that brings back counts of a fixed size.
At the end a logistic regression on labels, each held against views that it
didn't train, calibrates the two and combines them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.linear import logistic, row_sums, sigmoid
from lodestone.shared import Scratch

BITS = 15
NAMES = 1 << 15  # hashed classes of a metadata feature
META = 5  # language, source, length, and the length within each of both
SIZES = 40  # classes of a length, in half powers of 2
BINS = 24  # classes of a layout figure
FOLDS = 4  # parts of the labelled documents, each of which calibrates once

#: Kinds of bytes: capitals, marks, digits, spaces, ends of lines; 0 for others.
KINDS = 6
_KIND = np.zeros(256, np.int64)
_KIND[0x41:0x5B] = 1
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = 2
_KIND[0x30:0x3A] = 3
_KIND[[0x20, 0x09, 0x0D]] = 4
_KIND[0x0A] = 5
LAYOUT = 12


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature number of the three bytes that begin at each byte; bytes past a text's end are 0."""
    ends = offsets[1:][np.diff(offsets) > 0]
    second, third = (np.concatenate([data[k:], np.zeros(min(k, len(data)), np.uint8)]) for k in (1, 2))
    second[ends - 1] = third[ends - 1] = third[ends - 2] = 0
    h = data * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x LAYOUT figures of texts: length, shares of kinds of bytes, words and lines, and how much repeats."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, LAYOUT))
    some = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    kinds = np.bincount(_KIND[data] + np.repeat(np.arange(n) * KINDS, size), minlength=n * KINDS).reshape(n, KINDS)
    out[:, 1:KINDS] = kinds[:, 1:] / some[:, None]
    hashed, begin = tk.word_hashes(data, offsets, lower=False)
    count = np.diff(begin)
    owner = np.repeat(np.arange(n), count)
    out[:, 6] = size / np.maximum(count, 1)
    # One key of a text's number among those of a chunk and its word's hash, of which 40 bits tell words apart.
    h = np.sort(owner.astype(np.uint64) << np.uint64(40) | hashed >> np.uint64(24))
    o = (h >> np.uint64(40)).astype(np.int64)
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    distinct = np.bincount(o, fresh, n) if len(o) else np.zeros(n)
    out[:, 7] = distinct / np.maximum(count, 1)
    beside = np.zeros(n)
    if len(hashed) > 1:
        same = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
        beside = np.bincount(owner[1:], same, n)
    out[:, 8] = beside / np.maximum(count, 1)
    out[:, 9] = np.log1p(count) * out[:, 7]
    runs = np.diff(np.flatnonzero(np.concatenate([[True], fresh[1:], [True]]))) if len(h) else np.zeros(0, int)
    most = np.zeros(n)
    if len(h):
        np.maximum.at(most, o[fresh], runs)
    out[:, 10] = most / np.maximum(count, 1)
    out[:, 11] = np.log1p(most)
    return out


#: Each layout figure's least and greatest value for its classes; what lies outside goes to the outer ones.
_LEAST = np.zeros(LAYOUT)
_MOST = np.array([14, 0.5, 0.3, 0.2, 0.5, 0.1, 16, 1, 0.5, 8, 0.5, 8.0])


def layout_classes(figures: np.ndarray) -> np.ndarray:
    """Number of each figure's class, n x LAYOUT; a text without words has that as a class of its own."""
    share = (figures - _LEAST) / (_MOST - _LEAST)
    return np.clip((share * (BINS - 2)).astype(np.int64) + 1, 1, BINS - 1) * (figures[:, 9:10] > 0)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.clip((2 * np.log2(np.maximum(n, 0) + 1.0)).astype(np.int64), 0, SIZES - 1)


@dataclass
class Counts:
    """What naive Bayes counts by class (0, 1): trigrams as shares of their texts, layout classes, and metadata classes."""

    grams: np.ndarray
    layout: np.ndarray
    meta: np.ndarray
    #: Documents that count, by view (text, metadata) and class.
    docs: np.ndarray

    @staticmethod
    def none() -> Counts:
        return Counts(np.zeros((2, 1 << BITS)), np.zeros((2, LAYOUT, BINS)), np.zeros((2, META, NAMES)), np.zeros((2, 2)))

    def arrays(self) -> list[np.ndarray]:
        return [self.grams, self.layout, self.meta, self.docs]

    def weighed(self, by: np.ndarray) -> Counts:
        """With each view's counts of a class times a weight (by view and class)."""
        return Counts(self.grams * by[0][:, None], self.layout * by[0][:, None, None], self.meta * by[1][:, None, None], self.docs * by)


@dataclass
class Views:
    """Log-odds of the classes by view: mean over a text's trigrams, sums over its classes."""

    grams: np.ndarray
    layout: np.ndarray
    meta: np.ndarray
    #: Log-odds of the classes before anything is known of a page.
    prior: float = 0.0
    #: Of the labelled documents that calibrate: intercept and slope of each view.
    text_scale: tuple[float, float] = (0.0, 1.0)
    meta_scale: tuple[float, float] = (0.0, 1.0)

    @staticmethod
    def of(c: Counts, share: float) -> Views:
        """share: of class 1 among the labels; pseudo-labels don't move it."""

        def odds(counts: np.ndarray, weight: float) -> np.ndarray:
            p = (counts + weight) / (counts + weight).sum(-1, keepdims=True)
            return np.log(p[1] / p[0])

        # Classes are many and mostly empty: each leans to the share that it has of both classes' documents.
        total = np.maximum(c.meta.sum(-1, keepdims=True), 1e-9)
        common = c.meta.sum(0) / total.sum(0)
        p = (c.meta + META_WEIGHT * common) / (total + META_WEIGHT)
        meta = np.log(np.where(common > 0, p[1], 1.0) / np.where(common > 0, p[0], 1.0))
        return Views(odds(c.grams, 1e-2), odds(c.layout, 0.5), meta, np.log(share / (1 - share)))

    def text(self, grams: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
        z = row_sums(self.grams[grams], offsets) / np.maximum(np.diff(offsets), 1)
        return GRAM_WEIGHT * z + self.layout[np.arange(LAYOUT), classes].sum(1)

    def page(self, meta: np.ndarray) -> np.ndarray:
        return self.prior + self.meta[np.arange(META), meta].sum(1)


#: A class of metadata counts as if it had so many documents more, shared out as all are.
META_WEIGHT = 4.0
#: Trigrams of a text aren't independent: their mean counts as so many.
GRAM_WEIGHT = 8.0


@dataclass
class QualityModel:
    views: Views
    #: Intercept and the two views' weights.
    combined: tuple[float, float, float]
    #: The columns that trained: language, source, length.
    columns: tuple[str, ...] = ()
    #: Of each round the pseudo-labels that each view gave the other: (view, class, documents, weight of one).
    exchanged: list[tuple[str, int, int, float]] = field(default_factory=list)

    def odds(self, data: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds by text, by metadata and by both."""
        v = self.views
        text, page = v.text(trigrams(data, offsets), offsets, layout_classes(layout(data, offsets))), v.page(meta)
        both = self.combined[0] + self.combined[1] * text + self.combined[2] * page
        return v.text_scale[0] + v.text_scale[1] * text, v.meta_scale[0] + v.meta_scale[1] * page, both


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str, size_col: str) -> list:
    def name(c: str):
        return F.pmod(F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(NAMES)).cast("long")

    size = F.coalesce(F.col(f"`{size_col}`").cast("double"), F.lit(0.0)) if size_col in docs.columns else F.lit(0.0)
    return [F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source"), size.alias("size")]


def _meta(batch: pa.RecordBatch, at: int) -> np.ndarray:
    lang, source, size = (batch.column(at + i).to_numpy(zero_copy_only=False) for i in range(3))
    size = size_class(size)

    def within(name: np.ndarray) -> np.ndarray:
        return (tk.mix(name.astype(np.uint64) * np.uint64(SIZES) + size.astype(np.uint64)) % np.uint64(NAMES)).astype(np.int64)

    return np.stack([lang, source, size, within(lang), within(source)], 1)


@dataclass(frozen=True)
class Sure:
    """From which calibrated log-odds on a view's document is a pseudo-label: at most `low` for class 0, at least `high` for class 1."""

    low: float
    high: float

    @staticmethod
    def of(z: np.ndarray, weight: np.ndarray, sure: float, share: float) -> Sure:
        """All odds of at least `sure`, and at any rate the surest `share` of each kind among weighted labelled documents; none of a view that tells nothing apart."""
        order = np.argsort(z)
        upto = np.cumsum(weight[order]) / weight.sum()
        low, high = (float(z[order][min(int(np.searchsorted(upto, q)), len(z) - 1)]) for q in (share, 1 - share))
        if low >= high:
            return Sure(-np.inf, np.inf)
        limit = float(np.log(sure / (1 - sure)))
        return Sure(max(low, -limit) if low < 0 else low, min(high, limit) if high > 0 else high)

    def picked(self, z: np.ndarray) -> np.ndarray:
        """1, 0, or -1 for no pseudo-label."""
        return np.where(z >= self.high, 1, np.where(z <= self.low, 0, -1))


def worth(picked: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For classes 0 and 1, how much oftener than by chance a view's pseudo-labels are right: 0 for no oftener, 1 for always."""
    out = np.zeros(2)
    for value in (0, 1):
        chance = float(weight[y == value].sum() / weight.sum())
        own = picked == value
        # One label more of each kind, so that a few lucky ones don't count as proof.
        right = float((weight[own & (y == value)].sum() + chance) / (weight[own].sum() + 1))
        out[value] = max(0.0, (right - chance) / (1 - chance)) if chance < 1 else 0.0
    return out


def counted(batches: Iterator[pa.RecordBatch], views: Views | None, sure: tuple[Sure, Sure] | None) -> dict[int, Counts]:
    """Counts by fold of rows (fold, label, text, lang, source, size). Without views, of the labelled rows for both views;
    with views, of the rows that a view (text, metadata) is sure of, whatever their labels, for the other view."""
    out: dict[int, Counts] = {}
    for batch in batches:
        fold, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        meta = _meta(batch, 3)
        for lo, hi, data, offsets in tk.chunks(batch.column(2)):
            grams, classes, own = trigrams(data, offsets), layout_classes(layout(data, offsets)), meta[lo:hi]
            if views is None:
                by_text = by_page = label[lo:hi]
            else:
                by_text = sure[0].picked(views.text_scale[0] + views.text_scale[1] * views.text(grams, offsets, classes))
                by_page = sure[1].picked(views.meta_scale[0] + views.meta_scale[1] * views.page(own))
            size = np.diff(offsets)
            for k in np.unique(fold[lo:hi]).tolist():
                c, mine = out.setdefault(k, Counts.none()), fold[lo:hi] == k
                for value in (0, 1):
                    for_text, for_page = mine & (by_page == value), mine & (by_text == value)
                    c.docs[:, value] += for_text.sum(), for_page.sum()
                    weight = np.repeat(for_text / np.maximum(size, 1), size)
                    c.grams[value] += np.bincount(grams, weight, 1 << BITS) if for_text.any() else 0
                    for i in range(LAYOUT):
                        c.layout[value, i] += np.bincount(classes[for_text, i], minlength=BINS)
                    for i in range(META):
                        c.meta[value, i] += np.bincount(own[for_page, i], minlength=NAMES)
    return out


def _counts(rows: DataFrame, views: Views | None = None, sure: tuple[Sure, Sure] | None = None) -> dict[int, Counts]:
    """counted() over all rows: tasks give the counts of their parts that aren't 0, Spark adds them up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, c in counted(batches, views, sure).items():
            flat = np.concatenate([a.reshape(-1) for a in c.arrays()])
            place = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), fold, np.int64)), pa.array(place, pa.int64()), pa.array(flat[place], pa.float64())], names=["fold", "place", "n"])

    found = tk.mapped(rows, run, "fold long, place long, n double").groupBy("fold", "place").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for fold, own in found.groupby("fold"):
        c = out[int(fold)] = Counts.none()
        flat = np.zeros(sum(a.size for a in c.arrays()))
        flat[own["place"].to_numpy()] = own["n"].to_numpy()
        at = 0
        for a in c.arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
    return out


def _added(*counts: Counts) -> Counts:
    return Counts(*(sum(x) for x in zip(*(c.arrays() for c in counts), strict=True)))


def _odds_of(rows: DataFrame, views: dict[int, Views]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels and both views' raw log-odds of the labelled rows, each by its fold's views, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, meta = batch.column(0).to_numpy(zero_copy_only=False), _meta(batch, 3)
            for lo, hi, data, offsets in tk.chunks(batch.column(2)):
                grams, classes = trigrams(data, offsets), layout_classes(layout(data, offsets))
                text, page = np.zeros(hi - lo), np.zeros(hi - lo)
                for k in np.unique(fold[lo:hi]).tolist():
                    mine = fold[lo:hi] == k
                    text[mine] = views[k].text(grams, offsets, classes)[mine]
                    page[mine] = views[k].page(meta[lo:hi])[mine]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(text), pa.array(page)], names=["label", "text", "page"])

    found = np.array(sorted(tuple(r) for r in tk.mapped(rows, run, "label long, text double, page double").collect())).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    size_col: str = "n_chars",
    label_col: str = "quality",
    most_labelled: int = 20_000,
    rounds: int = 2,
    sure: float = 0.97,
    share: float = 0.05,
) -> QualityModel:
    """Co-trains both views from labels (id, 0 or 1; 1 is good) and all of docs.

    Of each label at most `most_labelled` documents, the first by a hash of id
    and text, are used as labelled. They train, and calibrate by folds: each fold
    is held against views that the others trained, with each label weighing as
    among all labelled documents. All documents
    take part in every round, those with a label too, as if they had none.

    A view's pseudo-labels of a class are the documents whose calibrated
    probability of it is at least `sure`, and at any rate as far as the surest
    `share` of the labelled documents goes. Let r be their worth(), by the
    labels in folds: together they weigh r / (1 - r) times what the labels do
    (99 times at most), or each as much as a label if that is less. The
    model's `exchanged` says how many there were in each round.

    Rows with a null id have no label. Of an id's labels the highest
    holds; nulls and other values are no labels. Rows that repeat an id and a
    text count each. Without labels every score is 0.5, with labels of one kind
    only every document gets that one. Empty docs are fine. Other columns are
    ignored; without size_col lengths are 0.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    used = tuple(c for c in (lang_col, source_col, size_col) if c in docs.columns)
    label = F.max(F.col(f"`{label_col}`").cast("int"))
    labels = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("id")).agg(label.alias("label"))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), *_named(docs, text_col, lang_col, source_col, size_col))
    mark = F.xxhash64("id", "text")
    marked = scratch.write(base.select("id", mark.alias("mark")).join(labels, "id"), "marked")
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    drawn = [marked.where(F.col("label") == v).orderBy(F.xxhash64("mark", F.lit(v)), "id").limit(most_labelled) for v in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1]).select("mark", "label").distinct()
    drawn = scratch.write(drawn.withColumn("fold", F.pmod(F.xxhash64("mark", F.lit(5)), F.lit(FOLDS)).cast("int")), "drawn")
    if len(totals) < 2:
        value = next(iter(totals), None)
        nothing = Views.of(Counts.none(), 0.5)
        nothing.text_scale = nothing.meta_scale = (0.0 if value is None else 8.0 * (2 * value - 1), 0.0)
        return QualityModel(nothing, (nothing.text_scale[0], 0.0, 0.0), used)
    columns = ["fold", "label", "text", "lang", "source", "size"]
    known = base.withColumn("mark", mark).join(F.broadcast(drawn), "mark").withColumn("label", F.col("label").cast("long"))
    known = scratch.write(known.withColumn("fold", F.col("fold").cast("long")).select(*columns), "known")
    everything = base.withColumns({"fold": F.lit(0).cast("long"), "label": F.lit(-1).cast("long")}).select(*columns)
    good = totals[1] / (totals[0] + totals[1])
    parts = _counts(known)
    given, told = Counts.none(), []
    for turn in range(rounds + 1):
        views = Views.of(_added(given, *parts.values()), good)
        # Each fold's labels are held against views that they didn't train.
        y, text, page = _odds_of(known, {k: Views.of(_added(given, *[c for i, c in parts.items() if i != k]), good) for k in parts})
        weight = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
        views.text_scale, views.meta_scale = (tuple(logistic(z[:, None], y, weight)) for z in (text, page))
        if turn == rounds:
            break
        odds = [a + b * z for (a, b), z in ((views.text_scale, text), (views.meta_scale, page))]
        limits = tuple(Sure.of(z, weight, sure, share) for z in odds)
        right = [worth(limit.picked(z), y, weight * len(y) / weight.sum()) for limit, z in zip(limits, odds, strict=True)]
        given = _counts(everything, views, limits).get(0, Counts.none())
        # Metadata labels what text counts, and text what metadata counts.
        by = np.stack([right[1], right[0]])
        labelled = _added(*parts.values()).docs
        by = np.minimum(1.0, np.minimum(99.0, by / np.maximum(1 - by, 1e-9)) * labelled / np.maximum(given.docs, 1)) * (by > 0)
        told += [(view, value, int(given.docs[i, value]), float(by[i, value])) for i, view in ((1, "text"), (0, "metadata")) for value in (0, 1)]
        given = given.weighed(by)
    scratch.drop()
    return QualityModel(views, tuple(logistic(np.stack([text, page], 1), y, weight)), used, told)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", keep_text: bool = False) -> DataFrame:
    """docs' columns (the text only on request) with text_score, meta_score and quality_score, each from 0 to 1, of the whole text.

    Null texts, languages, sources and lengths count as empty. Columns with the
    results' names are replaced; all others stay, whatever their names. A column
    that the model was trained with must be there: else a ValueError.
    """
    if gone := [c for c in model.columns if c not in docs.columns]:
        raise ValueError(f"the model was trained with {', '.join(gone)}")
    names = ["text_score", "meta_score", "quality_score"]
    keep = [c for c in docs.columns if c not in names and (keep_text or c != text_col)]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    m = len(keep)
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *_named(docs, text_col, lang_col, source_col, size_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = _meta(batch, m + 1)
            for lo, hi, data, offsets in tk.chunks(batch.column(m)):
                scores = [pa.array(sigmoid(z), pa.float64()) for z in model.odds(data, offsets, meta[lo:hi])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(m)), *scores], names=[*keep, *names])

    schema = kept.withColumns({c: F.lit(0.0) for c in names}).schema
    return tk.mapped(frame, run, schema)
