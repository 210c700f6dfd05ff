"""Ranked lexical search by windowed bucket scoring.

The index holds, in order of doc_id, each document's postings of the terms that
any item asks for. A search runs through it in windows of a fixed number of
successive doc_ids. In a window the postings are put in order of terms; an item
adds those of its terms, scaled once for all items, into an array with a bucket
for each doc_id, small enough for a core's cache. A bitset of each term says
which buckets hold anything, their union which are read; what beats the item's
heap is harvested into it. Heaps of tasks are merged by Spark.

Items are searched in blocks of bounded size, each in one run through the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.terms import alphabet, coded_terms, counted
from lodestone.shared import Scratch

LETTERS = alphabet((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Documents of a window: its array of sums has 32 KB.
WINDOW = 4096
#: Items of a block, and distinct terms of them all together; an item with more is a block of its own.
ITEMS, ITEM_TERMS = 4096, 250_000
#: The vocabulary of all items goes to the executors at once up to this many terms and bytes, else a block's own.
VOCABULARY, VOCABULARY_BYTES = 1_000_000, 64 << 20

_FORWARD = "doc_id long, n long, term array<int>, times array<long>"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tk.chunks(batch.column(1)):
            text, code, terms = coded_terms(data, offsets, LETTERS)
            text, code, n = counted(text, code, len(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(text)), terms.cast(pa.string()).take(pa.array(code)), pa.array(n)], names=["item", "term", "times"])


def _forward(vocabulary: Broadcast):
    """A row for each document: its terms with repeats, and the numbers and occurrences of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_string())
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(1)):
                text, code, terms = coded_terms(data, offsets, LETTERS)
                size = np.bincount(text, minlength=hi - lo)
                number = pc.fill_null(pc.index_in(terms, known), -1).to_numpy()[code]
                text, number, n = counted(text[number >= 0], number[number >= 0].astype(np.int64), len(known))
                begin = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(begin, pa.array(x)) for x in (number.astype(np.int32), n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), *lists], names=["doc_id", "n", "term", "times"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(size, np.int64)
        for batch in batches:
            docs += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(docs[held])], names=["term", "docs"])

    return run


class Heaps:
    """The best `k` of each item so far: scores (0: none) and doc_ids, best first."""

    def __init__(self, items: int, k: int):
        self.score, self.doc = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64)

    def harvest(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        fit = score >= max(int(self.score[item, -1]), 1)
        if not fit.any():
            return
        score, doc = np.concatenate([self.score[item], score[fit]]), np.concatenate([self.doc[item], doc[fit]])
        best = np.lexsort((doc, -score))[: self.score.shape[1]]
        self.score[item], self.doc[item] = score[best], doc[best]


class Postings:
    """A window's postings by term: buckets, what each adds to a sum, and a bitset of the buckets of each term."""

    def __init__(self, n_docs: int, bucket: np.ndarray, term: np.ndarray, value: np.ndarray, place: np.ndarray):
        """place: a table of all terms' rows, -1 outside of a window; close() leaves it so."""
        order = np.argsort(term, kind="stable")
        self.bucket, self.value = bucket[order], value[order]
        self.terms, begin = np.unique(term[order], return_index=True)
        self.begin = np.append(begin, len(term))
        self.place = place
        place[self.terms] = np.arange(len(self.terms))
        row = np.repeat(np.arange(len(self.terms)), np.diff(self.begin))
        self.bits = np.zeros((len(self.terms), -(-n_docs // 64)), np.uint64)
        np.bitwise_or.at(self.bits, (row, self.bucket >> 6), np.uint64(1) << (self.bucket & 63).astype(np.uint64))

    def close(self) -> None:
        self.place[self.terms] = -1

    def sums(self, terms: np.ndarray, times: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Adds an item's terms into the array and returns the buckets that hold anything."""
        row = self.place[terms]
        row, times = row[row >= 0], times[row >= 0]
        if not len(row):
            return row
        into[:] = 0
        for r, n in zip(row.tolist(), times.tolist(), strict=True):
            lo, hi = self.begin[r], self.begin[r + 1]
            into[self.bucket[lo:hi]] += self.value[lo:hi] * n  # a document has a term once
        held = np.bitwise_or.reduce(self.bits[row], axis=0)
        return np.flatnonzero(np.unpackbits(held.astype("<u8").view(np.uint8), bitorder="little"))


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 25 + (25 * n * docs) div total; in whole numbers of any size where 64 bits don't hold the product."""
    if int(n.max(initial=0)) * 25 * docs < 1 << 63:
        return 75 + 25 * n * docs // total
    return np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)


def _search(items: list[tuple[int, list[int], list[int]]], weight: np.ndarray, docs: int, total: int, k: int, window: int):
    """Rows in order of doc_id: the heaps of the items (id, terms, times). Holds one window and the heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(np.array(t, np.int64), np.array(n, np.int64)) for _, t, n in items]
        heaps, place = Heaps(len(items), k), np.full(len(weight), -1, np.int64)
        into = np.zeros(window, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), window):
                part = batch.slice(lo, window)
                doc, n = (part.column(c).to_numpy() for c in (0, 1))
                term, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                bucket = np.repeat(np.arange(len(doc)), pc.list_value_length(part.column(2)).to_numpy())
                value = weight[term] * (1_000_000_000 * times // (1000 * times + 12 * lengths(n, docs, total)[bucket]))
                postings = Postings(len(doc), bucket, term, value, place)
                for i, (terms, often) in enumerate(asked):
                    held = postings.sums(terms, often, into)
                    if len(held):
                        heaps.harvest(i, into[held], doc[held])
                postings.close()
        item, rank = np.nonzero(heaps.score)
        ids = np.array([x[0] for x in items], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(heaps.doc[item, rank]), pa.array(heaps.score[item, rank])], names=["item_id", "doc_id", "score"])

    return run


def _blocks(rows: Iterator[Row], items: int, terms: int) -> Iterator[list[tuple[int, list[int], list[int]]]]:
    block, held = [], 0
    for row in rows:
        if block and (len(block) == items or held + len(row.term) > terms):
            yield block
            block, held = [], 0
        block.append((row.item, row.term, row.times))
        held += len(row.term)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20, window: int = WINDOW, block_items: int = ITEMS, block_terms: int = ITEM_TERMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `k` best documents with a score above 0, equal scores by doc_id.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased. N documents have a term, with L terms in all; a document has n,
    and m = 75 + (25 * n * N) div L. A term in df documents weighs
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and adds
    w * ((10**9 * tf) div (1000 * tf + 12 * m)) for each time that the item has it.

    Null and empty texts have no terms: such items give no rows, such documents
    don't count. Rows that repeat an item's id are one item with the terms of
    all; items with a null id give none. Documents with a null id count in N, L
    and df and are never returned; rows that repeat a doc_id are documents each.
    Other columns are ignored, whatever their names. Ids are integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("item is not null")
    wanted = tk.mapped(own, _item_terms, "item long, term string, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))
    wanted = scratch.write(wanted, "wanted")
    vocab = scratch.write(wanted.select("term").distinct(), "vocabulary")
    size = vocab.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")

    def index(terms: list[str], tag: str) -> tuple[DataFrame, np.ndarray, int, int]:
        """The documents in order of doc_id, the terms' weights, N and L."""
        shared = spark.sparkContext.broadcast(terms)
        forward = scratch.write(tk.mapped(base, _forward(shared), _FORWARD), f"forward{tag}")
        row = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        held = forward.select("term").mapInArrow(_frequencies(len(terms)), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toPandas()
        weight = np.zeros(len(terms), np.int64)
        weight[held["term"].to_numpy(np.int64)] = [math.floor(1000 * math.log((2 * row.docs + 2) / (2 * x + 1))) for x in held["docs"].tolist()]
        found = forward.where((F.size("term") > 0) & F.col("doc_id").isNotNull()).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        found = scratch.write(found, f"index{tag}")
        scratch.drop(f"forward{tag}")
        return found, weight, row.docs, row.total

    def lists(rows: DataFrame) -> DataFrame:
        return rows.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("x")).select("item", "x.term", "x.times")

    at_once = size["n"] <= vocabulary and size["bytes"] <= VOCABULARY_BYTES
    terms = sorted(r.term for r in vocab.collect()) if at_once else []
    held = index(terms, "") if terms else None
    number = {t: i for i, t in enumerate(terms)}
    for turn, block in enumerate(_blocks(lists(wanted).orderBy("item").toLocalIterator(), block_items, block_terms)):
        if not at_once:
            terms = sorted({t for _, own_terms, _ in block for t in own_terms})
            number = {t: i for i, t in enumerate(terms)}
            held = index(terms, str(turn))
        found, weight, n_docs, total = held
        asked = [(item, [number[t] for t in own_terms], times) for item, own_terms, times in block]
        heaps = found.mapInArrow(tk.released(_search(asked, weight, n_docs, total, k, window)), "item_id long, doc_id long, score long")
        out = out.unionByName(scratch.write(heaps, f"heaps{turn}")) if turn else scratch.write(heaps, f"heaps{turn}")
        if not at_once:
            scratch.drop(f"index{turn}")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
