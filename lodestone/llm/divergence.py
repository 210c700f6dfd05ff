"""Audit of how sources of a language diverge, by dense blocks of terms.

Occurrences of terms are counted by language and source, combined in each task
before they move. The terms that a language keeps are dealt into blocks, its
sources into tiles. A unit, a block of terms and a pair of tiles, is a dense
int64 matrix of groups by terms; it gives the partial matrix of distances
between all pairs of its groups, and of each group the heap of its most typical
terms. Partial matrices are summed and heaps merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.terms import alphabet, coded_terms, counted
from lodestone.shared import Scratch

LETTERS = alphabet((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Terms of a block and groups of a tile.
TERMS, GROUPS = 1024, 128
#: Bytes of text whose terms are combined in a task before they are handed on.
COMBINED = 4 << 20
#: Cells of an array of differences.
CELLS = 1 << 20
SCALE = 1_000_000_000


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)) of rows of counts, exact for totals up to 9 * 10**15.

    The quotient comes by three steps of a thousand, so that no product passes 64 bits.
    """
    whole = (total + 5 * terms)[:, None]
    out, rest = np.divmod(counts + 5, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of runs of texts; and a row without a term for each group."""
    for batch in batches:
        for lo, hi, data, offsets in tk.chunks(batch.column(2), COMBINED):
            names = list(zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True))
            number = {g: i for i, g in enumerate(dict.fromkeys(names))}
            group = np.array([number[g] for g in names], np.int64)
            text, code, terms = coded_terms(data, offsets, LETTERS)
            text, code, n = counted(text, code, len(terms))
            key, place = np.unique(group[text] * max(len(terms), 1) + code, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, n)
            docs = np.bincount(place, minlength=len(key))
            own, code = np.divmod(key, max(len(terms), 1))
            own = np.concatenate([np.arange(len(number)), own])
            lang, source = (pa.array([g[i] for g in number], pa.string()).take(pa.array(own)) for i in (0, 1))
            none = len(number)
            term = pa.concat_arrays([pa.nulls(none, pa.string()), terms.cast(pa.string()).take(pa.array(code))])
            zeros = np.zeros(none, np.int64)
            yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([zeros, total])), pa.array(np.concatenate([zeros, docs.astype(np.int64)]))], names=["lang", "source", "term", "n", "docs"])


_UNIT = "lang string, source string, part string, item string, value long"


def _unit(top: int):
    """One unit: kind 0 are groups (n and total: the group's and the language's occurrences of kept terms, size: the kept terms), 1 counts, 2 the language's terms."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        kind = table.column("kind")
        groups, cells, terms = (table.filter(pc.equal(kind, k)) for k in range(3))
        if not len(groups):  # no source fell into these tiles
            return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
        terms = terms.sort_by("term")  # by bytes, so that a lower place is a lesser item
        groups = groups.sort_by("source")
        names, words = groups.column("source").combine_chunks(), terms.column("term").combine_chunks()
        tile = groups.column("tile").to_numpy()
        size = int(groups.column("size")[0].as_py())
        count = np.zeros((len(names), len(words)), np.int64)
        row = pc.index_in(cells.column("source"), names).to_numpy()
        column = pc.index_in(cells.column("term"), words).to_numpy()
        count[row, column] = cells.column("n").to_numpy()
        p = shares(count, groups.column("n").to_numpy(), size)
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        matrix = np.zeros((len(left), len(right)), np.int64)
        strip = max(1, CELLS // max(1, len(right) * len(words)))
        for lo in range(0, len(left), strip):
            matrix[lo : lo + strip] = np.abs(p[left[lo : lo + strip], None, :] - p[None, right, :]).sum(2)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        value = matrix.reshape(-1)
        a, b, value = a[a != b], b[a != b], value[a != b]
        if i != j:
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        source, part, item, out = [names.take(pa.array(a))], ["pair"] * len(a), [names.take(pa.array(b))], [value]
        if i == j and len(words):
            q = shares(terms.column("n").to_numpy()[None, :], groups.column("total").to_numpy()[:1], size)[0]
            for g in left:
                more = np.flatnonzero((count[g] > 0) & (p[g] > q))
                f = p[g, more] - q[more]
                best = np.argsort(-f, kind="stable")[:top]
                source.append(names.take(pa.array(np.full(len(best), g))))
                part += ["term"] * len(best)
                item.append(words.take(pa.array(more[best])))
                out.append(f[best])
        columns = [pa.array([lang] * len(part), pa.string()), pa.concat_arrays(source), pa.array(part, pa.string()), pa.concat_arrays(item), pa.array(np.concatenate(out))]
        return pa.table(columns, names=["lang", "source", "part", "item", "value"])

    return run


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, top: int = 50, terms: int = TERMS, groups: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of a group to the other sources of its language, and the terms it has more of than its language.

    Terms are runs of ASCII letters and all characters beyond ASCII, A-Z
    lower-cased. A language keeps the terms in at least min_docs of its
    documents; let V be their number. Each group of language and source, and
    each language, gives a kept term the share p = 1 + floor(10**9 * (count + 5)
    / (N + 5 * V)), N its occurrences of kept terms. Part `pair`: the sum of
    absolute differences of shares over all kept terms, for each other source,
    all ranks. Part `term`: how much the group's share of a term that it holds
    exceeds the language's, the `top` largest. Rank is by value descending, then
    item by its bytes.

    Null text, language or source count as ''. A group whose texts have no kept
    term still has pairs; a language that keeps none has distances of 0. Rows
    that repeat count each. Other columns are ignored, whatever their names. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    base = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = tk.mapped(base, _counts, "lang string, source string, term string, n long, docs long")
    counts = scratch.write(parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    kept = scratch.write(kept.select("lang", "term", "n"), "kept")
    cells = scratch.write(counts.where("term is not null").join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "cells")
    own = counts.where("term is null").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    langs = own.groupBy("lang").agg(F.count("*").alias("n_groups")).join(kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("total")), "lang", "left")
    langs = langs.select("lang", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0)).alias("total"), F.ceil(F.col("n_groups") / groups).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) / terms)).cast("int").alias("blocks"))
    langs = scratch.write(langs, "langs")

    def numbers(n: F.Column) -> F.Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    tile = F.pmod(F.xxhash64("source"), "tiles").cast("int")
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int")
    columns = ["lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "kind", "tile", "source", "term", "n", "total", "size"]
    no_term, no_number = F.lit(None).cast("string"), F.lit(0).cast("long")
    of_groups = own.join(langs, "lang").select("lang", numbers(F.col("blocks")).alias("block"), tile.alias("tile"), "tiles", F.lit(0).alias("kind"), "source", no_term.alias("term"), F.coalesce("n", F.lit(0)).alias("n"), "total", "size")
    of_cells = cells.join(langs.select("lang", "tiles", "blocks"), "lang").select("lang", block.alias("block"), tile.alias("tile"), "tiles", F.lit(1).alias("kind"), "source", "term", "n", no_number.alias("total"), no_number.alias("size"))
    of_terms = kept.join(langs.select("lang", "tiles", "blocks"), "lang").select("lang", block.alias("block"), numbers(F.col("tiles")).alias("tile"), "tiles", F.lit(2).alias("kind"), no_term.alias("source"), "term", "n", no_number.alias("total"), no_number.alias("size"))
    rows = of_groups.unionByName(of_cells).withColumn("other", numbers(F.col("tiles"))).unionByName(of_terms.withColumn("other", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))).select(*columns)
    found = scratch.write(rows.groupBy("lang", "block", "i", "j").applyInArrow(_unit(top), _UNIT), "found")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    typical = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(typical)
