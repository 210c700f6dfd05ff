"""Removal of long repeated byte strings by distributed bucket-pointer refinement.

A suffix array sorted to depth `length` would put every string that occurs
twice next to its twin. Bucket-pointer refinement reaches that order by giving
each suffix the bucket of its first q bytes and then refining a bucket by the
bucket identifiers of later offsets, dropping suffixes whose bucket is already
a singleton. Only equality at one depth matters here, so buckets are 64-bit
identifiers of substrings (prefix hashes give any of them in constant time, and
a record needs two equal ones to be told repeated) and a refinement is a
shuffle by identifier. Identifiers name contents, so a later round finds those
of an earlier one again from the text instead of reading them:

1. Anchors are positions chosen by their own 16 bytes alone, so equal strings
   have equal anchors. The initial bucket of the starts that precede an anchor
   is the q-gram at the anchor. Starts of a singleton bucket are finished.
2. In a bucket of several anchors, the pointer to the whole stretch of starts
   (all strings from the stretch's first start to the end of its last) refines
   the bucket. A stretch whose pointer occurs twice is repeated as a whole, and
   that answer is reused for all its starts.
3. Stretches that are left, those near the edges of repeats, are refined in the
   same way in classes of a few starts at fixed distances from the anchor, and
   the starts of the classes that are left one by one, by the pair of pointers
   to their two halves.

Every exchange combines equal identifiers of a batch before the shuffle, so a
string that a third of all documents hold sends a few records from each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import textkit as tk
from lodestone.shared import Scratch

ANCHOR_BYTES = 16
#: Starts in a class.
CLASS = 16
#: Records that a pass gathers before it sends them.
FLUSH = 200_000
#: Different stretches of one bucket in a batch from which the batch sends a single record for the bucket.
MANY = 8
#: Ids up to this many are broadcast to pick texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of records that a bucket range should hold.
TASK_BYTES = 8 << 20

#: A row's key.
KEY = ["doc", "twin"]
#: What is known of a stretch of starts.
REPEATED, SHOWN, OPEN = 1, 2, 3  # repeated; repeated and shown to others; to be refined start by start
RECORD = np.dtype([("bucket", "u8"), ("pointer", "u8"), ("doc", "i8"), ("twin", "i8"), ("place", "u4"), ("flags", "u1")])
#: Flags of a record: nobody waits for an answer; it stands for several; its bucket has several stretches; a single start.
SILENT, SEVERAL, MIXED, SINGLE = 1, 2, 4, 8


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Stretches of starts in a chunk: text, lo, hi (absolute, inclusive), the anchor, and single where there is no anchor near."""
    q = length * 7 // 25
    reach = length - q
    n = len(data)
    grams = tk.gram_hashes(data, ANCHOR_BYTES)
    density = max(reach // 6, 1)
    at = np.flatnonzero(grams < tk.U64((1 << 64) // density - 1))
    owner = np.searchsorted(offsets, at, "right") - 1
    good = at + ANCHOR_BYTES <= offsets[owner + 1]
    at, owner = at[good], owner[good]
    size = np.diff(offsets)
    last = offsets[1:] - length  # the last start of each text
    long_enough = size >= length
    keep = long_enough[owner] if len(owner) else np.zeros(0, bool)
    at, owner = at[keep], owner[keep]
    before = np.empty(len(at), np.int64)
    if len(at):
        before[0] = -1
        before[1:] = at[:-1]
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        before[first] = offsets[owner[first]] - 1
    hi = np.minimum(at, last[owner])
    lo = np.maximum(before + 1, at - reach)
    use = lo <= hi
    text, lo, hi, anchor = owner[use], lo[use], hi[use], at[use]
    covered = np.zeros(n + 1, np.int32)
    np.add.at(covered, lo, 1)
    np.add.at(covered, hi + 1, -1)
    np.add.at(covered, offsets[:-1][long_enough], -1)
    np.add.at(covered, last[long_enough] + 1, 1)
    lone = np.flatnonzero(np.cumsum(covered[:-1]) < 0)
    lone_text = np.searchsorted(offsets, lone, "right") - 1
    return {
        "text": np.concatenate([text, lone_text]),
        "lo": np.concatenate([lo, lone]),
        "hi": np.concatenate([hi, lone]),
        "anchor": np.concatenate([anchor, lone]),
        "single": np.concatenate([np.zeros(len(lo), bool), np.ones(len(lone), bool)]),
    }


def _records(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    hashes = tk.PrefixHash(data)
    s = _stretches(data, offsets, length)
    q = length * 7 // 25
    out = np.empty(len(s["lo"]), RECORD)
    end = np.where(s["single"], s["lo"] + length, s["anchor"] + q)
    out["bucket"] = hashes.at(np.where(s["single"], s["lo"], s["anchor"]), end)
    out["pointer"] = hashes.at(s["lo"], s["hi"] + length)
    out["doc"], out["twin"] = docs[s["text"]].T
    out["place"] = s["lo"] - offsets[s["text"]]
    out["flags"] = np.where(s["single"], SINGLE, 0)
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a sorted row begins a run of equal keys, and each row's run."""
    fresh = np.zeros(len(keys[0]), bool)
    if len(fresh):
        fresh[0] = True
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
    return fresh, np.cumsum(fresh) - 1


def _combined(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a batch sends of its records, and the records it can answer itself with their answers."""
    records = records[np.lexsort((records["pointer"], records["bucket"]))]
    fresh, run = _runs(records["bucket"], records["pointer"])
    count = np.bincount(run) if len(run) else np.zeros(0, np.int64)
    firsts = records[fresh].copy()
    firsts["flags"] |= np.where(count >= 2, SEVERAL, 0).astype("u1")
    known = [records[~fresh]]
    answers = [np.full(len(known[0]), REPEATED, "u4")]
    begins, group = _runs(firsts["bucket"])
    many = np.bincount(group) >= MANY if len(group) else np.zeros(0, bool)
    if many.any():
        big = many[group]
        known.append(firsts[big])
        answers.append(np.where(firsts["flags"][big] & SEVERAL, SHOWN, OPEN).astype("u4"))
        marks = firsts[big & begins].copy()
        marks["flags"] |= np.uint8(SILENT | SEVERAL | MIXED)
        firsts = np.concatenate([firsts[~big], marks])
    return firsts, np.concatenate(known), np.concatenate(answers)


def _answered(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Answers to the records of one bucket range; records of singleton buckets get none."""
    records = records[np.lexsort((records["flags"] & SILENT, records["pointer"], records["bucket"]))]
    fresh, run = _runs(records["bucket"], records["pointer"])
    begins, group = _runs(records["bucket"])
    if not len(records):
        return records, np.zeros(0, "u4")
    weight = np.where(records["flags"] & SEVERAL, 2, 1)
    total = np.bincount(group, weight)
    twice = np.bincount(run, weight)[run] >= 2
    stretches = np.bincount(group, fresh)
    mixed = (stretches > 1) | (np.bincount(group, (records["flags"] & MIXED) > 0) > 0)
    answer = np.where(twice, np.where(fresh & mixed[group], SHOWN, REPEATED), OPEN)
    wait = (total[group] >= 2) & ((records["flags"] & SILENT) == 0)
    return records[wait], answer[wait].astype("u4")


def _packed(records: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Answers by document: documents (n x 2) and for each the (place * 4 + answer) values as bytes."""
    if not len(records):
        return np.zeros((0, 2), np.int64), []
    order = np.lexsort((records["twin"], records["doc"]))
    docs = np.stack([records["doc"][order], records["twin"][order]], 1)
    cells = (records["place"][order].astype("u8") << np.uint64(2) | answers[order]).astype("u8")
    edges = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]).any(1), [True]]))
    return docs[edges[:-1]], [cells[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _routed(records: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """Records by bucket range."""
    part = (records["bucket"] >> np.uint64(32)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    return [int(p) for p in part[edges[:-1]]], [records[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _rows(sent: np.ndarray, known: np.ndarray, answers: np.ndarray, parts: int) -> pa.RecordBatch:
    """What a batch hands on: records by bucket range (doc null) and its own answers (part by document)."""
    part, payload = _routed(sent, parts)
    docs, cells = _packed(known, answers)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part + (docs[:, 0] % parts).tolist(), pa.int32()),
            *(pa.array([None] * len(part) + docs[:, i].tolist(), pa.int64()) for i in (0, 1)),
            pa.array(payload + cells, pa.binary()),
        ],
        names=["part", "doc", "twin", "payload"],
    )


_EXCHANGE = "part int, doc long, twin long, payload binary"
_ANSWERS = "doc long, twin long, payload binary"


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The two halves of the rows' keys, the first two columns (n x 2)."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)


def _first_pass(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            docs = _keys(batch)
            for lo, hi, data, offsets in tk.chunks(batch.column(2)):
                found.append(_records(data, offsets, docs[lo:hi], length))
                if sum(map(len, found)) >= FLUSH:
                    yield _rows(*_combined(np.concatenate(found)), parts)
                    found = []
        if found:
            yield _rows(*_combined(np.concatenate(found)), parts)

    return run


def _answer_part(table: pa.Table) -> pa.Table:
    """One bucket range: answers to its records, after the answers that batches gave themselves."""
    own, records = _parted(table)
    return _told(own, *_answered(records))


def _parted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The answers that batches gave themselves, and the records of a bucket range."""
    doc = table.column("doc")
    payload = table.filter(doc.is_null()).column("payload")
    return table.filter(doc.is_valid()).select(["doc", "twin", "payload"]), np.frombuffer(b"".join(memoryview(x.as_buffer()) for x in payload), RECORD)


def _told(own: pa.Table, records: np.ndarray, answers: np.ndarray) -> pa.Table:
    docs, cells = _packed(records, answers)
    return pa.concat_tables([own, pa.table({"doc": docs[:, 0], "twin": docs[:, 1], "payload": pa.array(cells, pa.binary())})])


def _merged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and answers of one document; where a place has several, the one that shows the most."""
    cells = np.unique(np.frombuffer(b"".join(parts), "u8"))
    place, answer = (cells >> np.uint64(2)).astype(np.int64), (cells & np.uint64(3)).astype(np.int64)
    last = np.concatenate([place[1:] != place[:-1], [True]]) if len(place) else np.zeros(0, bool)
    return place[last], answer[last]


def _spans(starts_lo: np.ndarray, starts_hi: np.ndarray, length: int) -> np.ndarray:
    """Maximal covered runs (m x 2) of inclusive ranges of starts of strings of that length."""
    if not len(starts_lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts_lo, kind="stable")
    lo, end = starts_lo[order], np.maximum.accumulate(starts_hi[order] + length)
    fresh = np.concatenate([[True], lo[1:] > end[:-1]])
    edge = np.flatnonzero(fresh)
    return np.stack([lo[edge], end[np.concatenate([edge[1:] - 1, [len(lo) - 1]])]], 1)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _classes(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches cut into classes of starts by their distance from the anchor: lo, hi and the stretch of each."""
    first, last = (anchor - hi) // CLASS, (anchor - lo) // CLASS
    n = last - first + 1
    of = np.repeat(np.arange(len(lo)), n)
    k = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return np.maximum(lo[of], anchor[of] - CLASS * k - CLASS + 1), np.minimum(hi[of], anchor[of] - CLASS * k), of


def _refine(length: int, parts: int, single: bool):
    """Texts with answers: what is known to be repeated by now, and the records of the next level, classes or single starts."""
    half = length // 2

    def classes(hashes: tk.PrefixHash, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b, of = _classes(lo, hi, anchor)
        # The bytes that the strings of a whole class have in common, wherever a stretch cuts it.
        core = anchor[of] - (anchor[of] - b) // CLASS * CLASS
        return a, b, of, hashes.at(core, core - CLASS + 1 + length), hashes.at(a, b + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = _keys(batch), batch.column(2)
            cells, before = batch.column(3), batch.column(4)
            for lo, hi, data, offsets in tk.chunks(texts):
                hashes = tk.PrefixHash(data)
                s = _stretches(data, offsets, length)
                s = {k: v[np.lexsort((s["lo"], s["text"]))] for k, v in s.items()}
                if single:  # the answers are about the classes
                    plain = ~s["single"]
                    a, b, of = _classes(s["lo"][plain], s["hi"][plain], s["anchor"][plain])
                    s = {"lo": a, "hi": b, **{k: s[k][plain][of] for k in ("text", "anchor", "single")}}
                    s = {k: v[np.lexsort((s["lo"], s["text"]))] for k, v in s.items()}
                begin = np.searchsorted(s["text"], np.arange(hi - lo + 1))
                state, sent, opened = [], [], np.zeros(hi - lo, bool)
                for i in range(lo, hi):
                    a, base = begin[i - lo], offsets[i - lo]
                    place, answer = _merged(cells[i].as_py() or [])
                    index = a + np.searchsorted(s["lo"][a : begin[i - lo + 1]] - base, place)
                    lows, highs, anchor = s["lo"][index], s["hi"][index], s["anchor"][index]
                    done = answer != OPEN
                    state.append((before[i].as_py() or b"") + np.stack([lows[done] - base, highs[done] - base], 1).astype("i8").tobytes())
                    for one, flag in ((answer == OPEN, 0), (answer == SHOWN, SEVERAL)):
                        one = one & ~s["single"][index]
                        if not one.any():
                            continue
                        if single:
                            size = highs[one] - lows[one] + 1
                            at = np.repeat(lows[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                            bucket, pointer = hashes.at(at, at + half), hashes.at(at + half, at + length)
                            flag = SILENT if flag else 0
                        else:
                            at, _, _, bucket, pointer = classes(hashes, lows[one], highs[one], anchor[one])
                        r = np.empty(len(at), RECORD)
                        r["bucket"], r["pointer"], r["place"], r["flags"] = bucket, pointer, at - base, flag
                        r["doc"], r["twin"] = docs[i]
                        sent.append(r)
                        opened[i - lo] = True
                if sent:
                    records = np.concatenate(sent)
                    yield _state_rows(_rows(*(_combined_starts(records) if single else _combined(records)), parts))
                own = pa.RecordBatch.from_arrays([pa.nulls(hi - lo, pa.int32()), *(pa.array(docs[lo:hi, k], pa.int64()) for k in (0, 1)), pa.array(state, pa.binary())], names=["part", "doc", "twin", "payload"])
                yield _state_rows(own, texts.slice(lo, hi - lo).cast(pa.string()), opened)

    return run


def _state_rows(rows: pa.RecordBatch, text: pa.Array | None = None, opened: np.ndarray | None = None) -> pa.RecordBatch:
    text = text if text is not None else pa.nulls(len(rows), pa.string())
    opened = pa.array(opened, pa.bool_()) if opened is not None else pa.nulls(len(rows), pa.bool_())
    return pa.RecordBatch.from_arrays([*rows.columns, text, opened], names=["part", "doc", "twin", "payload", "text", "opened"])


def _combined_starts(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _combined, for single starts: equal pairs of pointers meet in the batch first."""
    records = records[np.lexsort((records["flags"], records["pointer"], records["bucket"]))]
    fresh, run = _runs(records["bucket"], records["pointer"])
    count = np.bincount(run)
    # A start that was shown already stands for several, so those beside it are repeated.
    twice = np.maximum(count, np.bincount(run, (records["flags"] & SILENT) * 2.0)) >= 2
    known = records[twice[run] & ((records["flags"] & SILENT) == 0)]
    sent = records[fresh].copy()
    sent["flags"] = np.where(twice, SILENT | SEVERAL, sent["flags"]).astype("u1")
    return sent, known, np.full(len(known), REPEATED, "u4")


def _answer_starts(table: pa.Table) -> pa.Table:
    own, records = _parted(table)
    records = records[np.lexsort((records["pointer"], records["bucket"]))]
    fresh, run = _runs(records["bucket"], records["pointer"])
    weight = np.where(records["flags"] & SEVERAL, 2, 1)
    found = records[(np.bincount(run, weight)[run] >= 2) & ((records["flags"] & SILENT) == 0)] if len(records) else records
    return _told(own, found, np.full(len(found), REPEATED, "u4"))


def _result(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, state, cells in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                raw = (text.as_py() or "").encode()
                ranges = np.frombuffer(state.as_py() or b"", "i8").reshape(-1, 2)
                single = _merged(cells.as_py() or [])[0]
                spans = _spans(np.concatenate([ranges[:, 0], single]), np.concatenate([ranges[:, 1], single]), length)
                rest = _kept(raw, spans)
                out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(rest).hexdigest(), spans.astype("i8").tobytes(), rest))
            n, removed, n_spans, digest, spans, rest = zip(*out, strict=True) if out else ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array([np.frombuffer(x, "i8").tolist() for x in spans], pa.list_(pa.int64())),
                    pa.array([x.decode(errors="ignore") for x in rest], pa.string()),
                ],
                names=["doc", "twin", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"],
            )

    return run


def repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per row of docs: n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text, beside all columns of docs but the text.

    Every byte that lies in a string of `length` bytes which starts at two or
    more places (overlaps and the same text included) is removed. Strings are
    judged on the texts as given and never cross texts. spans holds start and
    end of each maximal removed run; kept_text leaves out a character that a
    cut divides, kept_sha256 is of the remaining bytes.

    Null text counts as empty: nothing is removed. Null and repeated ids are
    fine: a row is known by id and text together, and rows that repeat both
    share one result, each being a copy of the other. length must be at least
    64. Columns of docs whose names the result uses are replaced. An empty
    table gives no rows.
    """
    if length < 64:
        raise ValueError("length must be at least 64 bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Two hashes of id and text know a row.
    doc, twin = F.xxhash64(F.col(f"`{id_col}`"), text), F.xxhash64(text, F.lit(1), F.col(f"`{id_col}`"))
    base = docs.select(doc.alias("doc"), twin.alias("twin"), text.alias("text"))
    volume = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * volume // TASK_BYTES))

    exchange = tk.mapped(base, _first_pass(length, parts), _EXCHANGE)
    answers = exchange.groupBy("part").applyInArrow(_answer_part, _ANSWERS)
    answers = scratch.write(answers, "answers")
    cells = answers.groupBy(KEY).agg(F.collect_list("payload").alias("cells"))
    ids = scratch.write(answers.select(KEY).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    touched = base.join(side, KEY, "left_semi")
    schema = "part int, doc long, twin long, payload binary, text string, opened boolean"
    first = touched.join(cells, KEY).select(*KEY, "text", "cells", F.lit(None).cast("binary").alias("before"))
    first = scratch.write(tk.mapped(first, _refine(length, parts, False), schema), "classes")
    scratch.drop("answers")

    def answered(rows: DataFrame, answer, tag: str) -> DataFrame:
        own = rows.where("opened is null").select("part", *KEY, "payload").groupBy("part").applyInArrow(answer, _ANSWERS)
        return scratch.write(own, tag).groupBy(KEY).agg(F.collect_list("payload").alias("cells"))

    cells = answered(first, _answer_part, "class-answers")
    second = first.where("opened").select(*KEY, "text", F.col("payload").alias("before")).join(cells, KEY, "left").select(*KEY, "text", "cells", "before")
    second = scratch.write(tk.mapped(second, _refine(length, parts, True), schema), "starts")
    cells = answered(second, _answer_starts, "start-answers")
    nothing = F.lit(None).cast("array<binary>").alias("cells")
    done = first.where("not opened").select(*KEY, "text", "payload", nothing)
    done = done.unionByName(second.where("not opened").select(*KEY, "text", "payload", nothing))
    done = done.unionByName(second.where("opened").select(*KEY, "text", "payload").join(cells, KEY, "left"))
    schema = "doc long, twin long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept_text string"
    done = scratch.write(tk.mapped(done, _result(length), schema).where("n_spans > 0").dropDuplicates(KEY), "done")
    scratch.drop("ids", "classes", "starts", "class-answers", "start-answers")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
    keep = [c for c in docs.columns if c != text_col and c not in names]
    # Own names for all columns until the end, so those of docs may be any.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), doc.alias("doc"), twin.alias("twin"), text.alias("text"))
    changed = done.select(KEY)
    changed = F.broadcast(changed) if changed.count() <= BROADCAST_IDS else changed
    whole = {"n_bytes": F.octet_length("text").cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2("text", 256), "spans": F.array().cast("array<long>"), "kept_text": F.col("text")}
    plain = named.join(changed, KEY, "left_anti").select("row", *[whole[c].alias(c) for c in names])
    cut = named.drop("text").join(changed, KEY, "left_semi").join(done, KEY).select("row", *names)
    out = plain.unionByName(cut)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *names)
