"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

Decoding a stream needs no loop over its codes. The place and width of a code
follow from its number since the last clear code; entry k of the table is the
string of code k and the byte after it, which stand next to each other in the
output; so each output byte points to an earlier one, and doubling the pointers
leads all of them to literals in a few steps.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import textkit as tk

#: Samples in a row and rows in a frame of a stored payload; the frame's time in hundredths of a second.
ROW, ROWS, DELAY = 64, 1024, 10
BINS = 16


# -- LZW ---------------------------------------------------------------------


def _widths(first: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code, for a table whose first free code is `first`."""
    free = first + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), 0, 12)


_FULL = _widths(258, 4096)


def lzw_codes(data: bytes) -> list[int]:
    """Codes of 8-bit samples, clear code first, end code last; the table is cleared before it is full."""
    out, table, free = [256], {}, 258
    if not data:
        return [256, 257]
    get, put = table.get, out.append
    letters = iter(data)
    held = next(letters)
    for b in letters:
        key = held << 8 | b
        longer = get(key)
        if longer is not None:
            held = longer
        else:
            put(held)
            table[key] = free
            free += 1
            held = b
            if free == 4095:
                put(256)
                table.clear()
                free = 258
    put(held)
    put(257)
    return out


def packed(streams: list[list[int]]) -> list[bytes]:
    """The bits of code streams of 8-bit samples, each from a byte's lowest bit."""
    count = np.array([len(s) for s in streams])
    codes = np.array([c for s in streams for c in s], np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    place = np.arange(len(codes))
    clear = np.maximum.accumulate(np.where(codes == 256, place, -1))
    before = np.concatenate([[-1], clear[:-1]])
    begins = np.zeros(len(codes), bool)
    begins[first] = True
    width = np.where(begins, 9, _FULL[np.clip(place - before - 1, 0, 4095)])
    end = np.cumsum(width)
    bits_of = np.add.reduceat(width, first)
    size = -(-bits_of // 8)
    base = np.concatenate([[0], np.cumsum(size)[:-1]]) * 8
    at = end - width - np.repeat(end[first] - width[first], count) + np.repeat(base, count)
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    for b in range(12):
        use = width > b
        bits[at[use] + b] = codes[use] >> b & 1
    whole = np.packbits(bits, bitorder="little").tobytes()
    edges = [*(base // 8).tolist(), int(size.sum())]
    return [whole[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    n, first = len(codes), clear + 2
    if not n:
        return np.zeros(0, np.uint8)
    if codes[0] >= clear or (codes - first >= np.arange(n)).any():
        raise ValueError("a code isn't in the table yet")
    size = np.ones(n, np.int64)
    left = np.flatnonzero(codes >= first)
    ahead = codes[left]
    while len(left):
        size[left] += 1
        ahead = codes[ahead - first]
        more = ahead >= first
        left, ahead = left[more], ahead[more]
    end = np.cumsum(size)
    start = end - size
    source = np.arange(end[-1])
    literal = codes < clear
    origin = np.where(literal, start, start[np.where(literal, 0, codes - first)])
    source += np.repeat(origin - start, size)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    value = np.zeros(end[-1], np.uint8)
    value[start[literal]] = codes[literal]
    return value[source]


def lzw_samples(stream: bytes, bits: int) -> np.ndarray:
    """Samples of a code stream whose literals have so many bits; it may lack its end code."""
    clear = 1 << bits
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out = len(stream) * 8, 0, []
    while at < total:
        most = (total - at) // (bits + 1) + 1
        step = min(most, 4200)
        width = _FULL[:step] if bits == 8 and step <= 4096 else _widths(clear + 2, step)
        place = at + np.cumsum(width) - width
        place = place[place + width <= total]
        if not len(place):
            break
        width = width[: len(place)]
        word = raw[place >> 3] | raw[(place >> 3) + 1] << 8 | raw[(place >> 3) + 2] << 16
        codes = word >> (place & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop) and len(place) == step and step < most:  # a full table that goes on
            width = _widths(clear + 2, most)
            place = at + np.cumsum(width) - width
            place = place[place + width <= total]
            width = width[: len(place)]
            word = raw[place >> 3] | raw[(place >> 3) + 1] << 8 | raw[(place >> 3) + 2] << 16
            codes = word >> (place & 7) & ((1 << width) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        end = int(stop[0]) if len(stop) else len(codes)
        out.append(_expanded(codes[:end], clear))
        if not len(stop) or codes[end] == clear + 1:
            break
        at = int(place[end] + width[end])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


# -- Files -------------------------------------------------------------------


@dataclass
class Frame:
    """One image of a file: its place, sample values, palette, time and what becomes of it."""

    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int = -1


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(out), at + 1


def _deinterlaced(samples: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.zeros((height, width), np.uint8)
    out[rows] = samples.reshape(height, width)
    return out.reshape(-1)


def read_gif(data: bytes) -> Gif:
    """All frames of a file. Damaged files raise ValueError; missing samples of a short stream are 0."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF file")
        width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at = 13
        shared = np.zeros((256, 3), np.uint8)
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared[:n] = np.frombuffer(data, np.uint8, n * 3, at).reshape(-1, 3)
            at += n * 3
        out, delay, disposal, transparent = Gif(width, height), 0, 0, -1
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9:
                    disposal = body[0] >> 2 & 7
                    delay = body[1] | body[2] << 8
                    transparent = body[3] if body[0] & 1 else -1
            elif data[at] == 0x2C:
                left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = shared
                if own & 0x80:
                    n = 2 << (own & 7)
                    palette = np.zeros((256, 3), np.uint8)
                    palette[:n] = np.frombuffer(data, np.uint8, n * 3, at).reshape(-1, 3)
                    at += n * 3
                bits = data[at]
                stream, at = _blocks(data, at + 1)
                samples = lzw_samples(stream, bits)[: w * h]
                if len(samples) < w * h:
                    samples = np.concatenate([samples, np.zeros(w * h - len(samples), np.uint8)])
                if own & 0x40:
                    samples = _deinterlaced(samples, w, h)
                out.frames.append(Frame(left, top, w, h, samples, palette, delay, disposal, transparent))
                delay, disposal, transparent = 0, 0, -1
            else:
                raise ValueError("unknown block")
        return out
    except (IndexError, struct.error) as e:
        raise ValueError(f"cut or damaged GIF file: {e}") from e


def composed(gif: Gif) -> Iterator[np.ndarray]:
    """What is seen during each frame: height x width x 4 (red, green, blue, opacity)."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        box = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = f.samples.reshape(f.height, f.width)[: box.shape[0], : box.shape[1]]
        shown = samples != f.transparent
        box[shown, :3] = f.palette[samples[shown]]
        box[shown, 3] = 255
        yield canvas.copy()
        if f.disposal == 2:
            box[:] = 0
        elif f.disposal == 3:
            canvas = before


#: Colours of a stored payload's samples: three bits of red, three of green, two of blue.
_COLOURS = np.stack([np.arange(256) >> 5 << 5, (np.arange(256) >> 2 & 7) << 5, (np.arange(256) & 3) << 6], 1).astype(np.uint8).tobytes()
#: The sample value that isn't seen, and what becomes of the frames of a stored payload in turn: kept, cleared, undone.
UNSEEN, DISPOSALS = 0, (1, 2, 3)


def payload(raw: bytes) -> bytes:
    """raw and bytes 0 up to a positive multiple of ROW."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def write_gifs(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload: 8-bit samples on a colour palette, ROW in a row, ROWS rows in a timed frame.

    Frames lie over each other from the top left. Samples of value UNSEEN are
    transparent when a file is shown; they are stored as all others.
    """
    cuts = [[p[a : a + ROW * ROWS] for a in range(0, len(p), ROW * ROWS)] for p in payloads]
    streams = iter(packed([lzw_codes(c) for own in cuts for c in own]))
    out = []
    for own in cuts:
        part = [b"GIF89a", struct.pack("<HHBBB", ROW, len(own[0]) // ROW, 0xF7, 0, 0), _COLOURS]
        for k, c in enumerate(own):
            stream = next(streams)
            part += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, DISPOSALS[k % 3] << 2 | 1, DELAY, UNSEEN, 0), struct.pack("<BHHHHBB", 0x2C, 0, 0, ROW, len(c) // ROW, 0, 8)]
            part += [bytes([len(stream[a : a + 255])]) + stream[a : a + 255] for a in range(0, len(stream), 255)]
            part.append(b"\0")
        out.append(b"".join([*part, b"\x3b"]))
    return out


# -- DataFrames --------------------------------------------------------------


def store_texts(docs: DataFrame, *, text_col: str = "text", media_col: str = "media", batch_bytes: int = 1 << 20) -> DataFrame:
    """docs without the text, with media_col (a GIF file that holds the UTF-8 bytes losslessly) and n_bytes.

    Null text counts as empty; every file holds at least one row of samples.
    Columns named as the results are replaced, all others stay.
    """
    rest = [c for c in docs.columns if c not in (text_col, media_col, "n_bytes")]
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, n = 0, len(batch)
            raw = [(t or "").encode() for t in batch.column(len(rest)).to_pylist()]
            while lo < n:
                hi, size = lo, 0
                while hi < n and (hi == lo or size + len(raw[hi]) <= batch_bytes):
                    size += len(raw[hi])
                    hi += 1
                files = write_gifs([payload(x) for x in raw[lo:hi]])
                kept = batch.slice(lo, hi - lo).columns[: len(rest)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(files, pa.binary()), pa.array([len(x) for x in raw[lo:hi]], pa.int64())], names=[*rest, media_col, "n_bytes"])
                lo = hi

    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn(media_col, F.lit(b"")).withColumn("n_bytes", F.lit(0).cast("long")).schema
    return tk.mapped(frame, run, schema)


def colour_histogram(seen: np.ndarray) -> np.ndarray:
    """Visible pixels of a frame as it is seen by their red, then green, then blue, in BINS classes each."""
    flat = seen.reshape(-1, 4)
    solid = flat if flat[:, 3].all() else flat[flat[:, 3] == 255]
    return np.concatenate([np.bincount(solid[:, c] // (256 // BINS), minlength=BINS) for c in range(3)])


def read_samples(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """media with what its files hold: samples (all frames' sample values in order), n_frames, duration_cs, histogram.

    histogram is the sum of the colour histograms of the frames as they are seen
    one after the other, by palettes, disposal and transparency.
    Null or damaged files give null in all four. Columns with these names are replaced.
    """
    names = ["samples", "n_frames", "duration_cs", "histogram"]
    rest = [c for c in media.columns if c not in names]
    place = rest.index(media_col)
    frame = media.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                found = []
                for data in part.column(place):
                    try:
                        g = read_gif(data.as_py() or b"")
                        found.append((b"".join(f.samples.tobytes() for f in g.frames), len(g.frames), sum(f.delay for f in g.frames), sum((colour_histogram(x) for x in composed(g)), np.zeros(3 * BINS, np.int64)).tolist()))
                    except ValueError:
                        found.append((None, None, None, None))
                columns = zip(*found, strict=True)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[*rest, *names])

    schema = frame.selectExpr(*[f"`{c}`" for c in rest], "cast('' as binary) samples", "0L n_frames", "0L duration_cs", "cast(array() as array<bigint>) histogram").schema
    for f in schema.fields[-4:]:
        f.nullable = True
    return tk.mapped(frame, run, schema)


def read_frames(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame as it is seen: id, frame, start_cs, duration_cs, width, height, rgba, histogram (red, green, blue of BINS classes each).

    Null and damaged files give no rows.
    """
    frame = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))
    names = ["id", "frame", "start_cs", "duration_cs", "width", "height", "rgba", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                try:
                    g = read_gif(data.as_py() or b"")
                except ValueError:
                    continue
                start = 0
                for k, (f, seen) in enumerate(zip(g.frames, composed(g), strict=True)):
                    bins = colour_histogram(seen).tolist()
                    values = [batch.column(0).slice(i, 1), *(pa.array([v], t) for v, t in ((k, pa.int64()), (start, pa.int64()), (f.delay, pa.int64()), (g.width, pa.int64()), (g.height, pa.int64()), (seen.tobytes(), pa.binary()), (bins, pa.list_(pa.int64()))))]
                    yield pa.RecordBatch.from_arrays(values, names=names)
                    start += f.delay

    kind = frame.schema["id"].dataType.simpleString()
    return tk.mapped(frame, run, f"id {kind}, frame long, start_cs long, duration_cs long, width long, height long, rgba binary, histogram array<long>")
