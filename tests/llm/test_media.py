import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestone.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    p = media.payload(raw)
    (f,) = media.write_gifs([p])
    assert b"".join(x.samples.tobytes() for x in media.read_gif(f).frames) == p


@pytest.mark.parametrize("raw", [b"", b"\0" * 64, b"a" * 200_000, bytes(range(256)) * 300, np.random.default_rng(0).integers(0, 256, 70_001, np.uint8).tobytes()])
def test_long_and_flat(raw):
    p = media.payload(raw)
    assert len(p) % 64 == 0 and len(p) > 0
    one, two = media.write_gifs([p, p])
    assert one == two
    g = media.read_gif(one)
    assert b"".join(x.samples.tobytes() for x in g.frames) == p
    assert len(g.frames) == -(-len(p) // (64 * 1024))


def lzw_by_hand(codes, clear):
    """A plain decoder of a code list."""
    out, table, last = bytearray(), {}, None
    for c in codes:
        if c == clear:
            table, last = {i: bytes([i]) for i in range(clear)}, None
            continue
        if c == clear + 1:
            break
        s = table[c] if c in table else last + last[:1]
        out += s
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + s[:1]
        last = s
    return bytes(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(b"abcab\x00\xff"), max_size=6000).map(bytes))
def test_codes_against_plain_decoder(raw):
    codes = media.lzw_codes(raw)
    assert lzw_by_hand(codes, 256) == raw
    (stream,) = media.packed([codes])
    assert media.lzw_samples(stream, 8).tobytes() == raw


def gif(frames, width=2, height=2, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A small file with 2-bit samples, uncompressed in the way of clear codes."""
    out = b"GIF89a" + bytes([width, 0, height, 0, 0x91, 0, 0]) + bytes(c for rgb in colours for c in rgb)
    for left, top, w, h, samples, delay, disposal, transparent in frames:
        flags = disposal << 2 | (transparent >= 0)
        out += bytes([0x21, 0xF9, 4, flags, delay, 0, max(transparent, 0), 0, 0x2C, left, 0, top, 0, w, 0, h, 0, 0, 2])
        bits = "".join(f"{c:03b}"[::-1] for s in samples for c in (4, s)) + f"{5:03b}"[::-1]
        bits += "0" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_disposal_and_transparency():
    data = gif([(0, 0, 2, 2, [1, 1, 1, 1], 5, 1, -1), (0, 0, 1, 1, [2], 7, 3, -1), (1, 1, 1, 1, [3], 9, 2, -1), (0, 0, 2, 1, [0, 2], 4, 0, 0)])
    seen = [c.tolist() for c in media.composed(media.read_gif(data))]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert seen == [[[red, red], [red, red]], [[green, red], [red, red]], [[red, red], [red, blue]], [[red, green], [red, none]]]


def test_stored_text_as_it_is_seen(spark):
    """The stored frames' colour histograms against a plain loop over pixels."""
    raw = bytes(np.random.default_rng(3).integers(0, 4, 64 * 1024 * 3 + 700, np.uint8) * 77) + b"tail"
    docs = spark.createDataFrame([(1, raw.decode("latin-1"))], "doc_id long, text string")
    p = media.payload(raw.decode("latin-1").encode())
    (row,) = media.read_samples(media.store_texts(docs)).collect()
    assert bytes(row["samples"]) == p
    canvas, want = {}, [0] * 48
    for k in range(0, len(p), 65536):
        before = dict(canvas)
        part = {i: v for i, v in enumerate(p[k : k + 65536])}
        canvas |= {i: v for i, v in part.items() if v}
        for v in canvas.values():
            for c, x in enumerate((v >> 5 << 5, (v >> 2 & 7) << 5, (v & 3) << 6)):
                want[16 * c + x // 16] += 1
        how = (1, 2, 3)[k // 65536 % 3]
        canvas = {i: v for i, v in canvas.items() if i not in part} if how == 2 else before if how == 3 else canvas
    assert row["histogram"] == want and row["duration_cs"] == 10 * row["n_frames"]


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"not a gif at all", gif([(0, 0, 2, 2, [1, 1, 1, 1], 5, 1, -1)])[:-9]])
def test_damaged(data):
    with pytest.raises(ValueError):
        media.read_gif(data)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "hello", "m"), (2, None, "m"), (2, "x" * 100_000, None), (2, "x" * 100_000, None)], "doc_id long, text string, media string")
    stored = media.store_texts(docs)
    assert stored.columns == ["doc_id", "media", "n_bytes"]
    rows = media.read_samples(stored).collect()
    assert sorted((r["doc_id"], r["n_bytes"], len(r["samples"]), r["n_frames"]) for r in rows) == [(1, 5, 64, 1), (2, 0, 64, 1), (2, 100_000, 100_032, 2), (2, 100_000, 100_032, 2)]
    bad = spark.createDataFrame([(1, bytearray(gif([(0, 0, 2, 2, [1, 1, 1, 1], 5, 1, -1)]))), (2, bytearray(b"zz")), (3, None)], "doc_id long, media binary")
    assert sorted((r["doc_id"], r["n_frames"]) for r in media.read_samples(bad).collect() if r["n_frames"]) == [(1, 1)]
    (frame,) = media.read_frames(bad).collect()
    assert (frame["id"], frame["frame"], frame["start_cs"], frame["duration_cs"], sum(frame["histogram"])) == (1, 0, 0, 5, 12)
    assert media.read_samples(media.store_texts(docs.limit(0))).count() == 0
