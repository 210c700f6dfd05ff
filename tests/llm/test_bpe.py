import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe
from lodestone.llm.queries import tokenised, tokenizer_path

PATH = tokenizer_path()
TEXTS = ["", "a", "hello world", "aaaaaaaaaaaaaaaaaaaa", "  \n\t  x", "don't we'll 12345 ...!!", "ünïcödé 漢字 \U0001f600\U0001f600", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "abc " * 3000, "\x00\x7f ", "ththeationthe" * 40]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_round_trip(reference, text):
    ids = ids_of(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).decode(np.array(ids, int)).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids_of(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if len(text) < 3 else bpe.codec(PATH).decode(np.array(ids_of(text), int)).decode() == text


def merged(codec, raw):
    """Merges by rank, one at a time."""
    parts = [codec.vocab[raw[i : i + 1]] for i in range(len(raw))]
    while True:
        best = min(((codec.rank[w], i) for i in range(len(parts) - 1) if (w := codec.merges.get(parts[i] << 32 | parts[i + 1])) is not None), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [codec.merges[parts[i] << 32 | parts[i + 1]]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehintorsé ", min_size=1, max_size=40))
def test_backtracking_equals_merging(text):
    codec = bpe.codec(PATH)
    raw = text.encode()
    assert codec._encoded(raw) == merged(codec, raw)


def test_pieces_in_use_are_remembered(monkeypatch):
    """New pieces push out those out of use, not all: ' theur' is encoded once."""
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    codec, encoded = bpe.Codec(PATH), []
    own = codec._encoded
    monkeypatch.setattr(codec, "_encoded", lambda raw: encoded.append(raw) or own(raw))
    for i in range(500):
        codec.encode(f" theur qzx{chr(97 + i % 26)}{chr(97 + i // 26)}vkj")
    assert encoded.count(b" theur") == 1
    assert len(codec) + len(codec.older) <= 100
    codec.clear()
    assert not codec and not codec.older


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 50255), st.integers(0, 50255))
def test_seams_equal_merging(left, right):
    codec = bpe.codec(PATH)
    spelling = {i: b for b, i in codec.vocab.items()}
    if left in spelling and right in spelling:
        assert codec.compatible(left, right) == (merged(codec, spelling[left] + spelling[right]) == [left, right])


def test_unknown_id():
    with pytest.raises(IndexError):
        bpe.codec(PATH).decode(np.array([10**6]))


def test_frames(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "dup", "y"), (3, "dup", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "text", "ids"]
    got = bpe.decode(encoded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["ids"]) == reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    digest = {r["doc_id"]: r for r in tokenised(docs, PATH).where("doc_id = 2").collect()}[2]
    ids = reference.encode(TEXTS[2], add_special_tokens=False).ids
    assert digest["n_tokens"] == len(ids)
    assert digest["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0
