"""Exact byte-level BPE by backtracking over longest token matches.

A sequence of tokens is the BPE encoding of its bytes exactly when every two
neighbours are compatible: no merge across their seam comes before the merges
that formed them. An Aho-Corasick automaton gives the longest token at a place;
a token that isn't compatible with the one before gives way to its longest
proper prefix that is a token, and a dead end takes the token before back.
Places that failed are marked, so each is tried once and the time is linear.

Decoding copies byte ranges of one buffer by an offset table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import textkit as tk

#: The split of text before the merges of a byte-level file (fixed values of the format).
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pieces of text whose encoding a worker remembers: the older half goes when the newer is full. Remembered seams, which go at once.
REMEMBERED = 200_000
SEAMS = 200_000
#: Longer pieces aren't remembered.
LONGEST_REMEMBERED = 64


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(dict):
    """Encodes and decodes with one tokenizer file. As a dict: piece of text -> its ids as little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        letters = _byte_letters()
        self.vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"unused option of the added token {t['content']!r}")
            self.special[t["content"]] = t["id"]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spelling = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merges: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            x, y, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault(x << 32 | y, whole)
            if whole not in self.rank:
                self.rank[whole], parts[whole] = rank, (x, y)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.seams: dict[int, bool] = {}
        size = max(spelling) + 1
        # By token: the rank of the merge that makes it (-1: none does) and the two it is made of. By pair: the rank of its merge.
        self.born = [self.rank.get(i, -1) for i in range(size)]
        self.first, self.last = ([parts.get(i, (i, i))[side] for i in range(size)] for side in (0, 1))
        self.ranks = {pair: self.rank[whole] for pair, whole in self.merges.items()}
        # By token: its bytes, and the longest token that is a proper prefix of it (-1: none is).
        self.length = [len(spelling.get(i, b"")) for i in range(size)]
        self.shorter = [-1] * size
        for token, i in self.vocab.items():
            self.shorter[i] = next((self.vocab[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.vocab), -1)
        pieces = [spelling.get(i, b"") for i in range(size)]
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def _stays(self, left: int, right: int) -> bool:
        """Undoes the merges at a seam, the latest first, and looks for one across it that would have come before those undone."""
        born, ranks, limit = self.born, self.ranks, len(self.ranks)
        while ranks.get(left << 32 | right, limit) >= limit:
            if born[left] > born[right]:
                limit, left = born[left], self.last[left]
            elif born[right] >= 0:
                # Of equal merges the leftmost comes first.
                limit, right = born[right] + 1, self.first[right]
            else:
                return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are when their bytes are encoded together."""
        key = left << 32 | right
        known = self.seams.get(key)
        if known is None:
            known = self._stays(left, right)
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            self.seams[key] = known
        return known

    def _encoded(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        longest, compatible, seam = self.automaton.iter_long, self.compatible, self.seams.get
        out: list[int] = []
        ends: list[int] = [0]
        before = -1
        for end, token in longest(text):
            if before >= 0 and not seam(before << 32 | token) and not compatible(before, token):
                break
            out.append(token)
            ends.append(end + 1)
            before = token
        else:
            return out
        length, shorter = self.length, self.shorter
        dead = bytearray(len(piece) + 1)
        while True:
            at = ends[-1]
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (before < 0 or seam(before << 32 | token) or compatible(before, token)):
                    break
                token = shorter[token]
            if token < 0:  # nothing fits here after the token before
                dead[at] = 1
                ends.pop()
                token = shorter[out.pop()]
                before = out[-1] if out else -1
                continue
            out.append(token)
            ends.append(end)
            if end == len(piece):
                return out
            before = token
            token = next(longest(text, end))[1]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            token = self.vocab.get(raw)
            ids = token.to_bytes(4, "little") if token is not None else pack(f"<{len(found := self._encoded(raw))}I", *found)
            if len(raw) > LONGEST_REMEMBERED:
                return ids
        if len(self) >= REMEMBERED // 2:
            self.older = self.copy()
            super().clear()
        self[piece] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.older = {}

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; the strings of special tokens become their ids."""
        find = self.__getitem__
        if self.split_special is None or not self.split_special.search(text):
            return b"".join(map(find, SPLIT.findall(text)))
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            out.append(self.special[part].to_bytes(4, "little") if i % 2 else b"".join(map(find, SPLIT.findall(part))))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; an id that the file lacks raises IndexError."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.offsets) - 1:
            raise IndexError("id outside of the vocabulary")
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        end = np.cumsum(size)
        return self.buffer[np.repeat(start - end + size, size) + np.arange(end[-1])].tobytes()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded_batches(path: str, place: int, ids_col: str = "ids"):
    """A function of Arrow batches that adds the ids of the texts in column number `place`; it can be chained with others in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column(place)):
                raw = data.tobytes()
                found = [own.encode(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])
        own.clear()

    return run


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>) of each whole text, as the file at `path` on every machine gives them.

    Null and empty texts have no ids. Special tokens' strings are taken for the
    tokens. All other columns stay, whatever their names; a column named as
    ids_col is replaced. Memory follows a batch's ids and the longest text.
    """
    rest = [c for c in docs.columns if c != ids_col]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = frame.withColumn(ids_col, F.array().cast("array<int>")).schema
    return tk.mapped(frame, encoded_batches(path, rest.index(text_col), ids_col), schema)


def id_rows(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The ids of each row of a column of ids."""
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b, there in zip(bounds[:-1], bounds[1:], column.is_valid().to_pylist(), strict=True):
        yield values[a:b] if there else None


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of each row's ids; special tokens give their strings, invalid UTF-8 gives U+FFFD.

    Null ids give null. A column named as text_col is replaced.
    """
    rest = [c for c in encoded.columns if c != text_col]
    place = rest.index(ids_col)
    frame = encoded.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            text = [None if x is None else own.decode(x).decode(errors="replace") for x in id_rows(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, text_col])

    schema = frame.withColumn(text_col, F.lit("")).schema
    return tk.mapped(frame, run, schema)
