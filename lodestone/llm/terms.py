"""Terms of texts as Arrow dictionaries: runs of bytes of an alphabet, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestone.llm import textkit as tk


def alphabet(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of bytes: those in none of the ranges (first and last byte) belong to terms."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


def coded_terms(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each term of some texts, in order: the text's number and the term's number in the dictionary, which is the third value."""
    inside = letters[data]
    start, end = tk.runs_of(inside, offsets)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(tk.lowered(data)[inside]))
    coded = column.dictionary_encode()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return text, coded.indices.to_numpy(), coded.dictionary


def counted(text: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) in order, and how often each occurs."""
    key, n = np.unique(text * max(n_codes, 1) + code, return_counts=True)
    return *np.divmod(key, max(n_codes, 1)), n
