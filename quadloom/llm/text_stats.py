"""Statistics of whole texts, one pass of Arrow kernels over each batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from quadloom.llm._arrow import bytes_of, lines, offsets_of, per_text, words

#: Symbols that the base rule counts.
SYMBOLS = b"#*$%&|<>"
#: Words in a window of the repetition count.
WINDOW = 8

NAMES = ["n_bytes", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_top", "n_stutter", "n_upper", "n_lower", "n_digits", "n_stops", "n_shouts", "n_bare"]
KIND = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


TABLES = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(bytes(range(65, 91))),
    "n_lower": _table(bytes(range(97, 123))),
    "n_digits": _table(b"0123456789"),
    "n_stops": _table(b".?"),
    "n_shouts": _table(b"!"),
}
WORDY = _table(bytes(b for b in range(256) if b > 127 or chr(b).isalnum()))


def repeated(codes: np.ndarray, text_of: np.ndarray, counts: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of size words found twice or more in it."""
    n = len(codes)
    covered = np.zeros(n + 1, np.int64)
    if n >= size:
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n - size + 1, np.uint64)
        for k in range(size):  # a polynomial over 64 bits
            key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - size + 1 + k]
        start = np.flatnonzero(text_of[: n - size + 1] == text_of[size - 1 :])
        key = key[start] ^ ((text_of[start].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = start[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + size, -1)
    return per_text((np.cumsum(covered[:-1]) > 0).astype(np.int64), bounds)


def stats(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """Counts of NAMES for each text; an empty text has zeros and one empty line."""
    w, at, data = words(texts), offsets_of(texts), bytes_of(texts)
    at = at - at[0]
    out = {"n_bytes": np.diff(at), "n_words": w.counts}
    out |= {k: per_text(t[data], at) for k, t in TABLES.items()}
    out["word_chars"] = per_text(pc.utf8_length(w.flat).to_numpy(zero_copy_only=False), w.bounds)
    text_of = w.text_of
    out["n_repeat_words"] = repeated(w.codes, text_of, w.counts, w.bounds)
    again = np.zeros(len(w.codes), np.int64)
    again[1:] = (w.codes[1:] == w.codes[:-1]) & (text_of[1:] == text_of[:-1])
    out["n_stutter"] = per_text(again, w.bounds)
    wordy = per_text(WORDY[bytes_of(w.vocab)], offsets_of(w.vocab)) == 0 if len(w.vocab) else np.zeros(0, bool)
    out["n_bare"] = per_text(wordy[w.codes].astype(np.int64), w.bounds)
    pairs, times = np.unique(text_of * np.int64(len(w.vocab) + 1) + w.codes, return_counts=True)
    owner = pairs // (len(w.vocab) + 1)
    kinds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out["n_distinct"] = np.diff(kinds)
    out["n_top"] = per_text(times, kinds, np.maximum)
    bounds, flat = lines(texts)
    line_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    full = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy(zero_copy_only=False) > 0
    coded = flat.dictionary_encode()
    key = line_of[full] * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy()[full]
    first = np.bincount(np.unique(key) // (len(coded.dictionary) + 1), minlength=len(texts))
    out["n_dup_lines"] = np.bincount(line_of[full], minlength=len(texts)) - first
    out["n_lines"] = np.diff(bounds)
    return out
