"""Byte-level BPE ids of whole texts, each distinct piece of a batch encoded once.

The published splitting pattern cuts a text into pieces that cover it, and ids
depend on the piece alone. Numpy finds the cuts of a whole batch at once from
character classes, Arrow's dictionary finds the distinct pieces, the tokenizers
library's own model encodes those, and a gather lays the ids out per text.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quadloom.llm._arrow import bytes_of, offsets_of, strings

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pieces in one call of the library.
TOGETHER = 64


class Ids(NamedTuple):
    """Ids of a batch: text i has ids[bounds[i]:bounds[i+1]]."""

    bounds: np.ndarray
    ids: np.ndarray


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the regex library."""
    out, step = np.full(0x110000, OTHER, np.uint8), 0x1000  # a list of all characters would take some 80 MB
    for at in range(0, len(out), step):
        some = np.arange(at, at + step, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, some):
                out[at + m.start() : at + m.end()] = kind
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each UTF-8 byte belongs to."""
    table = classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 1 + (data[lead] >= 0xC0) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0xFF >> (size + 1))
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
        kind = table[point]
        out[lead] = kind
        for k in range(1, 4):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets where pieces start, for texts that start at at[:-1]; at[-1] is last.

    Runs of one class are pieces. A space before a run joins it; of longer white
    space the last character is cut off first; an apostrophe that no other mark
    precedes takes the contraction after it.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    kind = _byte_classes(data)
    head = np.zeros(n + 1, bool)
    head[at[at < n]] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= head
    # white space followed by something in the same text
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~head[1:n]) + 1
    last = after - 1
    for _ in range(3):  # to the head of a multi-byte space
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after] = data[after - 1] != 32
    quote = np.flatnonzero(data[: n - 1] == 39)
    quote = quote[(kind[quote + 1] == LETTER) & ~head[quote + 1]]
    free = head[quote] | (kind[quote - 1] == LETTER) | (kind[quote - 1] == NUMBER) | ((kind[quote - 1] == SPACE) & (data[quote - 1] != 32))
    quote = quote[free]
    if len(quote):
        ends = at[np.searchsorted(at, quote, side="right")]
        first = data[quote + 1]
        second = np.where(quote + 2 < ends, data[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(first, list(b"stmd"))
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        for mask, size in ((one, 2), (two, 3)):
            start[quote[mask] + 1] = False
            start[quote[mask] + size] = True
    return np.flatnonzero(start)


class Pieces(NamedTuple):
    """Pieces of a batch: text i has codes[bounds[i]:bounds[i+1]] into vocab."""

    bounds: np.ndarray
    codes: np.ndarray
    vocab: pa.Array


def pieces(texts: pa.StringArray) -> Pieces:
    at = offsets_of(texts)
    data, at = bytes_of(texts), at - at[0]
    found = cuts(data, at)
    coded = strings(data, found).cast(pa.binary()).dictionary_encode() if len(data) else pa.array([], pa.binary()).dictionary_encode()
    return Pieces(np.searchsorted(found, at), coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def lay_out(found: Pieces, sizes: np.ndarray, flat: np.ndarray) -> Ids:
    """Ids of each text, when piece kind k has sizes[k] ids in flat, kind after kind."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    length = sizes[found.codes]
    ends = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(ends[-1]) + np.repeat(starts[found.codes] - ends[:-1], length)
    return Ids(ends[found.bounds], flat[place])


@functools.cache
def byte_letters() -> np.ndarray:
    """Code point that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    out = np.arange(256, dtype=np.uint32)
    out[rest] = 256 + np.arange(len(rest))
    return out


@functools.cache
def _model(path: str):
    """The file's BPE model alone, over pieces that a zero byte parts; the same object as in _whole."""
    whole, _ = _whole(path)
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(whole.model)
    out.pre_tokenizer = pre_tokenizers.Split(chr(byte_letters()[0]), "isolated")
    return out, whole.token_to_id(chr(byte_letters()[0]))


def encode_kinds(vocab: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of distinct pieces, by the tokenizers library and the vocabulary file at path."""
    model, mark = _model(path)
    n = len(vocab)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = offsets_of(vocab)
    data = bytes_of(vocab)
    # a zero byte ends each piece; pieces with zero bytes of their own are encoded alone below
    spaced = np.zeros(len(data) + n, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    letters = byte_letters()[spaced].astype("<u4").tobytes().decode("utf-32-le")
    ends = (at[1:] - at[0]) + np.arange(1, n + 1)
    cut = np.concatenate([[0], ends[TOGETHER - 1 :: TOGETHER], ends[-1:]])
    cut = np.unique(cut)
    got = model.encode_batch_fast([letters[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, np.int64) for e in got])
    if (data == 0).any():
        zero = np.add.reduceat((data == 0).astype(np.int64), at[:-1] - at[0]) > 0
        return _encode_apart(vocab, zero, path)
    marks = np.flatnonzero(ids == mark)
    sizes = np.diff(np.concatenate([[-1], marks])) - 1
    return sizes, ids[ids != mark]


def _encode_apart(vocab: pa.Array, zero: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As encode_kinds, for vocabularies of which some pieces hold zero bytes."""
    model, _ = _model(path)
    plain_sizes, plain = encode_kinds(vocab.filter(pa.array(~zero)), path)
    plain_ends = np.concatenate([[0], np.cumsum(plain_sizes)])
    lists, k = [], 0
    table = byte_letters().astype("<u4")
    for piece, apart in zip(vocab.to_pylist(), zero.tolist(), strict=True):
        if apart:
            lists.append(np.array([t.id for t in model.model.tokenize(table[np.frombuffer(piece, np.uint8)].tobytes().decode("utf-32-le"))], np.int64))
        else:
            lists.append(plain[plain_ends[k] : plain_ends[k + 1]])
            k += 1
    return np.array([len(x) for x in lists], np.int64), np.concatenate(lists)


@functools.cache
def _whole(path: str):
    """The file's tokenizer, and the texts that it looks for before it splits anything."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    return out, [t.content for t in out.get_added_tokens_decoder().values()]


def encode(texts: pa.StringArray, path: str, special: bool = True) -> Ids:
    """Ids of each text, as the tokenizers library gives for whole texts without adding tokens.

    A text that spells a special token out gets that token's id there, as by the
    library's own setting; such texts go to the library whole. With special false
    (the library's encode_special_tokens) the letters are ordinary text.
    """
    found = pieces(texts)
    got = lay_out(found, *encode_kinds(found.vocab, path))
    library, named = _whole(path)
    spelt = np.zeros(len(texts), bool)
    for content in named if special else ():
        spelt |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
    if not spelt.any():
        return got
    lists = np.split(got.ids, got.bounds[1:-1])
    for k in np.flatnonzero(spelt).tolist():
        lists[k] = np.array(library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int64)
    return Ids(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists))


def with_end(got: Ids, end: int = 0) -> Ids:
    """got with one more id after each text."""
    n = len(got.bounds) - 1
    bounds = got.bounds + np.arange(n + 1)
    ids = np.full(bounds[-1], end, np.int64)
    ids[np.arange(len(got.ids)) + np.repeat(np.arange(n), np.diff(got.bounds))] = got.ids
    return Ids(bounds, ids)
