"""Arrow and numpy kernels over batches of whole texts, shared by the operators.

A kernel sees one Arrow batch at a time, so its memory follows the batch and not
the table. Null texts count as empty ones here; operators that tell them apart
do so before calling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a slice where a kernel takes many times its slice; workers live on and keep most of what they once took.
SLICE = 1 << 19
#: ASCII upper case to lower case; every other byte stays.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Lower case, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = np.array([LOWER[b] if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


class Words(NamedTuple):
    """Words of a batch: text i has flat[bounds[i]:bounds[i+1]]; codes point into vocab."""

    bounds: np.ndarray
    flat: pa.StringArray
    codes: np.ndarray
    vocab: pa.StringArray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def texts_of(column: pa.Array) -> pa.StringArray:
    """The column as strings without nulls, starting at the head of its own buffers."""
    out = pc.fill_null(column.cast(pa.string()), "")
    return pa.concat_arrays([out, pa.array([], pa.string())]) if out.offset else out


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has most bytes of the text column at, or one row. What Arrow no longer uses goes back after each batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(size) // most if len(size) else size
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(size)] if len(size) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def offsets_of(array: pa.StringArray) -> np.ndarray:
    if not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.StringArray) -> np.ndarray:
    """Every byte of the array's values, text after text."""
    at = offsets_of(array)
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data))


def translated(texts: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    """Each byte through a table that keeps the bytes of multi-byte characters."""
    at = offsets_of(texts)
    return strings(table[bytes_of(texts)], at - at[0])


def words(texts: pa.StringArray, table: np.ndarray | None = None) -> Words:
    """Words between ASCII white space (space, TAB to CR), after translation by table."""
    if table is not None:
        texts = translated(texts, table)
    parts = pc.ascii_split_whitespace(texts)
    bounds = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64) if len(parts) else np.zeros(1, np.int64)
    flat = parts.flatten()
    full = np.diff(offsets_of(flat)) > 0
    if not full.all():  # white space at the ends of a text leaves empty pieces
        kept = np.concatenate([[0], np.cumsum(full)])
        bounds, flat = kept[bounds - bounds[0]], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Words(bounds - bounds[0], flat, coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same in every task."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab.to_pylist()), np.uint64, len(vocab))


def per_text(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc = np.add, dtype=np.int64) -> np.ndarray:
    """ufunc over each text's values; 0 for a text without any."""
    out, full = np.zeros(len(bounds) - 1, dtype), np.diff(bounds) > 0
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full], dtype=dtype)
    return out


def lines(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Bounds and the \\n-split lines of each text."""
    parts = pc.split_pattern(texts, "\n")
    bounds = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64) if len(parts) else np.zeros(1, np.int64)
    return bounds - bounds[0], parts.flatten()


def with_struct(df: DataFrame, name: str, kind: T.StructType, kernel: Callable[[pa.StringArray], dict], text: str = "text", only: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """df and a struct column of what kernel makes of each text; rows and order stay.

    only: a column of longs without nulls, and which of them to go on with. A filter by a
    Python function before this would take a second Python worker for each task.
    """
    at, by = df.columns.index(text), None if only is None else df.columns.index(only[0])
    fields = kind.fieldNames()
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if only is not None:
            batches = (b.filter(pa.array(only[1](b.column(by).to_numpy()))) for b in batches)
        for batch in slices(batches, at, SLICE):
            got = kernel(texts_of(batch.column(at)))
            struct = pa.StructArray.from_arrays([pa.array(got[f], t) for f, t in zip(fields, types, strict=True)], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def bucket_crc(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; ids that are null fall in no bucket (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))
