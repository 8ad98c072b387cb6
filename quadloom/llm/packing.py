"""Packing documents into sequences of at most WINDOW tokens.

Bounded-space online packing: each partition keeps OPEN open windows. A piece goes
where it fits best; when it fits nowhere, the fullest window is emitted, topped up
with the head of the piece where that is worth a cut. When a partition ends, the
emptiest open windows fill the others up, until one is left over. Leftovers of FAN
partitions merge in the same way, level by level, until one task holds the last
window, which is cut at powers of two: sequences of such lengths need no padding.

Null and empty texts are a document of one id, the end. Rows are packed one by one,
so repeated rows and null ids are packed as often as they come. An empty table
gives no piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import tokens
from quadloom.llm._arrow import SLICE, slices, texts_of
from quadloom.llm._shared import cut

WINDOW = 1024
#: Open windows of a partition.
OPEN = 64
#: Least head or tail of a piece that a cut may leave; smaller gaps are padded.
LEAST = 16
#: Leftovers that merge in one task.
FAN = 64


class Piece(NamedTuple):
    """ids of the document doc_id from its start-th on; the document has total ids."""

    doc_id: int | None
    start: int
    total: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:at]), self._replace(start=self.start + at, ids=self.ids[at:])


class Packer:
    """Open windows in order of fill, each a list of pieces. Its methods yield windows that are done."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, least: int = LEAST):
        self.window, self.most, self.least = window, most, least
        self.fills: list[tuple[int, int]] = []  # (fill, number of the window), ascending
        self.content: dict[int, list[Piece]] = {}
        self.number = 0

    def _pop(self, at: int) -> list[Piece]:
        return self.content.pop(self.fills.pop(at)[1])

    def _put(self, piece: Piece, at: int | None) -> Iterator[list[Piece]]:
        if at is None:
            fill, number = 0, self.number
            self.number += 1
            self.content[number] = []
        else:
            fill, number = self.fills.pop(at)
        self.content[number].append(piece)
        bisect.insort(self.fills, (fill + len(piece.ids), number))
        if self.fills[-1][0] == self.window:
            yield self._pop(-1)

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.window:
            head, piece = piece.cut(self.window)
            yield [head]
        while len(piece.ids):
            # the fullest window that has room
            at = bisect.bisect_right(self.fills, (self.window - len(piece.ids), self.number)) - 1
            if at >= 0 or len(self.fills) < self.most:
                yield from self._put(piece, at if at >= 0 else None)
                return
            room = self.window - self.fills[-1][0]
            if room >= self.least and len(piece.ids) - room >= self.least:
                head, piece = piece.cut(room)
                yield from self._put(head, -1)
            else:
                yield self._pop(-1)

    def settle(self) -> Iterator[list[Piece]]:
        """Fills windows up from the emptiest ones until one at most stays open."""
        while len(self.fills) > 1:
            donor = self._pop(0)
            self.most = len(self.fills)
            for piece in donor:
                yield from self.place(piece)
                self.most = max(1, min(self.most, len(self.fills)))


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset"]
#: Only leftovers (window < 0) carry their ids on, at most one window of each partition.
SCHEMA = T.StructType([*(T.StructField(f, T.LongType()) for f in FIELDS), T.StructField("ids", T.BinaryType())])


def _rows(part: int, windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
    rows = []
    for number, content in windows:
        offset = 0
        for p in content:
            raw = p.ids.tobytes()
            rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.total, part, number, offset, raw if number < 0 else None))
            offset += len(p.ids)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(FIELDS) + 1)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], [*FIELDS, "ids"])


def _first_level(path: str, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, emitted = Packer(window, most), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1, SLICE):
            got = tokens.with_end(tokens.encode(texts_of(batch.column(1)), path))
            stream, bounds, out = got.ids.astype("<u4"), got.bounds.tolist(), []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                out += packer.place(Piece(doc_id, 0, b - a, stream[a:b]))
            yield _rows(part, list(enumerate(out, emitted)))
            emitted += len(out)
            for fill in packer.content.values():  # else open pieces would hold the whole slice
                fill[:] = [p._replace(ids=p.ids.copy()) for p in fill]
        out = list(packer.settle())
        yield _rows(part, [*enumerate(out, emitted), *((-1, c) for c in packer.content.values())])

    return run


def _merge(window: int, most: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select([*FIELDS, "ids"]).sort_by([("part", "ascending"), ("offset", "ascending")]).to_pylist()
        packer, out = Packer(window, most), []
        for r in rows:
            out += packer.place(Piece(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")))
        out += packer.settle()
        rest = list(packer.content.values())
        if last:
            out += [c for left in rest for c in _powers(left)]
            rest = []
        return pa.Table.from_batches([_rows(key[0].as_py(), [*enumerate(out), *((-1, c) for c in rest)])])

    return run


def _powers(content: list[Piece]) -> Iterator[list[Piece]]:
    """The window's ids in runs whose lengths are its powers of two, largest first."""
    left = list(content)
    total = sum(len(p.ids) for p in left)
    for k in reversed(range(total.bit_length())):
        room, out = total & 1 << k, []
        while room:
            piece = left.pop(0)
            if len(piece.ids) > room:
                piece, tail = piece.cut(room)
                left.insert(0, tail)
            room -= len(piece.ids)
            out.append(piece)
        if out:
            yield out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path is the vocabulary file. Only pieces' places and checksums leave a task, and
    one window of ids at most of each partition passes a shuffle. A sequence's id
    holds the level, partition (22 bits) and number (24 bits) that made it, and so
    stays exact as a double.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    level, depth, done = cut(cols.mapInArrow(_first_level(path, window, most), SCHEMA)), 0, []
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        done.append(level.where("window >= 0").select(*FIELDS[:5], (F.lit(depth << 46) + F.col("part") * F.lit(1 << 24) + F.col("window")).alias("sequence_id"), "offset"))
        if depth and parts == 1:
            break
        parts = -(-parts // FAN)
        left = level.where("window < 0").withColumn("group", F.floor(F.col("part") / FAN).cast("long"))
        level = cut(left.groupBy("group").applyInArrow(_merge(window, most, parts == 1), SCHEMA))
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
