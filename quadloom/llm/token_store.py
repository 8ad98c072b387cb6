"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so that equal
passages give equal chunks wherever they stand. A task writes the chunks of its
documents, each distinct one once, to a draft pack. A digest's owner is the pack
with the least number that has it; every pack is then rewritten without the chunks
that it does not own, so that each distinct chunk is stored once over all packs.
Packs keep their documents' order, and reading a document back is mostly one read.

Recipes list the chunks of each document, in files in ascending order of ids. The
leaves of a file's Merkle tree are its documents; the manifest has the root of each
file and of all of them. Reading back checks every chunk against its digest and
every file against its root.

Texts and ids never pass a shuffle: only digests and recipes do, some 30 bytes for a
chunk. Null texts are empty: a document of the end id. Repeated ids keep their rows,
in the order of the input; null ids come first. An empty table gives an empty store.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import tokens
from quadloom.llm._arrow import slices, texts_of
from quadloom.llm._shared import cut, open_fs, put, work_dir, write_file

#: Ids in a chunk: least, most, and on average between cuts as a power of two.
LEAST, MOST, BITS = 128, 4096, 9
#: Ids that the rolling hash sees; fewer than LEAST, so that it never looks over a document's start.
SEEN = 16
DIGEST = 16
#: Ids at which a task starts its next pack, between documents.
PACK = 16_000_000
#: Documents for which there is a recipe file.
RECIPES = 1_000_000
FACTOR = 0x9E3779B97F4A7C15


class Pack(NamedTuple):
    """What a draft pack holds, as bytes of arrays: chunk sizes and digests; documents' ids, lengths and chunk counts; chunk numbers."""

    pack: int
    sizes: bytes
    digests: bytes
    doc_ids: bytes
    lengths: bytes
    counts: bytes
    numbers: bytes


PACK_SCHEMA = "pack long, sizes binary, digests binary, doc_ids binary, lengths binary, counts binary, numbers binary"
#: Stands for a null id in the arrays.
NULL = -(1 << 63)


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\x01" + leaves[k] + leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def leaf(doc_id: int | None, length: int, digests: bytes) -> bytes:
    return digest(b"\x00" + repr((doc_id, length)).encode() + digests)


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Where chunks end; every document's end is one."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    h ^= h >> np.uint64(31)
    step = 1
    while step < SEEN:  # a sum over twice as many ids each time
        more = h.copy()
        more[step:] += h[:-step] * np.uint64(pow(FACTOR, step, 1 << 64))
        h, step = more, step * 2
    wanted = (np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + 1).tolist()
    ends, k = [], 0
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        last = begin
        while k < len(wanted) and wanted[k] < end:
            at, k = wanted[k], k + 1
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST:
                ends.append(at)
                last = at
        while end - last > MOST:
            last += MOST
            ends.append(last)
        ends.append(end)
    return ends


class _Draft:
    """A draft pack being filled by a task."""

    def __init__(self, number: int):
        self.number, self.known, self.parts = number, {}, []
        self.sizes, self.doc_ids, self.lengths, self.counts, self.numbers, self.ids = [], [], [], [], [], 0

    def add(self, doc_ids: list, got: tokens.Ids, dtype: type) -> None:
        ends = chunk_ends(got.ids, got.bounds)
        stream = got.ids.astype(dtype)
        begin, numbers, new = 0, [], []
        for end in ends:
            raw = stream[begin:end].tobytes()
            key = digest(raw)
            number = self.known.get(key)
            if number is None:
                number = self.known[key] = len(self.known)
                new.append(raw)
                self.sizes.append(end - begin)
            numbers.append(number)
            begin = end
        self.numbers += numbers
        self.counts += np.diff(np.searchsorted(ends, got.bounds, side="right")).tolist()
        self.lengths += np.diff(got.bounds).tolist()
        self.doc_ids += [NULL if d is None else d for d in doc_ids]
        self.ids += len(stream)
        self.parts.append(b"".join(new))

    def write(self, uri: str) -> pa.RecordBatch:
        write_file(f"{uri}/draft-{self.number}", self.parts)
        pack = Pack(self.number, np.array(self.sizes, np.uint32).tobytes(), b"".join(self.known), *(np.array(x, np.int64).tobytes() for x in (self.doc_ids, self.lengths)), *(np.array(x, np.uint32).tobytes() for x in (self.counts, self.numbers)))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(pack, [pa.int64(), *[pa.binary()] * 6], strict=True)], list(Pack._fields))


def write_drafts(docs: DataFrame, uri: str, path: str, dtype: type) -> DataFrame:
    """docs: id, text. A Pack for each draft pack that a task writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        draft = _Draft(part << 12)
        for batch in slices(batches, 1):
            draft.add(batch.column(0).to_pylist(), tokens.with_end(tokens.encode(texts_of(batch.column(1)), path)), dtype)
            if draft.ids >= PACK:
                yield draft.write(uri)
                k += 1
                draft = _Draft(part << 12 | k)
        if draft.ids:
            yield draft.write(uri)

    return docs.mapInArrow(run, PACK_SCHEMA)


def _chunks(packs: DataFrame) -> DataFrame:
    """(digest, pack, number) of every chunk of every draft pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, digests in zip(batch.column("pack").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                n = len(digests) // DIGEST
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), n, [None, pa.py_buffer(digests)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, pack), pa.int64()), pa.array(np.arange(n), pa.int32())], ["digest", "pack", "number"])

    return packs.select("pack", "digests").mapInArrow(run, "digest binary, pack long, number int")


RECIPE_SCHEMA = "doc_id long, pack long, row int, length long, places binary, digests binary"


def _compact(uri: str, dtype: type):
    """Writes a pack with its own chunks only, and gives its documents' recipes."""
    width = np.dtype(dtype).itemsize

    def run(key: tuple, chunks: pa.Table, packs: pa.Table) -> pa.Table:
        number = key[0].as_py()
        p = Pack(**packs.to_pylist()[0])
        chunks = chunks.sort_by("number")
        owner, place = chunks["owner"].to_numpy(), chunks["place"].to_numpy().astype(np.int64)
        sizes = np.frombuffer(p.sizes, np.uint32).astype(np.int64)
        own = np.flatnonzero(owner == number)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        store, folder = open_fs(uri)
        draft = f"{folder}/draft-{number}"
        if store.get_file_info(draft).is_file:  # else an earlier attempt has finished this pack
            with store.open_input_stream(draft) as file:
                raw = memoryview(file.read())
            runs = np.split(own, np.flatnonzero(np.diff(own) != 1) + 1)
            parts = [raw[starts[r[0]] * width : starts[r[-1] + 1] * width] for r in runs if len(r)]
            ends = np.cumsum(sizes[own]).astype(np.int64)
            write_file(f"{uri}/pack-{number}", [*parts, own.astype(np.int64), ends, np.array([len(own)], np.int64)])
            store.delete_file(draft)
        doc_ids, lengths = np.frombuffer(p.doc_ids, np.int64), np.frombuffer(p.lengths, np.int64)
        numbers = np.frombuffer(p.numbers, np.uint32).astype(np.int64)
        ends = np.cumsum(np.frombuffer(p.counts, np.uint32).astype(np.int64)).tolist()
        places = np.stack([owner[numbers], place[numbers]], axis=1)
        digests = np.frombuffer(p.digests, f"V{DIGEST}")[numbers]
        cuts = list(zip([0, *ends[:-1]], ends, strict=True))
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL), "pack": pa.array(np.full(len(cuts), number), pa.int64()), "row": pa.array(np.arange(len(cuts)), pa.int32()),
            "length": pa.array(lengths), "places": pa.array([places[a:b].tobytes() for a, b in cuts], pa.binary()), "digests": pa.array([digests[a:b].tobytes() for a, b in cuts], pa.binary()),
        })

    return run


def write_recipes(recipes: DataFrame, uri: str, parts: int) -> list[tuple[int, int, int, str]]:
    """Recipe files in ascending order of ids. (file, documents, ids, Merkle root) of each; a task holds its documents' leaves, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, ids, out = TaskContext.get().partitionId(), [], 0, None
        store, folder = open_fs(uri)
        draft = f"{folder}/recipe-{part}.{uuid.uuid4().hex}.tmp"
        with contextlib.ExitStack() as held:
            for batch in batches:
                if not batch.num_rows:
                    continue
                batch = batch.select(["doc_id", "length", "places", "digests"])
                out = out or held.enter_context(pa.ipc.new_file(held.enter_context(store.open_output_stream(draft)), batch.schema))
                for at in range(0, batch.num_rows, 4096):
                    out.write_batch(batch.slice(at, 4096))
                leaves += [leaf(d, n, k) for d, n, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "length", "digests")), strict=True)]
                ids += pa.compute.sum(batch.column("length")).as_py()
        if leaves:
            put(store, draft, f"{folder}/recipe-{part}")
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(leaves)], "ids": [ids], "root": [merkle(leaves).hex()]})

    rows = recipes.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "pack", "row").mapInArrow(run, "part long, docs long, ids long, root string").collect()
    return sorted((r["part"], r["docs"], r["ids"], r["root"]) for r in rows)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> str:
    """Writes docs' ids to a store in a new shared folder, and gives its URI."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    uri = work_dir(spark, "tokens")
    dtype = np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32
    packs = cut(write_drafts(docs.select(F.col(id_col).cast("long"), F.col(text)), uri, path, dtype))
    chunks = _chunks(packs)
    owners = chunks.groupBy("digest").agg(F.min(F.struct("pack", "number")).alias("first"))
    owned = chunks.join(owners, "digest").select("pack", "number", F.col("first.pack").alias("owner"), F.col("first.number").alias("place"))
    recipes = cut(owned.groupBy("pack").cogroup(packs.groupBy("pack")).applyInArrow(_compact(uri, dtype), RECIPE_SCHEMA))
    docs_in_all = (packs.agg(F.sum(F.octet_length("doc_ids"))).first()[0] or 0) // 8
    files = write_recipes(recipes, uri, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs_in_all // RECIPES))
    manifest = {"dtype": np.dtype(dtype).name, "files": files, "root": merkle([bytes.fromhex(f[3]) for f in files]).hex()}
    write_file(f"{uri}/manifest.json", [json.dumps(manifest).encode()])
    return uri


class _Packs:
    """Reads chunks of packs; a pack's table of chunks is read once."""

    def __init__(self, uri: str, dtype: np.dtype):
        self.store, self.folder = open_fs(uri)
        self.width = dtype.itemsize
        self.table = functools.lru_cache(64)(self._table)

    def _table(self, pack: int) -> tuple:
        file = self.store.open_input_file(f"{self.folder}/pack-{pack}")
        size = file.size()
        n = int(np.frombuffer(file.read_at(8, size - 8), np.int64)[0])
        tail = np.frombuffer(file.read_at(16 * n, size - 8 - 16 * n), np.int64)
        return file, tail[:n], np.concatenate([[0], tail[n:]])

    def read(self, places: np.ndarray) -> Iterator[bytes]:
        """The chunks at places (pack, number), those that lie together in one read."""
        at = 0
        while at < len(places):
            pack = int(places[at, 0])
            file, numbers, ends = self.table(pack)
            rows = np.searchsorted(numbers, places[at:, 1])
            stop = at + 1
            while stop < len(places) and places[stop, 0] == pack and rows[stop - at] == rows[stop - at - 1] + 1:
                stop += 1
            first, last = int(rows[0]), int(rows[stop - at - 1])
            raw = file.read_at((int(ends[last + 1]) - int(ends[first])) * self.width, int(ends[first]) * self.width)
            for k in range(first, last + 1):
                yield raw[(int(ends[k]) - int(ends[first])) * self.width : (int(ends[k + 1]) - int(ends[first])) * self.width]
            at = stop


def read(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in ascending order of ids within and over partitions.

    ids holds little-endian 32-bit integers, or null where only the checks are wanted.

    Raises ValueError in the task that meets a chunk or file that differs from the manifest.
    """
    store, folder = open_fs(f"{uri}/manifest.json")
    with store.open_input_stream(folder) as file:
        manifest = json.loads(file.read())
    files, dtype = manifest["files"], np.dtype(manifest["dtype"])
    if merkle([bytes.fromhex(f[3]) for f in files]).hex() != manifest["root"]:
        raise ValueError("the manifest differs from its root")
    starts = np.concatenate([[0], np.cumsum([f[2] for f in files])]).astype(int).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(uri, dtype)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, _, _, root = files[k]
                leaves, start = [], starts[k]
                with packs.store.open_input_file(f"{packs.folder}/recipe-{part}") as source, pa.ipc.open_file(source) as recipes:
                    for number in range(recipes.num_record_batches):
                        out = []
                        for doc_id, length, places, digests in zip(*(c.to_pylist() for c in recipes.get_batch(number).columns), strict=True):
                            chunks = list(packs.read(np.frombuffer(places, np.int64).reshape(-1, 2)))
                            if b"".join(map(digest, chunks)) != digests:
                                raise ValueError(f"a chunk of document {doc_id} differs from its digest")
                            leaves.append(leaf(doc_id, length, digests))
                            ids = np.frombuffer(b"".join(chunks), dtype).astype("<u4").tobytes()
                            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                            start += length
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema.names)
                if merkle(leaves).hex() != root:
                    raise ValueError(f"recipe file {part} differs from its root")

    n = len(files)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
