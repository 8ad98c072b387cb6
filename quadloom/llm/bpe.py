"""Byte-level BPE by corpus-level merge replay.

Tasks find the distinct pieces of their texts and pass them to shards by hash; a shard
has each piece of the corpus once. There the pieces lie end to end in one array of
symbols. An inverted index from token pair to the positions where it stands drives the
replay: the pair of least rank is merged at all its positions, in every piece that has
it, and only the touched neighbours get new pairs. The shards' pieces and ids go to
sorted arrays in the shared folder; workers map them and lay each document's ids out.

A piece is known by its hash and then compared byte for byte, so nothing rests on
hashes being distinct. A shard is replayed in blocks of BLOCK bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._arrow import bytes_of, offsets_of, slices, texts_of
from quadloom.llm._shared import Held, map_array, text_bytes, work_dir, write_file
from quadloom.llm.tokens import Ids, lay_out, pieces

#: In front of and behind every piece.
EDGE = -1
#: Bytes of pieces that are replayed together, above which a piece is replayed by itself, and that a task holds.
BLOCK, LONG, HELD = 8 << 20, 512, 32 << 20
#: Bytes of text for which there is a shard of pieces: what a shard gets is less, even if no piece repeats.
SHARD = 256 << 20
#: Shards whose files a worker has mapped at a time.
MAPPED = 4096


class Ranks:
    """A vocabulary by ranks: bytes of each id, and rank of each mergeable pair of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # a pair may merge if its joined bytes are a token, whichever way they split
        pairs = sorted((ranks[t[:k]] * self.size + ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys = np.array([p for p, _ in pairs], np.int64)
        self.made = np.array([r for _, r in pairs], np.int64)
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.length)])
        self.letters = np.frombuffer(b"".join(self.token), np.uint8)

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))

    def pair(self, left: int, right: int) -> int:
        """As merged, of one pair."""
        return self.pairs.get(left * self.size + right, self.size) if left >= 0 and right >= 0 else self.size

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair of ids becomes; size where it stays."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.made[at], self.size)


@functools.cache
def load(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)})


def replay(vocab: pa.Array, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of the distinct pieces in vocab."""
    n, at = len(vocab), offsets_of(vocab)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = at - at[0]
    spot = np.arange(at[-1]) + np.repeat(np.arange(n), np.diff(at)) + 1
    symbol = np.full(at[-1] + n + 1, EDGE, np.int64)
    symbol[spot] = ranks.of_byte[bytes_of(vocab)]
    owner = np.zeros(len(symbol), np.int64)
    owner[spot] = np.repeat(np.arange(n), np.diff(at))
    after = np.arange(1, len(symbol) + 1)
    before = np.arange(-1, len(symbol) - 1)

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(where: np.ndarray) -> None:
        """Enters the pairs that start at where."""
        made = ranks.merged(symbol[where], symbol[after[where]])
        where, made = where[made < ranks.size], made[made < ranks.size]
        if not len(where):
            return
        order = np.argsort(made, kind="stable")
        where, made = where[order], made[order]
        first = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]]))
        for rank, group in zip(made[first].tolist(), np.split(where, first[1:]), strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(queue, rank)
            index[rank].append(group)

    add(spot)
    while queue:
        rank = heapq.heappop(queue)
        groups = index.pop(rank)
        where = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        # positions whose pair has changed since are no longer this merge's
        where = where[symbol[where] >= 0]
        where = where[ranks.merged(symbol[where], symbol[after[where]]) == rank]
        if not len(where):
            continue
        # a piece merges its leftmost pair first: in vocabularies whose ranks do not
        # grow with length that can bring up a pair of lesser rank
        where = np.sort(where)
        first = np.concatenate([[True], owner[where[1:]] != owner[where[:-1]]])
        if not first.all():
            index[rank] = [where[~first]]
            heapq.heappush(queue, rank)
            where = where[first]
        gone = after[where]
        symbol[where] = rank
        symbol[gone] = EDGE - 1
        after[where] = after[gone]
        before[after[where]] = where
        left = before[where]
        add(np.concatenate([left[symbol[left] >= 0], where]))
    alive = symbol >= 0
    return np.bincount(owner[alive], minlength=n), symbol[alive]


def replay_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one long piece, its pairs in a queue by rank and place."""
    symbol = ranks.of_byte[np.frombuffer(piece, np.uint8)].tolist()
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    made = ranks.merged(np.array(symbol[:-1]), np.array(symbol[1:]))
    queue = [(rank, at) for at, rank in enumerate(made.tolist()) if rank < ranks.size]
    heapq.heapify(queue)
    while queue:
        rank, at = heapq.heappop(queue)
        right = after[at]
        if symbol[at] < 0 or right >= n or ranks.pair(symbol[at], symbol[right]) != rank:
            continue
        symbol[at], symbol[right] = rank, EDGE
        after[at] = after[right]
        if after[at] < n:
            before[after[at]] = at
        for left, x in ((before[at], at), (at, after[at])):
            if left >= 0 and x < n and (new := ranks.pair(symbol[left], symbol[x])) < ranks.size:
                heapq.heappush(queue, (new, left))
    return [x for x in symbol if x >= 0]


def replayed(vocab: pa.Array, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """As replay, a block at a time, and pieces above LONG bytes by themselves."""
    sizes, ids = np.zeros(len(vocab), np.int64), [np.zeros(0, np.int64)]
    length = np.diff(offsets_of(vocab))
    parts = np.cumsum(np.minimum(length, LONG)) // BLOCK
    for k in np.unique(parts).tolist():
        rows = np.flatnonzero(parts == k)
        short = length[rows] <= LONG
        sizes[rows[short]], flat = replay(vocab.take(pa.array(rows[short])), ranks)
        apart = {}
        for row in rows[~short].tolist():
            apart[row] = np.array(replay_long(vocab[row].as_py(), ranks), np.int64)
            sizes[row] = len(apart[row])
        if apart:  # back into the order of rows
            ends = iter(np.split(flat, np.cumsum(sizes[rows[short]])[:-1])) if short.any() else iter(())
            flat = np.concatenate([apart[row] if row in apart else next(ends) for row in rows.tolist()])
        ids.append(flat)
    return sizes, np.concatenate(ids)


# the corpus's pieces


def _hashes(vocab: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in vocab.to_pylist()), np.uint64, len(vocab))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def learn(texts: DataFrame, path: str) -> tuple[str, int]:
    """Replays the merges over every distinct piece of texts (one column). Folder of the shards' arrays, and their number, which grows with the texts' bytes."""
    spark = texts.sparkSession
    uri, shards = work_dir(spark, "pieces"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(texts, texts.columns[0]) // SHARD))

    def deal(held: list[pa.Array]) -> pa.RecordBatch:
        vocab = pc.unique(pa.chunked_array(held))
        shard = _shard(_hashes(vocab), shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vocab.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), lists], ["shard", "pieces"]).filter(pa.array(np.diff(ends) > 0))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 0):
            vocab = pieces(texts_of(batch.column(0))).vocab
            held.append(vocab)
            size += vocab.nbytes
            if size > HELD:
                held = [pc.unique(pa.chunked_array(held))]
                size = held[0].nbytes
                if size > HELD // 2:
                    yield deal(held)
                    held, size = [], 0
        if size:
            yield deal(held)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        vocab = pc.unique(pa.chunked_array([x.values for x in table["pieces"]]))
        hashes = _hashes(vocab)
        order = np.argsort(hashes)
        vocab = vocab.take(pa.array(order))
        sizes, ids = replayed(vocab, load(path))
        bounds = offsets_of(vocab)
        write_file(f"{uri}/hash-{shard}", [hashes[order]])
        write_file(f"{uri}/ends-{shard}", [np.stack([bounds - bounds[0], np.concatenate([[0], np.cumsum(sizes)])]).astype(np.int64)])
        write_file(f"{uri}/bytes-{shard}", [bytes_of(vocab)])
        write_file(f"{uri}/ids-{shard}", [ids.astype(np.int32)])
        return pa.table({"shard": pa.array([shard], pa.int32())})

    done = {r["shard"] for r in texts.mapInArrow(find, "shard int, pieces array<binary>").groupBy("shard").applyInArrow(write, "shard int").collect()}
    for shard in set(range(shards)) - done:
        for name in ("hash", "ends", "bytes", "ids"):
            write_file(f"{uri}/{name}-{shard}", [])
    return uri, shards


class Known:
    """The corpus's pieces and their ids, mapped."""

    def __init__(self, uri: str, shards: int, path: str):
        self.ranks, self.uri, self.shards, self.open = load(path), uri, shards, Held(MAPPED)

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, ends of bytes and of ids, bytes, and ids of a shard's pieces."""
        kinds = {"hash": np.uint64, "ends": np.int64, "bytes": np.uint8, "ids": np.int32}
        hashes, ends, letters, ids = self.open.get(s, lambda: [map_array(f"{self.uri}/{name}-{s}", kind) for name, kind in kinds.items()])
        return hashes, ends.reshape(2, -1), letters, ids

    def kinds(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of distinct pieces. One that is not found is replayed here."""
        at, data, hashes = offsets_of(vocab), bytes_of(vocab), _hashes(vocab)
        at = at - at[0]
        sizes, begin, shard = np.full(len(vocab), -1), np.zeros(len(vocab), np.int64), _shard(hashes, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            rows, (known, ends, letters, _) = order[cuts[s] : cuts[s + 1]], self.shard(s)
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
            rows, place = rows[known[place] == hashes[rows]], place[known[place] == hashes[rows]]
            length, start = at[rows + 1] - at[rows], ends[0][place]
            same = ends[0][place + 1] - start == length
            rows, place, length, start = rows[same], place[same], length[same], start[same]
            if not len(rows):
                continue
            firsts = np.cumsum(length) - length
            byte = np.arange(length.sum()) - np.repeat(firsts, length)
            equal = letters[byte + np.repeat(start, length)] == data[byte + np.repeat(at[rows], length)]
            same = np.logical_and.reduceat(equal, firsts)
            rows, place = rows[same], place[same]
            begin[rows] = ends[1][place]
            sizes[rows] = ends[1][place + 1] - begin[rows]
        lost = np.flatnonzero(sizes < 0)
        more = np.zeros(0, np.int64)
        if len(lost):
            sizes[lost], more = replayed(vocab.take(pa.array(lost)), self.ranks)
        to = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int64)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[s] : cuts[s + 1]]
            rows = rows[~np.isin(rows, lost)] if len(lost) else rows
            n = sizes[rows]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[step + np.repeat(to[rows], n)] = self.shard(s)[3][step + np.repeat(begin[rows], n)]
        n = sizes[lost]
        flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(to[lost], n)] = more
        return sizes, flat

    def encode(self, texts: pa.StringArray) -> Ids:
        found = pieces(texts)
        return lay_out(found, *self.kinds(found.vocab))


@functools.lru_cache(2)
def known(uri: str, shards: int, path: str) -> Known:
    return Known(uri, shards, path)


def encode(texts: pa.StringArray, ranks: Ranks) -> Ids:
    """Ids of texts whose pieces are replayed here and now."""
    found = pieces(texts)
    return lay_out(found, *replayed(found.vocab, ranks))


def decode(got: Ids, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of the texts that the ids stand for."""
    length = ranks.length[got.ids]
    ends = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(ends[-1]) + np.repeat(ranks.starts[got.ids] - ends[:-1], length)
    return ends[got.bounds], ranks.letters[place]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id count and digests of the ids and of the decoded bytes of each document.

    Only distinct pieces pass a shuffle, once; the texts are read twice.
    Null texts count as empty, with no ids; repeated rows and null ids keep their
    places; an empty table gives an empty result.
    """

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    place = learn(cols.select("text"), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path)
        for batch in slices(batches, 1):
            got = known(*place, path).encode(texts_of(batch.column(1)))
            stream, bounds = got.ids.astype("<u4"), got.bounds.tolist()
            cut, data = decode(got, ranks)
            cut = cut.tolist()
            sha = hashlib.sha256
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(got.bounds), pa.int64()),
                    pa.array([sha(stream[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                    pa.array([sha(data[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return cols.mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, path: str, name: str = "token_ids", text: str = "text") -> DataFrame:
    """docs and a column of their ids, array<int>."""
    from pyspark.sql import types as T

    at, place = docs.columns.index(text), learn(docs.select(F.col(text)), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            got = known(*place, path).encode(texts_of(batch.column(at)))
            ids = pa.ListArray.from_arrays(pa.array(got.bounds, pa.int32()), pa.array(got.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))
