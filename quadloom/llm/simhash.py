"""Near duplicates by SimHash: exact comparison of fingerprints in tiles.

Fingerprints (not documents: equal ones count once) are dealt into tiles by the
bit counts of their two halves, in steps of eight for wide radii. Two fingerprints within the radius have half
counts whose differences add up to the radius at most, so tile pairs further
apart are skipped; every other pair is compared in full with numpy exclusive-or
and bit counts. Tiles above TILE rows are cut into pieces and each pair of pieces
is one unit of work, so no unit grows with the input. A unit returns a spanning
forest of the links that it finds, never all pairs of a group, which keeps every
connection. The number of units grows with the square of the fingerprints, as
comparing all of them must; see the README.

Documents without words (null and empty texts among them) have fingerprint zero
and link like any other. Repeated rows share a fingerprint and hence a component.
A null id stands for no document and never names a component; its row still gets
the component of its fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm._arrow import LOWER, SLICE, bytes_of, offsets_of, slices, texts_of, word_hashes, words
from quadloom.llm._shared import among, cut, fresh, join_hot, map_array, open_fs, put, work_dir, write_file
from quadloom.llm.components import components

SEED = 42
#: Most fingerprints in a piece of a tile.
TILE = 4096
#: Spreads a byte's bits, lowest first, over the eight bytes of a word.
SPREAD = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: pa.StringArray, size: int = 3) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats counted; 0 without words."""
    w = words(texts, LOWER)
    counts, n = w.counts, len(w.counts)
    if not len(w.flat):
        return np.zeros(n, np.uint64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(w.bounds, pa.int32()), w.flat), " ")
    buffer, length = bytes_of(joined).tobytes(), np.diff(offsets_of(w.flat))
    # word j starts where the words before it and their spaces end; texts have no last space
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]]) - np.cumsum(counts > 0)[w.text_of] + 1
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(n), shingles)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(bounds[-1]) - bounds[owner] + w.bounds[owner]
    last = np.minimum(first + size, w.bounds[owner + 1]) - 1
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(buffer[a:b], SEED) for a, b in zip(start[first].tolist(), (start[last] + length[last]).tolist(), strict=True)), np.uint64, len(first))
    # bits add up bytewise for up to 255 shingles, then in full width
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] or [np.zeros(0)]).astype(np.int64)
    spread = np.stack([np.add.reduceat(SPREAD[hashes.view(np.uint8)[k::8]], cuts) for k in range(8)], axis=1)
    full = np.flatnonzero(shingles)
    bits = np.add.reduceat(spread.view(np.uint8).reshape(len(cuts), 64), np.searchsorted(cuts, bounds[full]), axis=0, dtype=np.int64)
    out = np.zeros(n, np.uint64)
    out[full] = ((bits * 2 > shingles[full, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _with_longs(docs: DataFrame, name: str, text: str, of: Callable[[pa.StringArray], np.ndarray]) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 2 << 20):
            longs = pa.array(of(texts_of(batch.column(at))).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, longs], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", size: int = 3) -> DataFrame:
    """docs and their fingerprints as signed longs; rows and order stay."""
    return _with_longs(docs, name, text, lambda texts: fingerprints(texts, size))


def close(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of a and b whose exclusive-or has radius bits or fewer, and how many, a block of rows at a time."""
    for at in range(0, len(a), rows):
        bits = np.bitwise_count(a[at : at + rows, None] ^ b[None, :])
        i, j = np.nonzero(bits <= radius)
        yield i + at, j, bits[i, j]


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, links: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the pair of pieces connects; at most len(a) + len(b) - 1.

    links decides on a pair within the radius; it is asked for closer pairs first, and
    not for pairs that are connected already.
    """
    parent = np.arange(len(a) + (0 if same else len(b)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift, found = 0 if same else len(a), []
    for i, j, bits in close(a, b, radius):
        if same:
            i, j, bits = i[i < j], j[i < j], bits[i < j]
        while (parent[parent] != parent).any():  # every node to its root
            parent = parent[parent]
        apart = np.flatnonzero(parent[i] != parent[j + shift])
        for k in apart[np.argsort(bits[apart], kind="stable")].tolist():
            x, y = int(i[k]), int(j[k])
            p, q = root(x), root(y + shift)
            if p != q and (links is None or links(x, y)):
                parent[max(p, q)] = min(p, q)
                found.append((x, y))
    return found


# sets of shingles, for links that a similarity decides


def shingle_sets(texts: pa.StringArray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct word shingles of each text, and their 32-bit hashes, ascending within a text."""
    w = words(texts, LOWER)
    hashes, counts = word_hashes(w.vocab), w.counts
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(counts)), shingles)
    first = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + w.bounds[owner]
    mixed = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < w.bounds[owner + 1]
        word = hashes[w.codes[np.minimum(first + k, len(w.codes) - 1)]] if len(first) else mixed
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word, np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    key = np.unique(owner.astype(np.uint64) << np.uint64(32) | mixed >> np.uint64(32))
    return np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(counts)), (key & np.uint64(0xFFFFFFFF)).astype("<u4")


def digests(n: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """64-bit digest of each set, the sets of n shingles lying one after the other."""
    buffer, ends = sets.tobytes(), np.cumsum(n) * 4
    return np.fromiter((xxhash.xxh64_intdigest(buffer[a:b], SEED) for a, b in zip((ends - n * 4).tolist(), ends.tolist(), strict=True)), np.uint64, len(n))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two ascending sets have a Jaccard similarity of least or more."""
    small, large = sorted((len(a), len(b)))
    if small < least * large or not small:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (small + large - common)


def with_sets(docs: DataFrame, uri: str, text: str = "text", size: int = 3, by: int = 5) -> DataFrame:
    """docs without their texts, with fingerprints (print), digests of the shingle sets (node) and where each text's set lies (part, at, n).

    A task writes its sets, four bytes for a shingle, to one file in the folder.
    """
    at_text = docs.columns.index(text)
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_fs(uri)
        part, place = TaskContext.get().partitionId(), 0
        draft = f"{folder}/{part}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as out:
            for batch in slices(batches, at_text, SLICE):
                texts = texts_of(batch.column(at_text))
                n, sets = shingle_sets(texts, by)
                out.write(sets.tobytes())
                at = place + np.cumsum(n) - n
                place += len(sets)
                added = [pa.array(fingerprints(texts, size).view(np.int64)), pa.array(digests(n, sets).view(np.int64)), pa.array(np.full(len(n), part), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], [*names, "print", "node", "part", "at", "n"])
        put(store, draft, f"{folder}/{part}")

    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("print", "node", "part", "at", "n"))]))


_sets: dict[str, np.ndarray] = {}


def _set(uri: str, part: int, at: int, n: int) -> np.ndarray:
    key = f"{uri}/{part}"
    if key not in _sets:
        if len(_sets) > 512 or not all(k.startswith(uri) for k in _sets):
            _sets.clear()
        _sets[key] = map_array(key, np.uint32)
    return _sets[key][at : at + n]


def _reach(radius: int, grain: int) -> list[tuple[int, int]]:
    """Differences of halves' steps that the radius allows, one of each opposite pair, zero first. A step is grain counts, so steps that differ by d are (d - 1) * grain + 1 counts apart at least."""
    least = lambda d: max(0, (abs(d) - 1) * grain + 1)
    span = range(-(radius // grain + 1), radius // grain + 2)
    return [(0, 0), *((x, y) for x in span for y in span if least(x) + least(y) <= radius and (x, y) > (0, 0))]


def links(prints: DataFrame, radius: int = 3, sets: str | None = None, least: float = 0.8) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column print) as all pairs within radius would.

    With the folder of their shingle sets (and columns node, part, at, n) rows are
    distinct pairs of fingerprint and set, links are between nodes, and a pair within
    the radius is a link only if the sets are similar.
    """
    # wide radii reach most tiles anyway: coarse steps then keep the number of units down
    grain = 1 if radius <= 4 else 8
    fields = ["print"] if sets is None else ["print", "node", "part", "at", "n"]
    halves = [F.floor(F.bit_count(F.shiftrightunsigned("print", k).bitwiseAND(F.lit(0xFFFFFFFF))) / grain).cast("int") for k in (0, 32)]
    tiled = prints.select(*fields, (halves[0] * 64 + halves[1]).alias("tile"))
    pieces = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("pieces"))

    uri = work_dir(prints.sparkSession, "tiles")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        tile, piece = (k.as_py() for k in key)
        write_file(f"{uri}/{tile}-{piece}", [np.stack([table[c].to_numpy() for c in fields])])
        return pa.table({"tile": pa.array([tile], pa.int32()), "piece": pa.array([piece], pa.int32())})

    # at most some TILE rows in a group: a hash of fingerprint and set deals a tile's rows over its pieces
    pieced = tiled.join(pieces, "tile").select(*fields, "tile", F.pmod(F.xxhash64(*fields[:2]), F.col("pieces")).cast("int").alias("piece"))
    known = cut(pieced.groupBy("tile", "piece").applyInArrow(write, "tile int, piece int"))

    # a unit names two pieces; workers map their files, so that no piece passes a shuffle for each of its units
    near = F.array(*(F.lit(x * 64 + y) for x, y in _reach(radius, grain)))
    units = known.select(F.col("tile").alias("t1"), F.col("piece").alias("i"), F.explode(near).alias("d")).withColumn("t2", F.col("t1") + F.col("d")).drop("d")
    units = units.join(known.select(F.col("tile").alias("t2"), F.col("piece").alias("j")), "t2").where("t1 <> t2 or i <= j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = 0 if sets is None else 1
        for batch in batches:
            for t1, i, t2, j in zip(*(batch.column(c).to_pylist() for c in ("t1", "i", "t2", "j")), strict=True):
                a, b = _piece(uri, t1, i, len(fields)), _piece(uri, t2, j, len(fields))
                check = None if sets is None else lambda x, y, a=a, b=b: similar(_set(sets, *a[2:, x].tolist()), _set(sets, *b[2:, y].tolist()), least)
                found = np.array(forest(a[0].view(np.uint64), b[0].view(np.uint64), radius, (t1, i) == (t2, j), check), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(a[named][found[:, 0]]), pa.array(b[named][found[:, 1]])], ["a", "b"])

    # dealt by a hash: one piece's pairs, which a join brings together, go to all tasks
    slots = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(slots, F.xxhash64("t1", "i", "t2", "j")).mapInArrow(compare, "a long, b long")


@functools.lru_cache(128)
def _piece(uri: str, tile: int, piece: int, fields: int) -> np.ndarray:
    return map_array(f"{uri}/{tile}-{piece}", np.int64).reshape(fields, -1)


# pairs beyond the radius, by shingles that both sets must share

#: Hash bits of the table of shingle counts, and the files that hold it.
COUNT_BITS, COUNT_FILES = 18, 256
#: Roots and dissimilar pairs that a task remembers before it starts afresh.
REMEMBERED = 100_000
_PLACE = "part long, at long, n long"


def _count_shingles(members: DataFrame, sets: str) -> str:
    """Folder of how many shingles of each hash range all members' sets hold."""
    uri, width = work_dir(members.sparkSession, "shingle-counts"), (1 << COUNT_BITS) // COUNT_FILES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, step = np.zeros(1 << COUNT_BITS, np.int64), 1 << 20
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in ("part", "at", "n")])
            for part, at, n in places[:, np.lexsort(places[1::-1])].T.tolist():  # file by file
                for k in range(0, n, step):
                    np.add.at(counts, _set(sets, part, at + k, min(step, n - k)) >> (32 - COUNT_BITS), 1)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_FILES), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(COUNT_FILES, width)], pa.binary())], ["piece", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        write_file(f"{uri}/{key[0].as_py()}", [total])
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32())})

    members.select("part", "at", "n").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int").collect()
    return uri


def _counts(uri: str) -> np.ndarray:
    return np.concatenate([map_array(f"{uri}/{k}", np.int64) for k in range(COUNT_FILES)])


@functools.lru_cache(2)
def _ranks(uri: str) -> np.ndarray:
    """Place of each hash range in the ascending order of counts; few bits, however large these are."""
    return np.unique(_counts(uri), return_inverse=True)[1].astype(np.uint64)


def prefix(held: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a set, rarest first: as many as leave fewer than least of the set, so two sets of that similarity share one."""
    key = np.sort(ranks[held >> np.uint32(32 - COUNT_BITS)] << np.uint64(32) | held)
    return (key[: len(held) - math.ceil(least * len(held) - 1e-9) + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def rare_links(members: DataFrame, sets: str, least: float = 0.8) -> DataFrame:
    """Links (a, b) of roots that connect whatever sets have a similarity of least or more and lie apart as yet.

    members: node, root, part, at, n of each distinct set. All sets' shingles are put in
    one order, rare ones (by counts of hash ranges over all sets) first. Two similar sets share a
    shingle of their prefixes, so comparing the sets that meet at each prefix shingle
    finds every such pair; no fingerprint takes part. Shingles that only sets of one
    root share are left out before places are shuffled. A shingle of more than TILE
    sets is cut into pieces and each pair of pieces is one unit, as tiles are.
    """
    spark = members.sparkSession
    slots, cap = int(spark.conf.get("spark.sql.shuffle.partitions")), TILE
    members = members.where("n > 0").select("node", "root", "part", "at", "n")
    table, uri = _count_shingles(members, sets), work_dir(spark, "shared-shingles")
    # rows are few and small, so few tasks hold them; each has hundreds of shingles, which a task aggregates in memory
    members = cut(members.repartition(slots, F.xxhash64("node")))

    def prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        places = np.stack([batch.column(k).to_numpy() for k in range(5)])
        return places, [prefix(_set(sets, *p), _ranks(table), least) for p in places[2:].T.tolist()]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            places, found = prefixes(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(places[1], [len(x) for x in found]))], ["token", "root"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        kept = table.sort_by("token")
        write_file(f"{uri}/{key[0].as_py()}", [kept["token"].to_numpy(), kept["pieces"].to_numpy()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())})

    met = members.mapInArrow(tokens, "token long, root long").groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count(F.lit(1)) / cap).alias("pieces"))
    shared = met.where("a <> b").select(F.pmod("token", F.lit(slots)).alias("shard"), "token", "pieces")
    written = sorted(r["shard"] for r in shared.groupBy("shard").applyInArrow(write, "shard long").collect())

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: map_array(f"{uri}/{s}", np.int64).reshape(2, -1) for s in written}
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            places, found = prefixes(batch)
            length = np.array([len(x) for x in found])
            token, row = np.concatenate(found), np.repeat(np.arange(len(found)), length)
            rank = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            pieces, shard = np.zeros(len(token), np.int64), token % slots
            for s in np.intersect1d(shard, written).tolist():
                at = np.flatnonzero(shard == s)
                place = np.minimum(np.searchsorted(held[s][0], token[at]), held[s].shape[1] - 1)
                pieces[at] = np.where(held[s][0][place] == token[at], held[s][1][place], 0)
            at = np.repeat(np.arange(len(token)), pieces)  # a row for each piece that the set's own one meets
            other = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            own = ((places[0, row[at]].view(np.uint64) >> np.uint64(16)) % np.maximum(pieces[at], 1).astype(np.uint64)).astype(np.int64)
            columns = [token[at], np.minimum(own, other), np.maximum(own, other), own, rank[at], *places[1:, row[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "p", "q", "own", "rank", "root", "part", "at", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = _Meeting(sets, least), np.zeros((9, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(9)])], axis=1)
            cuts = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield task.links(held[:, : cuts[-1]], [0, *cuts.tolist()])
                held = held[:, cuts[-1] :]
        yield task.links(held, [0, held.shape[1]])

    rows = members.mapInArrow(meetings, f"token long, p long, q long, own long, rank long, root long, {_PLACE}")
    dealt = rows.repartition(slots, F.xxhash64("token", "p", "q")).sortWithinPartitions("token", "p", "q")
    return dealt.mapInArrow(compare, "a long, b long")


class _Meeting:
    """Compares the sets that meet at a shingle; remembers what a task has connected."""

    def __init__(self, sets: str, least: float):
        self.sets, self.least, self.parent, self.apart = sets, least, {}, set()

    def root(self, x: int) -> int:
        parent = self.parent
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    def links(self, rows: np.ndarray, cuts: list[int]) -> pa.RecordBatch:
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            group = rows[:, a:b]
            if b - a > 1 and (group[5] != group[5, 0]).any():
                found += self.group(group)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def group(self, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        p, q, own, rank, root, n = rows[1, 0], rows[2, 0], rows[3], rows[4], rows[5], rows[8]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        for at in range(0, len(left), 256):
            i, j = left[at : at + 256, None], right[None, :]
            # before the first shingle that two prefixes share there is none; a pair that fails here met earlier or is dissimilar
            most = np.minimum(n[i] - rank[i], n[j] - rank[j])
            fit = (root[i] != root[j]) & (most >= self.least * (n[i] + n[j] - most) - 1e-9)
            if p == q:
                fit &= i < j
            for x, y in zip(*np.nonzero(fit), strict=True):
                x, y = int(left[at + x]), int(right[y])
                c, d = self.root(int(root[x])), self.root(int(root[y]))
                if c == d:
                    continue
                one, two = tuple(rows[6:, x].tolist()), tuple(rows[6:, y].tolist())
                pair = (one, two) if one < two else (two, one)
                if pair in self.apart:
                    continue
                if len(self.parent) + len(self.apart) > REMEMBERED:
                    self.parent, self.apart = {}, set()
                    c, d = int(root[x]), int(root[y])
                if similar(_set(self.sets, *one), _set(self.sets, *two), self.least):
                    self.parent[max(c, d)] = min(c, d)
                    yield int(root[x]), int(root[y])
                else:
                    self.apart.add(pair)


def _rooted(rows: DataFrame, radius: int, sets: str | None = None, least: float = 0.8, rest: bool = False) -> DataFrame:
    """(print, root) of every fingerprint in rows, or (node, root) of every set, root being the least that links reach.

    Sets of one fingerprint are rows of their own, so each is compared with all others.
    With rest, similar sets beyond the radius are linked too.
    """
    key = "print" if sets is None else "node"
    names = rows.select(key).distinct()
    placed = names if sets is None else rows.groupBy("print", "node").agg(F.min(F.struct("part", "at", "n")).alias("x")).select("print", "node", "x.*")
    roots = components(cut(links(placed, radius, sets, least))).withColumnsRenamed({"node": key})
    rooted = names.join(roots, key, "left").select(key, F.coalesce("root", key).alias("root"))
    if not rest:
        return rooted
    members = cut(placed.groupBy("node").agg(F.min(F.struct("part", "at", "n")).alias("x")).select("node", "x.*").join(rooted, "node"))
    tops = components(cut(rare_links(members, sets, least))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = cut(members.select("root").distinct().join(tops, "root", "left").select("root", F.coalesce("top", "root").alias("top")))
    return join_hot(members, every, "root").select("node", F.col("top").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(id, print, component_id) for each document: its fingerprint and the smallest id reachable by links."""
    rows = cut(with_fingerprint(docs.select(F.col(id_col), F.col(text)), "print", text, size).drop(text))
    # a third of the rows may share a fingerprint: its least id is aggregated before the shuffle
    least = rows.groupBy("print").agg(F.min(id_col).alias("least"))
    named = cut(least.join(_rooted(rows, radius), "print"))
    # a third of the fingerprints may be one component, and a third of the rows one fingerprint
    mapped = cut(join_hot(named, named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id"))
    return join_hot(rows, mapped, "print").select(id_col, "print", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, least: float | None = None, by: int = 5, rest: bool = False) -> DataFrame:
    """docs without all but one document of each component, with all their columns.

    With least, fingerprints only nominate: a pair within the radius is a link if the
    Jaccard similarity of its texts' sets of by-word shingles (32-bit hashes, whole
    texts) is least or more. Texts of one set (64-bit digests) count as alike, those
    of one fingerprint only if their sets are similar. With rest (which needs least)
    similar pairs beyond the radius are links too, so the radius changes no result.
    The row with the smallest id stays (ids that are null come last, then the smaller
    fingerprint, or digest of the set, decides). Rows that repeat both id and that
    count as one document. Where every row has an integer id of its own, texts pass no
    shuffle: a row's id is looked up among those that go.
    """
    cols, sets = docs.select(F.col(id_col).alias("__id"), F.col(text)), None if least is None else work_dir(docs.sparkSession, "sets")
    rows = cut(with_fingerprint(cols, "print", text, size).drop(text) if sets is None else with_sets(cols, sets, text, size, by))
    key = "print" if sets is None else "node"
    rooted = _rooted(rows, radius) if sets is None else _rooted(rows, radius, sets, least, rest)
    rooted = cut(rooted)
    keys = cut(join_hot(cut(rows.groupBy("__id", key).agg(F.count(F.lit(1)).alias("n"))), rooted, key))
    order = F.struct(F.col("__id").isNull(), F.col("__id"), F.col(key))
    first = cut(keys.groupBy("root").agg(F.min(order).alias("first")))
    verdicts = cut(join_hot(keys, first, "root").select("__id", F.col(key).alias("__key"), "n", (order != F.col("first")).alias("__gone")))
    ids = verdicts.groupBy("__id").agg(F.sum("n").alias("n"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType) and ids.where("n > 1 or __id is null").isEmpty():
        return docs.where(~among(verdicts.where("__gone").select(F.col("__id").cast("long").alias("id")))(F.col(id_col).cast("long")))
    own, its_id, its_key, gone = (fresh(docs, name) for name in ("__key", "__other_id", "__other_key", "__gone"))
    notable = cut(verdicts.where("__gone or n > 1").select(F.col("__id").alias(its_id), F.col("__key").alias(its_key), F.col("__gone").alias(gone)))
    marked = with_fingerprint(docs, own, text, size) if sets is None else _with_longs(docs, own, text, lambda texts: digests(*shingle_sets(texts, by)))
    joined = marked.join(notable, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_key)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = joined.where(F.col(gone).isNull()).select(columns)
    if notable.where(~F.col(gone)).isEmpty():
        return kept
    return kept.union(joined.where(~F.col(gone)).dropDuplicates([id_col, own]).select(columns))


def contract(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
