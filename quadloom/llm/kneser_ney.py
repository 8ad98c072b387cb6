"""Perplexity by an interpolated modified Kneser-Ney n-gram model of any order.

Spark counts: tasks aggregate their own n-grams with numpy and pass blocks of them to
shards. A shard merges its n-grams, writes them as a sorted hash array into the shared
folder and passes their suffixes on, as the next lower order's n-grams, whose count is
the number of distinct words in front. Workers map the arrays and look n-grams up by
binary search, hence hold none of the model in memory.

Words are numbered by falling count (whole powers of two apart), so n-grams are short
rows of mostly small numbers, and are told apart by these numbers while they are counted. (A word is
its 64-bit hash.) In the arrays an
n-gram is a bucket of its shard and 32 bits of its 64-bit hash: some five bytes, and a
chance of one in 500 million that an unseen n-gram is taken for a seen one.

No group is unbounded: words have a shard for every WORDS bytes of text, n-grams one for every SHARE training tokens, and an n-gram
goes to a shard by its context, so that a context's statistics come from one place. A
context that could exceed a shard's share has only frequent words in it; such contexts
are dealt over all shards n-gram by n-gram and their partial statistics are added up one
step later. The driver sees rows of statistics for each shard. Workers keep the files of the MAPPED
shards used last mapped.

Null texts are empty and consist of the end token only. Repeated rows count as
often as they come; a null id is in no held-out bucket and so is learnt from. With
nothing to learn from every token has probability 1 and all scores are 0.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._arrow import LOWER, bucket_crc, per_text, slices, texts_of, word_hashes, words
from quadloom.llm._shared import Held, map_array, text_bytes, work_dir, write_file

#: The end token's hash; its text is no word's.
END = xxhash.xxh64_intdigest(b"")
#: N-grams that a task holds before it passes them on.
HELD = 4_000_000
#: Training tokens for which there is a shard.
SHARE = 8_000_000
#: Bytes of text for which there is a shard of words: what a shard gets is less, even if no word repeats.
WORDS = 128 << 20
#: Shards of a kind whose files a worker has mapped at a time.
MAPPED = 4096
#: Rows of a step: n-grams, partial statistics of contexts, and statistics for the driver.
GRAMS, CONTEXTS, STATS = range(3)
ROWS = "shard int, kind int, block binary, stats array<bigint>"
U = np.uint64


class Model(NamedTuple):
    """Where the arrays are and the numbers that hold for all n-grams.

    V words in word_shards shards; the first `frequent` numbers are words that may make
    a context too large for one of `shards` shards; discounts by order; kinds: bigrams
    that differ, lower_mass: what the lowest order leaves for equal shares.
    """

    uri: str
    order: int
    word_shards: int
    shards: int
    V: int
    frequent: int
    tokens: int
    discounts: tuple[tuple[float, float, float], ...]
    kinds: int
    lower_mass: float


# n-grams as columns of numbers


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each row."""
    out = np.full(len(columns[0]), 0x243F6A8885A308D3, U)
    for c in columns:
        out ^= c.astype(U)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15)):
            out ^= out >> U(shift)
            out *= U(factor)
    return out ^ out >> U(32)


def merged(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows with their counts added up; a count is 1 if not given."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order, first = _groups(mixed(columns))
    inner = np.ones(len(order), bool)
    inner[first] = False
    held, clash = [], False
    for c in columns:
        c = c[order]
        clash |= bool((inner[1:] & (c[1:] != c[:-1])).any())
        held.append(c[first])
    if clash:  # rows that share a hash
        order = np.lexsort(columns)
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])))
        held = [c[order[first]] for c in columns]
    counts = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    return held, counts


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where in it each group starts."""
    order = np.argsort(keys)
    ascending = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]]))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


class Dealing(NamedTuple):
    """Which shard an n-gram belongs to."""

    shards: int
    frequent: int
    begin: int

    def wide(self, context: list[np.ndarray], n: int) -> np.ndarray:
        """Rows whose context has frequent words only, and so may be too large for a shard."""
        out = np.ones(n, bool)
        for c in context:
            out &= (c < self.frequent) | (c == self.begin)
        return out

    def shard(self, columns: list[np.ndarray]) -> np.ndarray:
        wide = self.wide(columns[:-1], len(columns[0]))
        keys = mixed(columns[:-1]) if len(columns) > 1 else np.zeros(len(columns[0]), U)
        keys[wide] = mixed([c[wide] for c in columns])
        return shard_of(keys, self.shards)


# blocks


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows by their first two numbers, as compressed byte planes; the first column as differences, large counts apart."""
    key = columns[0].astype(U)
    order = np.argsort(key << U(32) | np.minimum(columns[1], 0xFFFFFFFF).astype(U) if len(columns) > 1 else key, kind="stable") if len(key) else np.zeros(0, np.int64)
    columns, counts = [c[order].astype(U) for c in columns], counts[order]
    columns[0] = np.diff(columns[0], prepend=U(0))
    large = np.flatnonzero(counts > 254)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    raw = b"".join((*planes, np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes(), counts[large].astype(np.int64).tobytes()))
    return np.array([len(key), len(columns), len(large), len(raw)], np.int64).tobytes() + _codec().compress(raw, asbytes=True)


def unpacked(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, width, large, size = np.frombuffer(block, np.int64, 4).tolist()
    raw = _codec().decompress(block[32:], size, asbytes=True)
    columns = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * k).reshape(8, n).T).view(U).ravel() for k in range(width)]
    columns[0] = np.cumsum(columns[0], dtype=U)
    counts = np.frombuffer(raw, np.uint8, n, 8 * n * width).astype(np.int64)
    tail = np.frombuffer(raw[(8 * width + 1) * n :], np.int64)
    counts[tail[:large]] = tail[large:]
    return columns, counts


def _gathered(blocks: list[bytes], begin: int) -> tuple[list[np.ndarray], np.ndarray]:
    narrow = np.uint32 if begin < 2**32 - 2 else U
    parts = [unpacked(b) for b in blocks]
    width = len(parts[0][0])
    columns = [np.concatenate([p[0][k].astype(narrow) for p in parts]) for k in range(width)]
    return merged(columns, np.concatenate([p[1] for p in parts]))


def _blocks(columns: list[np.ndarray], counts: np.ndarray, shard: np.ndarray) -> Iterator[tuple]:
    """Rows of kind GRAMS, one for each shard that gets some."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, b in zip(first, [*first[1:], len(shard)], strict=True):
        at = order[a:b]
        yield int(shard[a]), GRAMS, packed([c[at] for c in columns], counts[at]), None


def _counted(batches: Iterator[pa.RecordBatch], ngrams: Callable, shard: Callable) -> Iterator[pa.RecordBatch]:
    """Blocks of the n-grams of texts, added up in the task while that makes them fewer."""
    parts, held = [], 0

    def total() -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(len(parts[0][0]))]
        return merged(columns, np.concatenate([p[1] for p in parts]))

    for batch in slices(batches, 0):
        columns, counts = ngrams(texts_of(batch.column(0)))
        parts.append((columns, counts))
        held += len(counts)
        if held > HELD:
            parts = [total()]
            held = len(parts[0][1])
            if held > HELD // 2:
                yield _batch(list(_blocks(*parts[0], shard(parts[0][0]))))
                parts, held = [], 0
    if held:
        columns, counts = total()
        yield _batch(list(_blocks(columns, counts, shard(columns))))


_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


# sorted hash arrays


def _slots(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit mark of each hash."""
    spread = hashes * U(0x9E3779B97F4A7C15)
    return ((spread >> U(32)) * U(buckets) >> U(32)).astype(np.int64), hashes.astype(np.uint32)


def table(hashes: np.ndarray, *values: np.ndarray) -> list[bytes]:
    """A file of sorted marks in buckets of eight or so, and of small numbers for each; numbers from 255 on stand apart."""
    n, buckets = len(hashes), max(1, len(hashes) >> 3)
    bucket, mark = _slots(hashes, buckets)
    order = np.argsort(bucket.astype(U) << U(32) | mark.astype(U))
    offsets = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.uint32)
    parts, sizes = [offsets, mark[order]], []
    for v in values:
        v = v[order]
        large = np.flatnonzero(v > 254)
        sizes.append(len(large))
        parts += [np.minimum(v, 255).astype(np.uint8), large.astype(np.uint32), v[large].astype(np.int64)]
    head = np.array([n, buckets, len(values), *sizes], np.int64)
    return [head.tobytes(), *(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)]


class Table:
    """What table() has written, mapped."""

    def __init__(self, raw: np.ndarray):
        self.n = 0
        if not len(raw):
            return
        self.n, self.buckets, width = raw[:24].view(np.int64).tolist()
        sizes, at = raw[24 : 24 + 8 * width].view(np.int64).tolist(), 24 + 8 * width

        def part(count: int, dtype: type) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            out = raw[at : at + size].view(dtype)
            at += size + -size % 8
            return out

        self.offsets, self.marks = part(self.buckets + 1, np.uint32), part(self.n, np.uint32)
        self.values = [(part(self.n, np.uint8), part(m, np.uint32), part(m, np.int64)) for m in sizes]

    def find(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Numbers of each hash, a row for each of the width kinds; zeros for an unknown one."""
        out = np.zeros((width, len(hashes)), np.int64)
        if not self.n:
            return out
        bucket, mark = _slots(hashes, self.buckets)
        low, end = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        high = end.copy()
        while (open_ := low < high).any():  # binary search in all buckets at once
            middle = low + high >> 1
            less = open_ & (self.marks[np.minimum(middle, self.n - 1)] < mark)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        hit = np.flatnonzero(low < end)
        hit = hit[self.marks[low[hit]] == mark[hit]]
        at = low[hit]
        for row, (small, places, large) in zip(out, self.values, strict=True):
            found = small[at].astype(np.int64)
            big = np.flatnonzero(found == 255)
            found[big] = large[np.searchsorted(places, at[big])]
            row[hit] = found
        return out


# words


class Numbers(NamedTuple):
    """Of the words: shards, number of words, tokens, texts, and by bits of the count how many words a shard has."""

    shards: int
    V: int
    tokens: int
    bits: list[list[int]]


def _bits(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def _count_words(texts: DataFrame, uri: str, shards: int) -> Numbers:
    """Writes the words' hashes, counts and numbers."""

    def ngrams(column: pa.StringArray) -> tuple[list[np.ndarray], np.ndarray]:
        w = words(column, LOWER)
        return [np.append(word_hashes(w.vocab), U(END))], np.append(np.bincount(w.codes, minlength=len(w.vocab)), len(column))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, ngrams, lambda columns: shard_of(columns[0], shards))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        (keys,), counts = _gathered(rows["block"].to_pylist(), 2**63)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        write_file(f"{uri}/word-{shard}", [keys])
        write_file(f"{uri}/count-{shard}", [counts])
        return pa.Table.from_batches([_batch([(shard, STATS, None, [int(counts.sum()), *np.bincount(_bits(counts), minlength=64).tolist()])])])

    done = {r["shard"]: r["stats"] for r in texts.mapInArrow(count, ROWS).groupBy("shard").applyInArrow(write, ROWS).select("shard", "stats").collect()}
    for shard in range(shards):
        if shard not in done:
            write_file(f"{uri}/word-{shard}", [])
            write_file(f"{uri}/count-{shard}", [])
    bits = [done[s][1:] if s in done else [0] * 64 for s in range(shards)]
    numbers = Numbers(shards, sum(map(sum, bits)), sum(d[0] for d in done.values()), bits)
    _number_words(texts.sparkSession, uri, numbers)
    return numbers


def _number_words(spark, uri: str, numbers: Numbers) -> None:
    """Writes the words' numbers: frequent ones first, by bits of the count, then by shard and hash."""
    per = np.array(numbers.bits)[:, ::-1]
    base = (np.cumsum(per.T.ravel()) - per.T.ravel()).reshape(per.T.shape).T  # where each shard's words of so many bits begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                bits = 63 - _bits(np.asarray(map_array(f"{uri}/count-{s}", np.int64)))
                order = np.argsort(bits, kind="stable")
                rank = np.arange(len(bits)) - np.searchsorted(bits[order], bits[order])
                ids = np.empty(len(bits), np.int64)
                ids[order] = base[s][bits[order]] + rank
                write_file(f"{uri}/id-{s}", [ids])
                yield batch.slice(0, 0)

    spark.range(numbers.shards).mapInArrow(run, "id long").count()


class Words:
    """The word arrays, mapped."""

    def __init__(self, uri: str, shards: int):
        self.uri, self.shards, self.open = uri, shards, Held(MAPPED)

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, numbers and counts of a shard."""
        return self.open.get(s, lambda: (map_array(f"{self.uri}/word-{s}", U), *(map_array(f"{self.uri}/{name}-{s}", np.int64) for name in ("id", "count"))))

    def find(self, hashes: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """Number (unknown if there is none) and count of each word."""
        ids, counts = np.full(len(hashes), unknown, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        ends = np.searchsorted(shard_of(hashes[order], self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            rows, (known, numbers, times) = order[ends[s] : ends[s + 1]], self.shard(s)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
                hit = known[at] == hashes[rows]
                ids[rows[hit]], counts[rows[hit]] = numbers[at[hit]], times[at[hit]]
        return ids, counts


@functools.lru_cache(2)
def open_words(uri: str, shards: int) -> Words:
    return Words(uri, shards)


# n-grams


def ngrams_of(w, ids: np.ndarray, end: int, begin: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each token of the texts, ends included, the order - 1 before it (begin in front of a text) and itself, as columns; and the texts' bounds."""
    bounds = w.bounds + np.arange(len(w.counts) + 1)
    of = np.repeat(np.arange(len(w.counts)), np.diff(bounds))
    place = np.arange(bounds[-1]) + (order - 1) * (of + 1)
    narrow = np.uint32 if begin < 2**32 - 2 else U
    stream = np.full(bounds[-1] + (order - 1) * len(w.counts), begin, narrow)
    token = np.full(bounds[-1], end, narrow)
    token[np.arange(len(w.codes)) + w.text_of] = ids[w.codes]
    stream[place] = token
    return [stream[place - back] for back in range(order - 1, -1, -1)], bounds


def _count_ngrams(texts: DataFrame, uri: str, order: int, numbers: Numbers, dealing: Dealing) -> dict[int, np.ndarray]:
    """Writes the arrays of every order. By order: n-grams counted once, twice, three, four times and more than twice, kinds, total; for order 1 these are the whole context's."""
    begin = dealing.begin

    def ngrams(column: pa.StringArray) -> tuple[list[np.ndarray], np.ndarray]:
        w = words(column, LOWER)
        ids, _ = open_words(uri, numbers.shards).find(np.append(word_hashes(w.vocab), U(END)), begin + 1)
        return merged(ngrams_of(w, ids, int(ids[-1]), begin, order)[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, ngrams, dealing.shard)

    def step(k: int) -> Callable:
        def write(key: tuple, rows: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            if shard < 0:  # statistics on their way to the driver
                return rows.cast(_ARROW)
            kinds, blocks = np.array(rows["kind"]), rows["block"].to_pylist()
            if k < order:
                write_file(f"{uri}/wide-{k + 1}-{shard}", table(*_added([b for b, x in zip(blocks, kinds, strict=True) if x == CONTEXTS])))
            held = [b for b, x in zip(blocks, kinds, strict=True) if x == GRAMS]
            if not held:
                return pa.Table.from_batches([_batch([(-1, STATS, None, [k, shard] + [0] * 7)])])
            columns, counts = _gathered(held, begin)
            write_file(f"{uri}/gram-{k}-{shard}", table(mixed(columns), counts))
            often = [int((counts == c).sum()) for c in (1, 2, 3, 4)] + [int((counts > 2).sum()), len(counts), int(counts.sum())]
            out = [(-1, STATS, None, [k, shard, *often])]
            if k > 1:
                wide, contexts = dealing.wide(columns[:-1], len(counts)), mixed(columns[:-1])
                write_file(f"{uri}/context-{k}-{shard}", table(*_summed(contexts[~wide], counts[~wide])))
                partial = _summed(contexts[wide], counts[wide])
                to = shard_of(partial[0], dealing.shards)
                for s in np.unique(to).tolist():
                    out.append((s, CONTEXTS, np.stack([p[to == s].astype(np.int64) for p in partial]).tobytes(), None))
                lower, before = merged(columns[1:])
                out += _blocks(lower, before, dealing.shard(lower))
            return pa.Table.from_batches([_batch(out)])

        return write

    rows = texts.mapInArrow(count, ROWS)
    for k in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(step(k), ROWS)
    stats, seen = {k: np.zeros(7, np.int64) for k in range(1, order + 1)}, set()
    for k, shard, *numbers_ in (r["stats"] for r in rows.select("stats").collect()):
        stats[k] += np.array(numbers_)
        seen.add((k, shard, bool(numbers_[5])))
    for k in stats:  # shards without an n-gram, or that were never asked
        for shard in range(dealing.shards):
            full, asked = (k, shard, True) in seen, (k, shard, True) in seen or (k, shard, False) in seen
            for name, there in (("gram", k), ("context", k)) if not full else ():
                write_file(f"{uri}/{name}-{there}-{shard}", [])
            if not asked and k < order:
                write_file(f"{uri}/wide-{k + 1}-{shard}", [])
    return stats


def _summed(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts that differ, their totals, and how many n-grams each has with count 1, 2 and more."""
    if not len(contexts):
        return contexts, *(np.zeros(0, np.int64) for _ in range(4))
    order, first = _groups(contexts)
    counts = counts[order]
    return contexts[order[first]], *(np.add.reduceat(v.astype(np.int64), first) for v in (counts, counts == 1, counts == 2, counts > 2))


def _added(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Partial statistics of contexts added up."""
    held = np.concatenate([np.frombuffer(p, np.int64).reshape(5, -1) for p in parts], axis=1) if parts else np.zeros((5, 0), np.int64)
    if not held.shape[1]:
        return held[0].view(U), *held[1:]
    order, first = _groups(held[0].view(U))
    return held[0].view(U)[order[first]], *(np.add.reduceat(v[order], first) for v in held[1:])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more; a half where a count of counts is zero."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(d if 0 < d < k else 0.5 for k, d in enumerate(found, 1))


def fit(train: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Counts the n-grams of train's texts, up to order words long, into a new folder of the shared one."""
    spark = train.sparkSession
    texts = train.select(F.col(text))
    uri, tasks = work_dir(spark, "kneser-ney"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards = max(tasks, -(-text_bytes(texts, text) // WORDS))
    numbers = _count_words(texts, uri, word_shards)
    if not numbers.tokens:
        return Model(uri, order, word_shards, 1, 0, 0, 0, ((0.5,) * 3,) * order, 0, 1.0)
    shards = max(tasks, -(-numbers.tokens // SHARE))
    # words counted 2 ** (b - 1) times or more, that being a shard's share at most
    least = max(1, (numbers.tokens // shards).bit_length())
    frequent = sum(sum(b[least:]) for b in numbers.bits)
    stats = _count_ngrams(texts, uri, order, numbers, Dealing(shards, frequent, numbers.V))
    found = tuple(discounts(*stats[k][:4].tolist()) for k in range(1, order + 1))
    n1, n2, _, _, n3, _, kinds = stats[1].tolist()
    mass = sum(d * n for d, n in zip(found[0], (n1, n2, n3), strict=True)) / kinds
    return Model(uri, order, word_shards, shards, numbers.V, frequent, numbers.tokens, found, kinds, mass)


# scoring


class Scorer:
    """The model's arrays, mapped by a worker as they are needed."""

    def __init__(self, model: Model):
        self.m, self.open = model, Held(MAPPED)
        self.words = open_words(model.uri, model.word_shards)
        self.dealing = Dealing(model.shards, model.frequent, model.V)

    def _find(self, name: str, shard: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, len(hashes)), np.int64)
        order = np.argsort(shard.astype(np.uint16 if self.m.shards < 2**16 else np.uint32), kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            rows = order[ends[s] : ends[s + 1]]
            table_ = self.open.get((name, s), lambda s=s: Table(map_array(f"{self.m.uri}/{name}-{s}", np.uint8)))
            out[:, rows] = table_.find(hashes[rows], width)
        return out

    def lowest(self, ids: np.ndarray) -> np.ndarray:
        """Probability of each word without context; unknown ones share the mass of one more word."""
        m, keys = self.m, mixed([ids])
        c = self._find("gram-1", self.dealing.shard([ids]), keys, 1)[0]
        return (c - self._discount(1, c)) / m.kinds + m.lower_mass / (m.V + 1)

    def _discount(self, k: int, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.m.discounts[k - 1]])[np.minimum(counts, 3)]

    def raised(self, columns: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """Probability of the last column given the others, from that given one word less; the same after an unknown context."""
        k, context = len(columns), mixed(columns[:-1])
        wide = self.dealing.wide(columns[:-1], len(context))
        c = self._find(f"gram-{k}", self.dealing.shard(columns), mixed(columns), 1)[0]
        home, about = shard_of(context, self.m.shards), np.zeros((4, len(context)), np.int64)
        for name, rows in ((f"context-{k}", np.flatnonzero(~wide)), (f"wide-{k}", np.flatnonzero(wide))):
            about[:, rows] = self._find(name, home[rows], context[rows], 4)
        total = np.maximum(about[0], 1)
        spare = np.where(about[0] > 0, np.array(self.m.discounts[k - 1]) @ about[1:], 1.0)
        return (c - self._discount(k, c)) / total + spare / total * lower

    def score(self, texts: pa.StringArray) -> dict[str, np.ndarray]:
        w = words(texts, LOWER)
        m, n = self.m, len(texts)
        if not m.tokens:
            return {"n_tokens": w.counts + 1, "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n)}
        ids, counts = self.words.find(np.append(word_hashes(w.vocab), U(END)), m.V + 1)
        # the words of the slice and the end, by their places
        place = np.full(int(w.bounds[-1]) + n, len(ids) - 1)
        place[np.arange(len(w.codes)) + w.text_of] = w.codes
        columns, bounds = ngrams_of(w, ids, int(ids[-1]), m.V, m.order)
        p = self.lowest(ids.astype(columns[0].dtype))[place]
        for k in range(2, m.order + 1):
            p = self.raised(columns[m.order - k :], p)
        base = np.log10((counts + 1) / (m.tokens + m.V + 1))
        return {
            "n_tokens": np.diff(bounds),
            "n_known": per_text((counts > 0).astype(np.int64)[place], bounds),
            "base_score": per_text(base[place], bounds, dtype=np.float64),
            "score": per_text(np.log10(p), bounds, dtype=np.float64),
        }


_open: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    if model.uri not in _open:
        _open.clear()
        _open[model.uri] = Scorer(model)
    return _open[model.uri]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, extra columns, n_tokens, n_known, base_score, score (log10 probabilities) and perplexity of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            got = scorer(model).score(texts_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(got["base_score"], pa.float64()), pa.array(got["score"], pa.float64()), pa.array(10 ** (-got["score"] / got["n_tokens"]), pa.float64())], [*batch.schema.names[1:], "n_tokens", "n_known", "base_score", "score", "perplexity"])

    cols = docs.select(F.col(text), F.col(id_col), *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[1:])
    return cols.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def contract(docs: DataFrame, order: int = 3) -> DataFrame:
    """Learns from all documents but those whose id falls in bucket 2 of 7; scores all."""
    rows = docs.select("doc_id", "text", (bucket_crc("doc_id", 7) == 2).alias("held_out"))
    model = fit(rows.where("not held_out"), order=order)
    return score(rows, model, extra=("held_out",)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
