"""Operators over the corpus against brute force and exact round trips."""

import base64
import functools
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quadloom.llm import _shared, components, kneser_ney, media, packing, quality_classifier, quality_rules, simhash, token_store, tokens, warc
from quadloom.llm._arrow import with_struct
from quadloom.llm.queries import oracle_sql, queries, vocabulary

SMALL = "/root/testdata/sf0.001"
PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def hard(spark):
    """Null ids and texts, repeated rows, ties, and columns whose names the operators use themselves."""
    rows = [(None, None, 1, "x"), (None, "a b c d e", 1, "x"), (7, None, 1, "x"), (7, None, 1, "x"), (8, "", 1, "y"), (9, "a b c d e", 1, "z"), (9, "a b c d e", 1, "z"), (9, "wholly different words stand here", 1, "z"), (10, "A  B\nC d E", 1, "z"), (11, "x " * 20_000, 1, "z")]
    own = ["n", "node", "part", "root", "ids", "__stats", "__s", "__x", "__key", "__gone", "__id", "__score", "__other_id", "__GONE_"]
    return spark.createDataFrame(rows, "doc_id long, text string, print int, start string").withColumns({c: F.lit("own") for c in own})


def words(text):
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


# near duplicates


def fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in nodes}


def test_simhash_query(spark, texts):
    got = {r.doc_id: r for r in queries()["op3_simhash_dedup"](spark, SMALL).collect()}
    prints = {d: fingerprint(t) for d, t in texts.items()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints and all(len(r.fingerprint) == 16 for r in got.values())
    ids = sorted(texts)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {d: r.component_id for d, r in got.items()} == grouped(near, ids)


def test_tiles_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for s in seeds for _ in range(12)}
    prints = sorted(p & ((1 << 64) - 1) for p in prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    want = grouped([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3], signed)
    for tile in (4096, 3):  # one piece for each tile, and many
        monkeypatch.setattr(simhash, "TILE", tile)
        found = [tuple(r) for r in simhash.links(df).collect()]
        assert grouped(found, signed) == want
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert all(roots.get(p, p) == want[p] for p in signed)


def test_forest_is_small():
    a = np.array([1 << k for k in range(60)] + [0], np.uint64)
    assert len(simhash.forest(a, a, 3, True)) == 60


def test_simhash_on_hard_rows(spark, hard):
    rows = simhash.contract(hard).collect()
    assert len(rows) == hard.count()
    by_print = {r.fingerprint: r.component_id for r in rows}
    assert by_print["0" * 16] == 7 and by_print[f"{fingerprint('a b c d e'):016x}"] == 9
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id, r.text and r.text[:5]) for r in kept.collect()) == [(7, None), (9, "a b c"), (9, "wholl"), (11, "x x x")]
    assert sorted((r.doc_id, r.text and r.text[:5]) for r in simhash.keep_one(hard, radius=12, least=0.8).collect()) == [(7, None), (9, "a b c"), (9, "wholl"), (11, "x x x")]
    assert simhash.contract(hard.limit(0)).count() == 0 and simhash.keep_one(hard.limit(0), radius=12, least=0.8).count() == 0 and simhash.keep_one(hard.limit(0)).count() == 0


def test_keep_one_by_similarity(spark, docs, texts):
    """Exact similarity decides within the radius; a radius of 64 compares all pairs."""
    sets = {d: {tuple(words(t)[i : i + 5]) for i in range(max(len(words(t)) - 4, 1))} for d, t in texts.items() if words(t)}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for radius in (12, 64):
        near = [(a, b) for a, b in pairs if (fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count() <= radius]
        kept = {r.doc_id for r in simhash.keep_one(docs, radius=radius, least=0.8).select("doc_id").collect()}
        assert kept == {d for d, root in grouped(near, sorted(texts)).items() if d == root}
    assert len(near) == len(pairs) > 3


def test_sets_of_one_fingerprint_are_all_compared(spark, monkeypatch):
    """1-2 and 2-3 are similar, 1-3 are not; whichever two share a fingerprint, all three are one group, and 4 stays apart."""
    word = [f"w{k}" for k in range(400)]
    rows = {1: word[:300], 2: word[20:320], 3: word[40:340], 4: word[200:]}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id long, text string")
    for shared in ((1, 2), (2, 3), (1, 3), (1, 2, 3, 4)):
        firsts = {rows[d][0]: 5 for d in shared}
        monkeypatch.setattr(simhash, "fingerprints", lambda texts, size=3, firsts=firsts: np.array([firsts.get(t.split()[0], 6) for t in texts.to_pylist()], np.uint64))
        for parts in (1, 4):
            assert {r.doc_id for r in simhash.keep_one(df.repartition(parts), radius=12, least=0.8).collect()} == {1, 4}


def test_similar_texts_beyond_the_radius(spark, monkeypatch):
    """All pairs of 0.8 or more, whatever the edit moves in the fingerprint; many shingles are common, some groups are cut into pieces."""
    rng = random.Random(5)
    line = " ".join(f"common{k}" for k in range(30))
    rows = []
    for base in range(12):
        words_ = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(100, 500))]
        phrase = " ".join(words_[20:28])
        scattered = list(words_)
        for _ in range(3):
            scattered[rng.randrange(len(words_))] = "new"
        copies = [words_, [*words_[:50], *[phrase] * 20, *words_[50:]], words_[: int(len(words_) * 0.83)], words_[: int(len(words_) * 0.7)], scattered, [*words_, "tail"]]
        rows += [(10 * base + k, f"{line} " * (base % 2) + " ".join(c)) for k, c in enumerate(copies)]
    sets = {d: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    far = [(a, b) for a, b in pairs if (fingerprint(dict(rows)[a]) ^ fingerprint(dict(rows)[b])).bit_count() > corpus_pipeline.RADIUS]
    assert len(far) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d for d, root in grouped(pairs, sorted(sets)).items() if d == root}
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, df, "").collect()} == want
    monkeypatch.setattr(simhash, "TILE", 3)
    assert {r.doc_id for r in simhash.keep_one(df, radius=0, least=0.8, rest=True).collect()} == want


def test_shingles_of_all_sets_are_counted(spark):
    """Sets in 300 of 350 files, of which every second was left out; a set that is there twice counts once, and large counts keep their order."""
    df = spark.range(0, 700, 1, 350).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 9), k -> concat('w', id % 600, '.', k))) as text")
    folder = _shared.work_dir(spark, "sets")
    rows = _shared.cut(simhash.with_sets(df, folder))
    members = _shared.cut(rows.groupBy("node").agg(F.min(F.struct("part", "at", "n")).alias("x")).select("node", F.col("node").alias("root"), "x.*"))
    assert members.select("part").distinct().count() == 300
    made = np.concatenate([simhash.shingle_sets(pa.array([" ".join(f"w{d}.{k}" for k in range(10))]))[1] for d in range(600)])
    want = np.bincount(made >> np.uint32(32 - simhash.COUNT_BITS), minlength=1 << simhash.COUNT_BITS)
    uri = simhash._count_shingles(members, folder)
    assert simhash._counts(uri).tolist() == want.tolist() and want.sum() == 3600
    width = len(want) // simhash.COUNT_FILES
    _shared.write_file(f"{uri}/0", [np.where(np.arange(width) < 2, [(6 << 32) - k for k in range(width)], want[:width]).astype(np.int64)])
    assert simhash._ranks(uri)[1] + 1 == simhash._ranks(uri)[0] == simhash._ranks(uri).max()


def test_prefixes_are_made_by_all_tasks(spark, tmp_path, monkeypatch):
    """Members lie in one partition, as small tables do; a task that took them all aggregated the shingles of all."""
    df = spark.range(0, 400, 1, 2).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 9), k -> concat('w', id, '.', k))) as text")
    folder, log, real = _shared.work_dir(spark, "sets"), str(tmp_path), simhash.prefix
    rows = _shared.cut(simhash.with_sets(df, folder))
    members = _shared.cut(rows.select("node", F.col("node").alias("root"), "part", "at", "n").coalesce(1))

    def logged(*args):
        with open(f"{log}/{TaskContext.get().partitionId()}", "a") as file:
            file.write("x")
        return real(*args)

    monkeypatch.setattr(simhash, "prefix", logged)
    assert simhash.rare_links(members, folder).count() == 0
    took = [f.stat().st_size for f in tmp_path.iterdir()]
    assert len(took) == 4 and sum(took) == 800 and max(took) < 300


def test_kernels_see_small_slices(spark, monkeypatch):
    """Statistics, features and ids are made of half a MB of text at a time, as workers keep most of what they once took."""
    text, kind = "some words " * 1000, T.StructType([T.StructField("n", T.LongType())])
    df = spark.range(0, 200, 1, 1).select("id", F.lit(text).alias("text"))
    made = with_struct(df, "__s", kind, lambda t: {"n": np.full(len(t), pc.sum(pc.binary_length(t)).as_py())})
    got = [r.n for r in made.select("id", "__s.n").orderBy("id").collect()]
    assert len(got) == 200 and max(got) < (1 << 19) + len(text)
    seen, real = [], tokens.encode
    monkeypatch.setattr(packing.tokens, "encode", lambda t, path: seen.append(pc.sum(pc.binary_length(t)).as_py()) or real(t, path))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([text] * 200)], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(packing._first_level(PATH, packing.WINDOW, packing.OPEN)(iter([batch]))))
    assert sum(seen) == 200 * len(text) and max(seen) < (1 << 19) + len(text)
    assert pc.sum(rows["length"]).as_py() == 200 * len(ids_of([text])[0])


def test_fit_runs_in_one_worker_a_task(spark, docs, monkeypatch):
    """Labelled ids are looked up where features are made; a filter by a function of its own would be a second Python process for each task."""
    plans, fit = [], quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, *rest: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, *rest))
    assert quality_classifier.keep_good(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).count()
    assert len(plans) == 1 and len(re.findall(r"MapInArrow|EvalPython", plans[0])) == 1


def test_vocabulary_is_loaded_once(monkeypatch):
    """Packing encodes pieces by the model of the tokenizer that it keeps for special tokens, not by a second copy."""
    real, loaded = tokenizers.Tokenizer, []

    class Counted:
        from_file = staticmethod(lambda path: loaded.append(path) or real.from_file(path))

        def __new__(cls, model):
            return real(model)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    for kept in (tokens._model, tokens._whole):
        kept.cache_clear()
    texts = ["some  words, it's 12", "<|endoftext|> and \0 more", ""]
    got = tokens.encode(pa.array(texts), PATH)
    assert loaded == [PATH] and [x.tolist() for x in np.split(got.ids, got.bounds[1:-1])] == [real.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts]


def test_class_table_is_made_in_parts():
    tracemalloc.start()
    got = tokens.classes.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    for code in [*range(0x3000), *range(0xD7F0, 0xE010), *range(0x10FFF0, 0x110000), *range(0x1000, 0x110000, 997)]:
        kinds = [k for k, p in ((tokens.LETTER, r"\p{L}"), (tokens.NUMBER, r"\p{N}"), (tokens.SPACE, r"\p{White_Space}")) if regex.match(p, chr(code))]
        assert [got[code]] == (kinds or [tokens.OTHER])


def test_keep_one_by_unique_ids(spark, docs):
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert kept == {r.component_id for r in simhash.contract(docs).collect()}


# language model


def brute_force(corpus, order):
    """p(tuple of context, word) of the model, and the words' counts."""
    level = {order: Counter()}
    for seq in corpus:
        padded = [None] * (order - 1) + seq
        level[order].update(tuple(padded[i : i + order]) for i in range(len(seq)))
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    of = {k: kneser_ney.discounts(*(Counter(c.values())[j] for j in (1, 2, 3, 4))) for k, c in level.items()}
    total, spare = defaultdict(int), defaultdict(float)
    for k, c in level.items():
        for g, n in c.items():
            total[g[:-1]] += n
            spare[g[:-1]] += of[k][min(n, 3) - 1]
    size = len(level[1])

    @functools.cache
    def p(g):
        k, context = len(g), g[:-1]
        lower = p(g[1:]) if k > 1 else 1 / (size + 1)
        if not total[context]:
            return lower
        n = level[k][g]
        return ((n - of[k][min(n, 3) - 1] if n else 0) + spare[context] * lower) / total[context]

    return p


@pytest.mark.parametrize(("order", "share"), [(1, 10**9), (2, 500), (3, 10**9), (3, 500), (4, 3000)])
def test_kneser_ney_by_brute_force(spark, docs, texts, monkeypatch, order, share):
    """Few shards and many; with many, contexts of frequent words are dealt over all of them."""
    monkeypatch.setattr(kneser_ney, "SHARE", share)
    monkeypatch.setattr(kneser_ney, "HELD", 10_000)
    if share == 500:
        monkeypatch.setattr(kneser_ney, "WORDS", 20_000)
        monkeypatch.setattr(kneser_ney, "MAPPED", 3)
    got = {r.doc_id: r for r in kneser_ney.contract(docs, order).collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    tokens = {d: [*words(t), b""] for d, t in texts.items()}
    one = Counter(w for d in texts if d not in held for w in tokens[d])
    total, size = sum(one.values()), len(one)
    p = brute_force([tokens[d] for d in texts if d not in held], order)
    assert sum(p((*[None] * (order - 1), w)) for w in one) + p((*[None] * (order - 1), b"?")) == pytest.approx(1)
    for d, seq in tokens.items():
        r, padded = got[d], [None] * (order - 1) + seq
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(seq), sum(one[w] > 0 for w in seq), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (total + size + 1)) for w in seq))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(seq))))
    if order > 1:
        assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_kneser_ney_query(spark, docs, texts):
    got = queries()["op2_kneser_ney"](spark, SMALL)
    assert sorted(got.collect()) == sorted(kneser_ney.contract(docs).drop("perplexity").select(got.columns).collect())


def test_kneser_ney_on_hard_rows(spark, hard):
    rows = kneser_ney.contract(hard).collect()
    assert len(rows) == hard.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    nothing = kneser_ney.score(hard, kneser_ney.fit(hard.limit(0))).collect()
    assert len(nothing) == hard.count() and {r.score for r in nothing} == {0.0}
    assert kneser_ney.score(hard.limit(0), kneser_ney.fit(hard)).count() == 0


def test_ngrams_that_share_a_hash_stay_apart(monkeypatch):
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 6, 2000).astype(np.uint32) for _ in range(3)]
    counts = rng.integers(1, 9, 2000)
    want = Counter()
    for *row, c in zip(*columns, counts.tolist(), strict=True):
        want[tuple(row)] += c
    for bits in (64, 5, 0):
        monkeypatch.setattr(kneser_ney, "mixed", lambda columns, bits=bits, whole=kneser_ney.mixed: whole(columns) >> np.uint64(64 - bits) if bits else np.zeros(len(columns[0]), np.uint64))
        got, n = kneser_ney.merged(columns, counts)
        assert dict(zip(zip(*(c.tolist() for c in got), strict=True), n.tolist(), strict=True)) == want and len(n) == len(want)
        monkeypatch.undo()


def test_count_blocks_round_trip():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 5, 3000).astype(np.uint64), rng.integers(0, 1 << 40, 3000).astype(np.uint64), rng.integers(0, 9, 3000).astype(np.uint64)]
    counts = rng.integers(1, 500, 3000)
    got, n = kneser_ney.unpacked(kneser_ney.packed(columns, counts))
    assert sorted(zip(*got, n, strict=True)) == sorted(zip(*columns, counts, strict=True))
    assert len(kneser_ney.unpacked(kneser_ney.packed([np.zeros(0, np.uint64)], np.zeros(0, np.int64)))[1]) == 0


def test_tables_find_what_they_hold():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    values = rng.integers(1, 1000, (2, 5000))
    held = kneser_ney.Table(np.frombuffer(b"".join(kneser_ney.table(keys, *values)), np.uint8))
    assert (held.find(keys, 2) == values).all() and not held.find(rng.integers(0, 1 << 63, 5000).astype(np.uint64), 2).any()
    assert not kneser_ney.Table(np.zeros(0, np.uint8)).find(keys, 2).any()


# packing


def ids_of(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 0], "<u4") for e in whole.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, wanted):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) and sum(r.length for r in rows) == sum(len(i) for _, i in wanted)
    return padding / (1024 * len(places))


def test_special_tokens_as_the_library_treats_them(spark):
    end = "<|endoftext|>"
    rows = [(1, f"{end} a head"), (2, f"in {end}{end} the middle"), (3, f"the end {end}"), (4, "none"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    wanted = ids_of([t or "" for _, t in rows])
    assert sum(50256 in x for x in wanted) == 3
    stored = token_store.read(spark, token_store.write(df, PATH)).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in stored] == [x.tolist() for x in wanted]
    packed = packing.pack(df, PATH).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in packed} == {(r.doc_id, r.start, zlib.crc32(wanted[r.doc_id - 1][r.start : r.start + r.length].tobytes())) for r in packed}
    assert sum(r.length for r in packed) == sum(map(len, wanted))


def test_packing_query(spark, texts):
    rows = queries()["op9_packing"](spark, SMALL).collect()
    ids = dict(zip(texts, ids_of(list(texts.values())), strict=True))
    assert check_packing(rows, ids.items()) < 0.02
    for d, whole in ids.items():
        parts = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()] and parts[-1].start + parts[-1].length == len(whole)
        assert all(r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in parts)


def test_packing_merges_leftovers_over_levels(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    rows = packing.pack(docs.repartition(7), PATH).collect()
    assert check_packing(rows, [(0, np.zeros(sum(r.length for r in rows)))]) < 0.02


def test_packing_on_hard_rows(spark, hard):
    rows = packing.pack(hard, PATH).collect()
    check_packing(rows, list(enumerate(ids_of([r.text or "" for r in hard.collect()]))))
    assert packing.pack(hard.limit(0), PATH).count() == 0


# token store


def test_token_store_query(spark, texts):
    rows = sorted(queries()["op7_token_store"](spark, SMALL).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (d, ids) in zip(rows, sorted(zip(texts, ids_of(list(texts.values())), strict=True)), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_store_keeps_a_chunk_once_and_notices_damage(spark, docs):
    twice = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)).repartition(5)
    stored = lambda uri: sum(os.path.getsize(f"{uri[7:]}/{f}") for f in os.listdir(uri[7:]) if f.startswith("pack-"))
    one, two = token_store.write(docs, PATH), token_store.write(twice, PATH)
    assert stored(two) < 1.05 * stored(one) and not [f for f in os.listdir(two[7:]) if f.startswith("draft-")]
    assert token_store.read(spark, two).count() == 2 * docs.count()
    pack = next(f for f in sorted(os.listdir(two[7:])) if f.startswith("pack-") and os.path.getsize(f"{two[7:]}/{f}") > 4000)
    with open(f"{two[7:]}/{pack}", "r+b") as file:
        file.seek(1000)
        file.write(b"\xff\xfe\xfd")
    with pytest.raises(Exception, match="differs from its digest"):
        token_store.read(spark, two).count()


def test_token_store_on_hard_rows(spark, hard):
    rows = token_store.read(spark, token_store.write(hard, PATH)).collect()
    want = Counter((r.doc_id, zlib.crc32(i.tobytes())) for r, i in zip(hard.collect(), ids_of([r.text or "" for r in hard.collect()]), strict=True))
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want and rows[0].doc_id is None
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert token_store.read(spark, token_store.write(hard.limit(0), PATH)).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(5)
    body = rng.integers(0, 50_000, 20_000)
    cut = lambda ids: {ids[a:b].tobytes() for a, b in zip([0, *token_store.chunk_ends(ids, np.array([0, len(ids)]))], token_store.chunk_ends(ids, np.array([0, len(ids)])), strict=False)}
    a, b = cut(body), cut(np.concatenate([rng.integers(0, 50_000, 777), body]))
    assert len(a & b) > 0.8 * len(a)


# media


def samples_of(picture):
    """Size and rows of an 8-bit gray picture without filters, by the format's own description."""
    assert picture[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(picture):
        size = int.from_bytes(picture[at : at + 4], "big")
        chunks.append((picture[at + 4 : at + 8], picture[at + 8 : at + 8 + size]))
        assert int.from_bytes(picture[at + 8 + size : at + 12 + size], "big") == zlib.crc32(picture[at + 4 : at + 8 + size])
        at += 12 + size
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    width, height = (int.from_bytes(chunks[0][1][k : k + 4], "big") for k in (0, 4))
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])  # depth, gray, deflate, filters, no interlace
    raw = zlib.decompress(chunks[1][1])
    rows = [raw[k : k + width + 1] for k in range(0, len(raw), width + 1)]
    assert len(rows) == height and all(r[0] == 0 for r in rows)
    return b"".join(r[1:] for r in rows)


def feature_of(payload):
    n, mean = len(payload), sum(payload) / len(payload)
    spread = math.sqrt(sum((b - mean) ** 2 for b in payload) / n)
    steps = Counter(b // 32 for b in payload)
    return sum(payload) * 1000 // n, spread * 1000, [steps[k] for k in range(8)]


def test_media_query(spark, docs, texts):
    uri = _shared.work_dir(spark, "media-test")
    media.write_archives(docs.select("doc_id", "text"), uri).collect()
    spark.dataSource.register(media.ArchiveSource)
    stored = {hashlib.sha256(r.media).hexdigest(): r.media for r in spark.read.format("quadloom_archive").load(uri).collect()}
    rows = queries()["op6_media_columns"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
        picture = stored[r.media_sha256]
        assert r.media_bytes == len(picture) and samples_of(picture) == payload
        mean, spread, steps = feature_of(payload)
        got = dict(x.split("=") for x in r.feature.split(";"))
        assert int(got["mean"]) == mean and abs(int(got["dev"]) - spread) < 1 and list(map(int, got["hist"].split(","))) == steps


def test_media_ranges_retries_and_damage(spark, docs):
    uri = _shared.work_dir(spark, "media-test")
    media.write_archives(docs.select("doc_id", "text").coalesce(1), uri).collect()
    spark.dataSource.register(media.ArchiveSource)
    read = lambda: spark.read.format("quadloom_archive").option("rangeBytes", 20_000).load(uri)
    assert read().count() == read().select("offset").distinct().count() == 200
    path = f"{uri[7:]}/{next(f for f in os.listdir(uri[7:]) if f.endswith('.tar'))}"
    offsets = [r.offset for r in read().orderBy("offset").collect()]
    assert offsets == np.fromfile(path + media.INDEX, np.int64).tolist()
    store, place = _shared.open_fs(f"file://{path}")
    for start in (1, 20_000, offsets[-1], offsets[-1] + 1, 1 << 40):
        begin = media._begin(store, place, start)
        assert begin == max(o for o in offsets if o < start)
    with open(path, "r+b") as file:
        file.seek(offsets[3])
        file.write(b"\x07" * 300)  # a header
        file.seek(offsets[50] + 600)
        file.write(b"\x07" * 20)  # a member
    for indexed in (True, False):
        if not indexed:
            os.rename(path + media.INDEX, path + ".old")
        rows = read().collect()
        assert sum(r.error is None for r in rows) == 198 and sorted(r.offset for r in rows if r.error) == [offsets[3], offsets[50]]
    assert sum(r.error is None for r in media.read_features(spark, uri).collect()) == 198


def test_media_reads_again(monkeypatch):
    class Flaky:
        opened = 0

        def open_input_file(self, path):
            Flaky.opened += 1
            if Flaky.opened < 3:
                raise OSError("gone")
            return pa.BufferReader(b"0123456789")

    import tarfile

    info = tarfile.TarInfo("x")
    info.size = 4
    broken = type("Broken", (), {"read_at": lambda self, n, at: b"short"})()
    assert media._media(Flaky(), "p", 2, info, broken) == (None, "gone") and Flaky.opened == 2
    assert media._media(Flaky(), "p", 2, info, broken) == (b"2345", None) and Flaky.opened == 3


def test_media_on_hard_rows(spark, hard):
    rows = media.store_and_read(hard).collect()
    assert len(rows) == hard.count() and sum(r.doc_id is None for r in rows) == 2 and len({r.media_sha256 for r in rows if r.n_bytes == 0}) == 1
    assert media.store_and_read(hard.limit(0)).count() == 0


# WARC


def test_warc_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    df = queries()["op10_warc"](spark, SMALL)
    found = con.sql(oracle_sql()["op10_warc"])
    assert df.columns == found.columns and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))


def test_warc_reads_only_the_attempts_that_counted(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"page {k}") for k in range(20)], "page_id long, url string, html string")
    rows = warc.decisions(pages).select("page_id", "url", "html", "__sha1", "__bytes", "__first")
    uri = _shared.work_dir(spark, "warc-test")
    warc.write_archives(rows.where("page_id < 7"), uri).collect()  # an attempt that was lost
    warc.list_archives(warc.write_archives(rows.coalesce(3), uri), uri)
    assert sorted(r.page_id for r in warc.pages_of(warc.read_archives(spark, uri)).collect()) == list(range(20))


def test_warc_revisits_and_hard_rows(spark):
    rows = [(None, "u", "same", 1), (3, "u", "same", 1), (5, None, "same", 1), (5, "u", "same", 1), (6, "u\r\nX: y", None, 1), (7, "u", "", 1), (8, "u", "<p>é</p>" * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, __first int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.store_and_read(pages).collect()), key=repr)
    assert got == sorted([(None, "revisit", 5, 4), (3, "revisit", 5, 4), (5, "response", None, 4), (5, "response", None, 4), (6, "revisit", 7, 0), (7, "response", None, 0), (8, "response", None, 450_000)], key=repr)
    assert {r.record_type for r in warc.store_and_read(pages, least=5).collect()} == {"response"}
    assert warc.store_and_read(pages.limit(0)).count() == 0


def _archive(n=30, gzip=True):
    parts = []
    for k in range(n):
        raw = warc.record(k, "http://x", f"page {k} " + str(random.Random(k).random()) * 200, "00" * 20, 5, None)
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        parts.append(c.compress(raw) + c.flush() if gzip else raw)
    return parts


def test_warc_keeps_pages_with_odd_urls(spark):
    urls = ["http://x/" + "a" * 200_000, "http://x/\x00\x08\x0e\x1f\x7f", "http://x/\t\r\n\r\ny", "http://x/é%20"]
    pages = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.store_and_read(pages).collect()) == [0, 1, 2, 3]
    for k, u in enumerate(urls):
        raw = warc.record(k, u, "page", "00" * 20, 4, None) * 2
        found = list(warc.walk(lambda at, n, raw=raw: raw[at : at + n], len(raw)))
        assert [r.headers["warc-record-id"] for r in found] == [f"<urn:page:{k}>"] * 2
    assert found[0].headers["warc-target-uri"] == urls[3]


def test_warc_reads_long_records():
    raw = warc.record(1, "u", "x" * (257 << 20), "00" * 20, 257 << 20, None)
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    for data in (raw, c.compress(raw) + c.flush()):
        assert [type(x) for x in warc.walk(lambda at, n, data=data: data[at : at + n], len(data))] == [warc.Record]


def test_warc_fails_on_its_own_gaps(spark, tmp_path):
    (tmp_path / "0.warc").write_bytes(b"".join(_archive(3, gzip=False)) + b"junk")
    archives = warc.read_archives(spark, f"file://{tmp_path}")
    assert warc.pages_of(archives).count() == 3
    with pytest.raises(Exception, match="gap in 0.warc"):
        warc.pages_of(archives, whole=True).collect()


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage_recovers_everything_outside_the_damage(gzip):
    parts = _archive(gzip=gzip)
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    data = bytearray(b"".join(parts))
    data[starts[3] + 40 : starts[3] + 90] = b"\x00" * 50
    data[starts[10] : starts[10] + 4] = b"junk"
    data[starts[20] + (len(parts[20]) - 30) : starts[20] + len(parts[20]) - 20] = b"0123456789"
    data = data[: starts[29] + 60]
    found = list(warc.walk(lambda at, n: bytes(data[at : at + n]), len(data)))
    records = [x for x in found if isinstance(x, warc.Record)]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [r.headers["warc-record-id"] for r in records] == [f"<urn:page:{k}>" for k in range(29) if k not in (3, 10, 20)]
    assert [(g.offset, g.end) for g in gaps] == [(starts[3], starts[4]), (starts[10], starts[11]), (starts[20], starts[21]), (starts[29], len(data))]


def test_salvage_reads_many_records_in_one_member():
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = c.compress(b"".join(_archive(5, gzip=False))) + c.flush()
    assert len(list(warc.walk(lambda at, n: data[at : at + n], len(data)))) == 5
    assert list(warc.walk(lambda at, n: b"", 0)) == []


def squeezed(*parts):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join(c.compress(p) for p in parts) + c.flush()


def salvaged(data):
    found = list(warc.walk(lambda at, n: bytes(data[at : at + n]), len(data)))
    return [x.headers["warc-record-id"][10:-1] for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("piece", [512, warc.PIECE])
def test_salvage_inside_a_member(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    raw, other = _archive(5, gzip=False), squeezed(*_archive(2, gzip=False))
    damaged = raw[1].replace(b"page 1", b"page X")
    ids, gaps = salvaged(squeezed(raw[0], damaged, raw[2]) + other)
    assert ids == ["0", "2", "0", "1"] and len(gaps) == 1 and f"inflated bytes {len(raw[0])} to {len(raw[0]) + len(raw[1])}: block digest differs" == gaps[0].reason
    whole = squeezed(*(r + random.Random(k).randbytes(3000).hex().encode() for k, r in enumerate(raw)))
    ids, gaps = salvaged(squeezed(*raw[:3])[:-12])
    assert ids == ["0", "1"] and [g.reason for g in gaps] == ["gzip member is cut off"]
    ids, gaps = salvaged(whole[: len(whole) // 2] + bytes(200) + other)
    assert ids[:2] == ["0", "1"] and ids[-2:] == ["0", "1"] and len(gaps) == 1
    ids, gaps = salvaged(squeezed(*raw)[:-8] + bytes(8) + other)
    assert ids == ["0", "1", "2", "3", "4", "0", "1"] and "damaged" in gaps[0].reason


@pytest.mark.parametrize("gzip", [True, False])
@pytest.mark.parametrize("length", ["²81", "9" * 5000, "-5", "1e3", ""])
def test_salvage_of_odd_lengths(gzip, length):
    raw = _archive(3, gzip=False)
    raw[1] = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", f"\r\nContent-Length: {length}\r\n\r\nHTTP".encode(), raw[1])
    data = b"".join(map(squeezed, raw)) if gzip else b"".join(raw)
    ids, gaps = salvaged(data)
    assert ids == ["0", "2"] and len(gaps) == 1


def test_salvage_takes_every_spelling_of_a_digest():
    raw = _archive(1, gzip=False)[0]
    digest = re.search(rb"Block-Digest: sha1:(\w+)", raw)[1]
    for spelt in (digest.lower(), base64.b32decode(digest).hex().encode(), base64.b32decode(digest).hex().upper().encode()):
        assert salvaged(raw.replace(digest, spelt))[0] == ["0"]
        assert salvaged(raw.replace(digest, spelt).replace(b"page 0", b"page 1"))[0] == []
    assert salvaged(raw.replace(b"sha1:" + digest, b"SHA1:" + digest))[0] == ["0"] and salvaged(raw.replace(b"sha1:" + digest, b"md5:" + digest))[0] == ["0"]


# pipeline


def test_pipeline(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    stage, before = docs, docs.count()
    for name, run in corpus_pipeline.STAGES[:-1]:
        stage = _shared.cut(run(spark, stage, SMALL))
        assert stage.columns == docs.columns and 0 < stage.count() <= before, name
        before = stage.count()
    ids = [r.doc_id for r in stage.collect()]
    assert len(ids) == len(set(ids)) and np.mean([labels[d] for d in ids if d in labels]) > 0.97
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(ids)


def test_all_labels_are_learnt_from(spark, docs, monkeypatch):
    """450,000 labels, of which some 400,000 were used; and the fit gets each labelled document, whatever the type of ids."""
    many = spark.range(600_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_classifier.taught(many).count() == sum(zlib.crc32(b"%d" % k) % 4 != 2 for k in range(600_000)) > 400_000
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    want, fit, kept = sorted(r.doc_id for r in labels.collect() if zlib.crc32(b"%d" % r.doc_id) % 4 != 2), quality_classifier.fit, []
    fitted = []
    monkeypatch.setattr(quality_classifier, "SAMPLE", 40, raising=False)
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, known, id_col: fitted.append(known.join(rows, known["__id"] == rows[id_col]).select(F.col(id_col).cast("long")).collect()) or fit(rows, known, id_col))
    for of_docs, of_labels in (("long", "long"), ("string", "string"), ("long", "int")):
        got = quality_classifier.keep_good(docs.withColumn("doc_id", F.col("doc_id").cast(of_docs)), labels.withColumn("doc_id", F.col("doc_id").cast(of_labels)))
        kept.append(sorted(int(r.doc_id) for r in got.collect()))
    assert all(sorted(r[0] for r in rows) == want for rows in fitted) and len(fitted) == 3
    assert kept[0] == kept[1] == kept[2]


def check_pieces(rows, whole):
    """Every id of every document (id, ids) lies in exactly one piece, with its checksum; documents that repeat an id are told apart by their lengths."""
    left = Counter({(d, len(i), zlib.crc32(i.tobytes())): 0 for d, i in whole})
    by_document = defaultdict(list)
    for r in rows:
        by_document[r.doc_id, r.doc_tokens].append(r)
    for d, i in whole:
        left[d, len(i), zlib.crc32(i.tobytes())] += 1
    for (d, size, _), times in left.items():
        pieces = Counter((r.start, r.length, r.ids_crc32) for r in by_document[d, size])
        ids = next(i for e, i in whole if e == d and len(i) == size)
        assert sum(length * n for (_, length, _), n in pieces.items()) == size * times
        assert all(crc == zlib.crc32(ids[start : start + length].tobytes()) for start, length, crc in pieces)
    assert sum(r.length for r in rows) == sum(len(i) for _, i in whole)


def test_pipeline_by_brute_force(spark, docs, texts):
    """The verdicts of the two scored stages, every pair of texts compared, and all ids of what is left."""
    good = {r.doc_id for r in quality_classifier.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.score >= 0.7}
    weighed = quality_rules.judge(docs.where(F.col("doc_id").isin(good)))
    kept = sorted(r.doc_id for r in weighed.collect() if r.kept)
    sets = {d: {tuple(words(texts[d])[i : i + 5]) for i in range(max(len(words(texts[d])) - 4, 1))} for d in kept}
    pairs = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    alone = [d for d, root in grouped(pairs, kept).items() if d == root]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(alone) and len(alone) < len(kept) < len(texts)
    whole = list(zip(alone, ids_of([texts[d] for d in alone]), strict=True))
    check_packing(rows, whole)
    check_pieces(rows, whole)


def test_pipeline_stages_on_hard_rows(spark, hard):
    """Null, empty and repeated rows and clashing columns: every stage gives the columns it got, and an empty table stays empty."""
    rich = hard.unionByName(hard.limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit("Plain sentences of some length stand in this text. " * 2 + " ".join(f"Word {k} follows." for k in range(60)))}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rich, SMALL)
        assert got.columns == rich.columns and got.count() <= rich.count(), name
        assert all(r["__stats"] == "own" and r.n == "own" for r in got.collect())
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in corpus_pipeline.deduplicate(spark, rich, SMALL).collect()) == [(7, ""), (9, "a b c"), (9, "wholl"), (11, "x x x"), (50, "Plain")]
    packed = corpus_pipeline.pack(spark, rich, SMALL).collect()
    check_pieces(packed, [(r.doc_id, i) for r, i in zip(rich.collect(), ids_of([r.text or "" for r in rich.collect()]), strict=True)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rich.limit(0), SMALL).count() == 0, name
