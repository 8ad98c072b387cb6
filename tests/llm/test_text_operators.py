"""Operators on single texts against plain Python, over the small table and over hard cases."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from quadloom.llm import _arrow, bpe, licenses, quality_classifier, quality_rules, text_stats, tokens
from quadloom.llm.queries import queries, vocabulary

SMALL = "/root/testdata/sf0.001"
HARD = ["", " ", "\n\n", "a", "A b\tc\x0bd\x0ce\rf", "no\x1cbreak\x85here\xa0or here", "x " * 3000, "same line\nsame line\n \n \nsame line", "Ünïcödé ÀÉ ß", "😀 中文 ́", "'s 't're 'll've'd x's", "  two  spaces\n\n\nthen 12 345³ ½!?…", "<|endoftext|>", "\x00 zero \x00\x00", "aaaa" * 50, "#*$%&|<>" * 3, "All rights reserved. CC-BY cc by; General  Public\nLicense"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()] + HARD


@pytest.fixture(scope="module")
def hard(spark):
    """Null ids and texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, None, 1, "x", 2.0), (7, None, 1, "x", 2.0), (7, None, 1, "x", 2.0), (8, "", 1, "x", 2.0), *((100 + k, t, 1, "x", 2.0) for k, t in enumerate(HARD)), (100, HARD[0], 1, "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, label string, score double").withColumns({c: F.lit("own") for c in ("__stats", "__s", "__x", "__score", "__S_")})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def stats_of(text):
    w, lines = split(text), text.split("\n")
    covered = set()
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(8)}
    full = [x for x in lines if split(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": len(covered)}


def test_statistics(texts):
    got = text_stats.stats(pa.array(texts))
    for k, t in enumerate(texts):
        assert {n: int(got[n][k]) for n in stats_of(t)} == stats_of(t), t[:50]


def test_statistics_of_no_text():
    assert all(len(v) == 0 for v in text_stats.stats(pa.array([], pa.string())).values())


def test_quality_rules_query(spark):
    df = queries()["op1_quality_rules"](spark, SMALL)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = df.collect()
    assert len(rows) == 200 and all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95


def planted_votes(n=4000, seed=8):
    """Rows of votes by rules of known accuracy on good and bad texts; the last one often calls good texts bad."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.8
    accuracy = [(0.98, 0.9), (0.97, 0.8), (0.99, 0.6), (0.95, 0.85), (0.75, 0.55)]
    said = np.stack([np.where(truth, np.where(rng.random(n) < g, 1, -1), np.where(rng.random(n) < b, -1, 1)) for g, b in accuracy], axis=1)
    said[rng.random(said.shape) < 0.1] = 0
    return truth, accuracy, said


def test_maximisation_by_brute_force():
    """Row by row in plain Python, with the same start and priors."""
    truth, accuracy, said = planted_votes(600)
    good = [0.05 if -1 in row else 0.95 for row in said.tolist()]
    for _ in range(40):
        prior = (sum(good) + 8) / (len(good) + 10)
        right = []
        for j in range(len(accuracy)):
            on = [(row[j], g) for row, g in zip(said.tolist(), good, strict=True) if row[j]]
            a = (sum(g for v, g in on if v == 1) + 9) / (sum(g for _, g in on) + 10)
            b = (sum(1 - g for v, g in on if v == -1) + 1) / (sum(1 - g for _, g in on) + 2)
            if a + b < 1:
                a = (sum(v == 1 for v, _ in on) + 1) / (len(on) + 2)
                b = 1 - a
            right.append((a, b))
        for k, row in enumerate(said.tolist()):
            p, q = prior, 1 - prior
            for v, (a, b) in zip(row, right, strict=True):
                p, q = (p * a, q * (1 - b)) if v == 1 else (p * (1 - a), q * b) if v == -1 else (p, q)
            good[k] = p / (p + q)
    patterns, n = np.unique(said, axis=0, return_counts=True)
    got_prior, got = quality_rules.maximise(patterns, n.astype(float), 40)
    assert got_prior == pytest.approx(prior, abs=1e-9) and np.allclose(got, right, atol=1e-9)


def test_maximisation_finds_planted_accuracies_and_overrules_a_noisy_rule():
    truth, accuracy, said = planted_votes()
    patterns, back, n = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    prior, right = quality_rules.maximise(patterns, n.astype(float))
    assert abs(prior - truth.mean()) < 0.02 and np.abs(right - np.array(accuracy)).max() < 0.06
    lone = (said[:, 4] == -1) & (said[:, :4] == 1).all(axis=1)
    # all-must-pass rejects these, nearly all of them wrongly; the posterior keeps them
    p = np.log(prior / (1 - prior)) + np.where(said == 1, np.log(right[:, 0] / (1 - right[:, 1])), np.where(said == -1, np.log((1 - right[:, 0]) / right[:, 1]), 0)).sum(axis=1)
    assert lone.sum() > 300 and truth[lone].mean() > 0.99 and (p[lone] > 0).all()
    assert ((p > 0) == truth).mean() > 0.97 > ((said != -1).all(axis=1) == truth).mean() + 0.1
    prior, right = quality_rules.maximise(np.zeros((0, 5), int), np.zeros(0))
    assert 0 < prior < 1 and right.shape == (5, 2)


def test_verdicts_by_brute_force(spark, texts):
    """Votes, accuracies and posteriors of the query, from the texts in plain Python."""
    got = {r.doc_id: r for r in queries()["op1_quality_rules"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    stats = text_stats.stats(pa.array([r.text for r in rows]))
    votes = []
    for k in range(len(rows)):
        row = []
        for top, under, low, high, below, above in quality_rules.RULES.values():
            x = stats[top][k] / max(stats[under][k], 1)
            row.append(0 if not stats["n_words"][k] else 1 if low <= x <= high else -1 if x < below or x > above else 0)
        votes.append(row)
    prior, right = quality_rules.maximise(np.array(votes), np.ones(len(votes)))
    for r, row in zip(rows, votes, strict=True):
        p, q = prior, 1 - prior
        for v, (a, b) in zip(row, right.tolist(), strict=True):
            p, q = (p * a, q * (1 - b)) if v == 1 else (p * (1 - a), q * b) if v == -1 else (p, q)
        assert got[r.doc_id].quality == pytest.approx(p / (p + q), abs=1e-6)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and p >= q)


def test_quality_rules_on_hard_rows(spark, hard):
    rows = quality_rules.judge(hard).collect()
    assert len(rows) == hard.count() and all(not r.kept for r in rows if r.n_words < 20)
    kept = quality_rules.keep_good(hard)
    assert kept.columns == hard.columns and {r.text for r in kept.collect()} <= {t for t in HARD if len(split(t)) >= 20}
    assert quality_rules.judge(hard.limit(0)).count() == 0 and quality_rules.keep_good(hard.limit(0)).count() == 0


def test_classifier_on_held_out_documents(spark):
    big = "/root/testdata/sf0.01"
    rows = queries()["op4_quality_classifier"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean([(r.score >= 0.7) == r.quality for r in held]) > 0.93


def test_classifier_by_direct_solution(spark):
    """Features, normal equations and calibration over all labelled rows at once, without Spark."""
    big = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{big}/documents.parquet").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    bucket = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows])
    x, y = quality_classifier.features(pa.array([r.text for r in rows])), np.array([r.quality for r in rows], float)
    train, rest = bucket < 2, bucket == 3
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
    z = quality_classifier.fourier((x - mean) / np.where(scale > 1e-9, scale, 1.0))
    weights = np.linalg.solve(z[train].T @ z[train] + quality_classifier.RIDGE * np.eye(z.shape[1]), z[train].T @ y[train])
    steps = np.round(np.clip(z[rest] @ weights, -1, 2) / quality_classifier.STEP).astype(int)
    # isotonic regression as the largest of smallest means
    kinds = np.unique(steps)
    p, n = np.array([y[rest][steps == k].sum() for k in kinds]), np.array([(steps == k).sum() for k in kinds])
    level = [max(min(p[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, len(kinds))) for a in range(k + 1)) for k in range(len(kinds))]
    blocks = [np.flatnonzero(np.isclose(level, v, atol=1e-12)) for v in np.unique(np.round(level, 12))]
    knots = np.array([-1.0, *((kinds[b] * n[b]).sum() / n[b].sum() * quality_classifier.STEP for b in blocks), 2.0])
    levels = np.array([level[0], *(level[b[0]] for b in blocks), level[-1]])
    want = np.clip(np.interp(z @ weights, knots, 0.999 * levels + 0.001 * (knots + 1) / 3), 0, 1)
    got = {r.doc_id: r.score for r in queries()["op4_quality_classifier"](spark, big).collect()}
    assert np.abs(np.array([got[r.doc_id] for r in rows]) - want).max() < 1e-6


def test_classifier_on_hard_rows(spark, hard):
    labels = spark.createDataFrame([(None, 1), (7, None), (100, 1), (101, 0), (102, 1), (102, 1), (999, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(hard, labels).count() == hard.count()
    none = quality_classifier.classify(hard, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == hard.count()
    assert quality_classifier.keep_good(hard, labels, cutoff=0.0).columns == hard.columns
    assert quality_classifier.keep_good(hard, labels, cutoff=0.0).count() == hard.count()
    assert quality_classifier.classify(hard.limit(0), labels).count() == 0


def test_isotonic_pools_violators():
    x, y = quality_classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 3, 2]), np.array([2.0, 2, 4, 2]))
    assert list(y) == sorted(y) and np.allclose(y, [0.25, 0.75, 1.0])


def test_library_ids(texts):
    from tokenizers import Tokenizer

    path, end = vocabulary("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [*texts, f"{end}at the head", f"in {end} the\n{end}{end} middle", f"at the end {end}", f"nearly <|endoftext |> {end[:-1]}", f"é{end}\x00 {end} "]
    whole = Tokenizer.from_file(path)
    for special in (True, False):
        whole.encode_special_tokens = not special
        got = tokens.encode(pa.array(texts), path, special)
        for k, e in enumerate(whole.encode_batch(texts, add_special_tokens=False)):
            assert got.ids[got.bounds[k] : got.bounds[k + 1]].tolist() == e.ids, texts[k][:50]
    assert len(tokens.encode(pa.array([], pa.string()), path).ids) == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_merge_replay(texts, name):
    import base64

    import public_tokenizers

    path = vocabulary(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(pa.array(texts), bpe.load(path))
    bounds, data = bpe.decode(got, bpe.load(path))
    for k, t in enumerate(texts):
        assert got.ids[got.bounds[k] : got.bounds[k + 1]].tolist() == plain.encode_ordinary(t), t[:50]
        assert data[bounds[k] : bounds[k + 1]].tobytes() == t.encode()


def test_long_pieces_and_the_corpus_arrays(spark, monkeypatch):
    """Pieces too long for the common replay, hashes that collide, pieces the arrays lack."""
    import base64

    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(4)
    some = ["a" * 200_000, "ab" * 700, "".join(rng.choice(list("abcdefghij"), 3000)), "!?" * 900, "word " * 50, "日本語" * 400, *HARD]
    for length in (512, 8):
        monkeypatch.setattr(bpe, "LONG", length)
        got = bpe.encode(pa.array(some), bpe.load(path))
        assert [x.tolist() for x in np.split(got.ids, got.bounds[1:-1])] == [plain.encode_ordinary(t) for t in some]
    monkeypatch.setattr(bpe, "SHARD", 500)
    monkeypatch.setattr(bpe, "MAPPED", 2)
    uri, shards = bpe.learn(spark.createDataFrame([(t,) for t in some[2:]], "text string"), path)
    assert shards > 20
    corpus = bpe.Known(uri, shards, path)
    monkeypatch.setattr(bpe, "replayed", lambda vocab, ranks, whole=bpe.replayed: whole(vocab, ranks) if len(vocab) < 9 else pytest.fail("most pieces are known"))
    for _ in range(2):
        got = corpus.encode(pa.array([*some, "zzqx new"]))
        assert [x.tolist() for x in np.split(got.ids, got.bounds[1:-1])] == [plain.encode_ordinary(t) for t in [*some, "zzqx new"]]
        monkeypatch.undo()
        assert len(corpus.open.held) == 2

        def other(s, shard=corpus.shard):  # other pieces of the same hash and length
            hashes, ends, letters, ids = shard(s)
            letters = np.array(letters)
            letters[::40] ^= 1
            return hashes, ends, letters, ids

        corpus.shard = other


def test_bpe_query_on_hard_rows(spark, hard):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = bpe.digests(hard, path).collect()
    empty = [r for r in rows if r.n_tokens == 0]
    assert len(rows) == hard.count() and len(empty) == 6 and len({r.ids_sha256 for r in empty}) == 1
    assert bpe.digests(hard.limit(0), path).count() == 0 and bpe.token_ids(hard, path).columns == [*hard.columns, "token_ids"]


def test_license_places(texts):
    got = licenses.scan(pa.array(texts))
    for k, t in enumerate(texts):
        w = licenses.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = [i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (got["n_words"][k], got["n_base"][k], got["first_word"][k], got["last_word"][k]) == (len(w), len(at), min(at, default=None), max(at, default=None))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-notice"), ("x licensed UNDER the apache license y", "apache-notice"), ("Released under the MIT License.", "mit-notice"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice"),
        ("Licensed under CC BY-NC 4.0.", "cc-notice"), ("Copyright (c) 2020 Ada & Sons. All Rights\nReserved", "reserved-notice"), ("SPDX-License-Identifier: MIT", "spdx-notice"),
        ("this program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-grant"),
        ("licensed under an apache license", None), ("released under the mit-style license", None), ("all rights were reserved", None),
    ],
)
def test_templates(text, label):
    got = licenses.scan(pa.array([text]))
    assert (label in got["labels"][0].split(",")) if label else got["labels"][0] == ""
    assert got["score"][0] == (licenses.SCORES[label.rsplit("-", 1)[1]] if label else 0.0)


def pattern_of(template):
    """The template as a regular expression over words that each have a space behind them."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\w+", template):
        out += "(?:" if part == "[[" else ")?" if part == "]]" else rf"(?:\S+ ){{0,{part[2:-2]}}}" if part.startswith("{{") else f"{part} "
    return re.compile(rf"(?<!\S){out}")


def test_templates_by_brute_force():
    """Whole texts with their optional and replaceable regions filled in all manners, cut, and changed in one word."""
    rng = np.random.default_rng(6)

    def spelt(template):
        out, skip = [], 0
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\w+", template):
            if part == "[[":
                skip += skip > 0 or rng.random() < 0.4
            elif part == "]]":
                skip = max(0, skip - 1)
            elif not skip:
                out += [f"Any{k}" for k in range(rng.integers(0, int(part[2:-2]) + 2))] if part.startswith("{{") else [part]
        return out

    some = []
    for template in licenses.TEMPLATES.values():
        for _ in range(12):
            w = spelt(template)
            some.append(["Before", "this", *w, "after"])
            change = list(w)
            change[rng.integers(len(w))] = "changed"
            some += [change, w[: rng.integers(1, len(w) + 1)], w[rng.integers(len(w)) :], [*w[: len(w) // 2], *w]]
    texts = ["".join(x.capitalize() + str(rng.choice([" ", ", ", "\n", " - "])) for x in w) for w in some]
    got = licenses.scan(pa.array(texts))
    full = 0
    for k, w in enumerate(some):
        line = "".join(x.lower() + " " for x in w)
        want = {label for label, t in licenses.TEMPLATES.items() if pattern_of(t).search(line)}
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {line}"}
        assert got["labels"][k] == ",".join(sorted(want | base)) and got["base_labels"][k] == ",".join(sorted(base)), texts[k]
        full += any(x.endswith("-text") for x in want)
    assert 50 < full < len(some)


def test_a_notice_many_times_over_is_read_once():
    text = "Licensed under the Apache License, Version 2.0 (the License); you may not. " * 20_000
    got = licenses.scan(pa.array([text]))
    assert got["labels"] == ["apache-notice"]


def test_licenses_on_hard_rows(spark, hard):
    rows = licenses.scan_licenses(hard).collect()
    assert len(rows) == hard.count() and all((r.first_word is None) == (r.n_base == 0) for r in rows)
    assert licenses.scan_licenses(hard.limit(0)).count() == 0
    assert queries()["op8_license_scan"](spark, SMALL).count() == 200


def test_slices_keep_order_and_bound_size():
    batch = pa.RecordBatch.from_pydict({"i": list(range(100)), "t": ["x" * (k * 7 % 50) for k in range(99)] + [None]})
    parts = list(_arrow.slices(iter([batch]), 1, 100))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 10
    assert list(_arrow.slices(iter([batch.slice(0, 0)]), 1)) == []


def test_llm_stands_alone():
    import pathlib

    root = pathlib.Path(_arrow.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "quadloom.llm" in p.read_text()]
