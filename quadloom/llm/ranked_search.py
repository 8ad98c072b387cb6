"""Ranked lexical search over a length-stratified index.

A document's length enters its score through a whole number m, its normaliser. Documents of
equal m form a stratum; a stratum of more than BLOCK terms is dealt to several blocks. The
index has a row for each term of a block: the term's frequencies there in falling order, and the
documents of each frequency. So the first frequency bounds what the term can add to any score of
the block, and what a frequency is worth is computed once for all documents that share it.

A search bounds every block for every item, visits the blocks of the highest bounds, takes
the k-th best score found as the item's threshold, and then visits whatever other
blocks are bounded no lower. Ties are kept in both steps, so the result is exact. Items are
answered in blocks of at most PAIRS different terms each, as their weights are held by every
task; documents never pass the driver.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
lower-cased. Null and empty texts have none: such a document counts nowhere, such an item has no
rows. Rows that repeat an id are documents, or items, of their own. Equal scores are ordered
by ascending id, null ids last. An empty table gives no rows. Columns other than the named ones are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm._arrow import ALNUM, slices, texts_of, words
from quadloom.llm._shared import cut, work_dir

#: Terms with repeats in a block at most, but for equal chance in dealing a stratum's documents.
BLOCK = 1 << 19
#: Pairs of item and term whose weights the tasks of a search hold.
PAIRS = 1 << 20
#: Blocks that an item visits before it has a threshold.
FIRST = 4
#: Strata that need more than one block, up to which their sizes are broadcast.
LARGE = 1 << 20

COUNTED = "id long, n long, terms array<string>, tfs array<int>"
POSTINGS = "m long, chunk long, term string, tfs array<int>, ends array<int>, docs array<int>, ids array<long>"


class Index(NamedTuple):
    """postings: rows of the index, and one with a null term and the documents' ids for each block."""

    postings: DataFrame
    n_docs: int


def offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def counted(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, number of terms, distinct terms and their frequencies of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            w = words(texts_of(batch.column(1)), ALNUM)
            width = max(len(w.vocab), 1)
            pairs, times = np.unique(w.text_of * np.int64(width) + w.codes, return_counts=True)
            at = offsets(np.bincount(pairs // width, minlength=batch.num_rows))
            terms = pa.ListArray.from_arrays(at, w.vocab.take(pa.array(pairs % width)))
            tfs = pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts), terms, tfs], ["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(w.counts > 0))

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, COUNTED)


# building


def posted(key: tuple, table: pa.Table) -> pa.Table:
    """The postings of one block."""
    m, chunk = key[0].as_py(), key[1].as_py()
    terms = table.column("terms").combine_chunks()
    flat = terms.flatten().dictionary_encode()
    codes, tfs = flat.indices.to_numpy().astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    docs = np.repeat(np.arange(table.num_rows), terms.value_lengths().to_numpy())
    order = np.argsort(codes * (tfs.max() + 1) + (tfs.max() - tfs), kind="stable")
    codes, tfs, docs = codes[order], tfs[order], docs[order]
    new_term = np.append(True, codes[1:] != codes[:-1])
    run = np.flatnonzero(new_term | np.append(True, tfs[1:] != tfs[:-1]))
    start = np.flatnonzero(new_term)
    per_term, in_term = np.diff(np.append(start, len(codes))), np.diff(np.append(np.searchsorted(run, start), len(run)))
    ends = np.append(run[1:], len(codes)) - np.repeat(start, in_term)
    lists = lambda at, values: pa.ListArray.from_arrays(at, pa.array(values.astype(np.int32)))
    count = len(start) + 1
    nothing = pa.nulls(1, pa.list_(pa.int32()))
    columns = [
        pa.array(np.full(count, m)), pa.array(np.full(count, chunk)),
        pa.concat_arrays([flat.dictionary.take(pa.array(codes[start])), pa.nulls(1, pa.string())]),
        pa.concat_arrays([lists(offsets(in_term), tfs[run]), nothing]), pa.concat_arrays([lists(offsets(in_term), ends), nothing]), pa.concat_arrays([lists(offsets(per_term), docs), nothing]),
        pa.concat_arrays([pa.nulls(len(start), pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets(np.array([table.num_rows])), table.column("id").combine_chunks().cast(pa.int64()))]),
    ]
    return pa.table(columns, ["m", "chunk", "term", "tfs", "ends", "docs", "ids"])


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """The index of all texts, written to the shared folder.

    Documents are dealt to a large stratum's blocks by position, so a length that a third
    of them share is many blocks.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "ranked-search")
    counted(docs, id_col, text).write.parquet(f"{folder}/documents")
    forward = spark.read.parquet(f"{folder}/documents")
    n_docs, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = forward.withColumn("m", F.expr(f"100 - 75 + (75L * n * {n_docs}L) div {max(total, 1)}L"))
    large = placed.groupBy("m").agg(F.sum("n").alias("terms")).where(F.col("terms") > BLOCK).select("m", F.ceil(F.col("terms") / BLOCK).alias("chunks"))
    large = F.broadcast(large) if large.count() <= LARGE else large
    dealt = placed.join(large, "m", "left").withColumn("chunk", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("chunks")), F.lit(0)))
    dealt.select("m", "chunk", "id", "terms", "tfs").groupBy("m", "chunk").applyInArrow(posted, POSTINGS).write.parquet(f"{folder}/postings")
    return Index(spark.read.parquet(f"{folder}/postings"), n_docs)


# searching


class Items(NamedTuple):
    """A block of items: item i weighs codes[bounds[i]:bounds[i+1]] by weights; a code is a place in vocab."""

    ids: list[int | None]
    bounds: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    vocab: list[str]


def item_blocks(queries: DataFrame, id_col: str, text: str, most: int) -> Iterator[Items]:
    """Blocks of at most so many pairs, or one item, read one after another."""

    def block(rows: list) -> Items:
        vocab = sorted({t for r in rows for t in r.terms})
        code = {t: k for k, t in enumerate(vocab)}
        sizes = [len(r.terms) for r in rows]
        codes, times = np.array([code[t] for r in rows for t in r.terms], np.int64), np.array([c for r in rows for c in r.tfs], np.int64)
        return Items([r.id for r in rows], np.concatenate([[0], np.cumsum(sizes)]), codes, times, vocab)

    held, size = [], 0
    for row in cut(counted(queries, id_col, text)).toLocalIterator():
        if held and size + len(row.terms) > most:
            yield block(held)
            held, size = [], 0
        held.append(row)
        size += len(row.terms)
    if held:
        yield block(held)


def impacts(tfs: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)


def visit(hits: DataFrame, asked: DataFrame, items: Items, k: int) -> DataFrame:
    """The k first documents (q, id, score) of every block for each item that asks for it; asked: m, chunk, ids, queries."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "id": [], "score": []}
        if right.num_rows:
            m = right.column("m")[0].as_py()
            ids = right.column("ids").combine_chunks().flatten()
            names = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            row_of = np.full(len(items.vocab), -1)
            row_of[left.column("code").to_numpy()] = np.arange(left.num_rows)
            tfs, ends, docs = (left.column(c).combine_chunks() for c in ("tfs", "ends", "docs"))
            runs, bounds = ends.offsets.to_numpy(), docs.offsets.to_numpy()
            worth, docs = impacts(tfs.flatten().to_numpy().astype(np.int64), m), docs.flatten().to_numpy()
            ends = ends.flatten().to_numpy()
            starts = np.append(0, ends[:-1])
            starts[runs[:-1]] = 0
            worth = np.repeat(worth, ends - starts)  # once per frequency, then for its documents
            for q in right.column("queries").combine_chunks().flatten().to_pylist():
                total = np.zeros(len(names), np.int64)
                for p in range(items.bounds[q], items.bounds[q + 1]):
                    row = row_of[items.codes[p]]
                    if row >= 0:
                        total[docs[bounds[row] : bounds[row + 1]]] += items.weights[p] * worth[bounds[row] : bounds[row + 1]]
                found = np.flatnonzero(total > 0)
                if len(found) > k:
                    found = found[total[found] >= np.partition(total[found], -k)[-k]]
                found = found[np.lexsort((names[found], -total[found]))[:k]]
                out["q"] += [q] * len(found)
                out["id"] += ids.take(pa.array(found)).to_pylist()
                out["score"] += total[found].tolist()
        return pa.table({"q": pa.array(out["q"], pa.int32()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    asked = cut(asked)
    hits = hits.join(asked.select("m", "chunk"), ["m", "chunk"], "left_semi")
    return hits.groupBy("m", "chunk").cogroup(asked.groupBy("m", "chunk")).applyInArrow(score, "q int, id long, score long")


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text: str = "text", most: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores above 0."""
    out = [_search(index, items, k) for items in item_blocks(queries, id_col, text, most)]
    result = out[0] if out else queries.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(index: Index, items: Items, k: int) -> DataFrame:
    spark = index.postings.sparkSession
    vocab = F.broadcast(spark.createDataFrame(list(enumerate(items.vocab)), "code int, term string"))  # PAIRS terms at most
    hits = cut(index.postings.where("term IS NOT NULL").join(vocab, "term").select("m", "chunk", "code", "tfs", "ends", "docs"))
    df = np.zeros(len(items.vocab), np.int64)
    for row in hits.groupBy("code").agg(F.sum(F.size("docs")).alias("df")).collect():
        df[row.code] = row.df
    weight = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
    items = items._replace(weights=items.weights * weight[items.codes])
    numbers = np.repeat(np.arange(len(items.ids)), np.diff(items.bounds))
    by_code = np.argsort(items.codes, kind="stable")
    where = np.searchsorted(items.codes[by_code], np.arange(len(items.vocab) + 1))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, at, highest = [], [], []
            tops = batch.column("tops")
            codes, tfs, ends = tops.flatten().field(0).to_numpy(), tops.flatten().field(1).to_numpy().astype(np.int64), np.cumsum(tops.value_lengths().to_numpy())
            for b, (m, end) in enumerate(zip(batch.column("m").to_pylist(), ends, strict=True)):
                mine = slice(ends[b - 1] if b else 0, end)
                counts = where[codes[mine] + 1] - where[codes[mine]]
                pairs = by_code[np.repeat(where[codes[mine]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
                total = np.zeros(len(items.ids), np.int64)
                np.add.at(total, numbers[pairs], items.weights[pairs] * np.repeat(impacts(tfs[mine], m), counts))
                q = np.flatnonzero(total)
                blocks.append(np.full(len(q), b))
                at.append(q)
                highest.append(total[q])
            place = pa.array(np.concatenate([*blocks, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("m").take(place), batch.column("chunk").take(place), pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*highest, np.zeros(0, np.int64)]).astype(np.int64))], ["m", "chunk", "q", "bound"])

    tops = hits.select("m", "chunk", F.struct("code", F.element_at("tfs", 1).alias("tf")).alias("top")).groupBy("m", "chunk").agg(F.collect_list("top").alias("tops"))
    bounds = cut(tops.mapInArrow(bound, "m long, chunk long, q int, bound long"))
    own = [F.col(c).alias(c) for c in ("m", "chunk", "ids")]  # else they and those of hits are the same columns to Spark
    ids = index.postings.where("term IS NULL").select(own)

    def asked(wanted: DataFrame) -> DataFrame:
        return ids.join(wanted.groupBy("m", "chunk").agg(F.collect_list("q").alias("queries")), ["m", "chunk"])

    order = Window.partitionBy("q").orderBy(F.desc("bound"), "m", "chunk")
    first = cut(bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST).select("m", "chunk", "q"))
    found = cut(_first(visit(hits, asked(first), items, k), k))
    # an item has FIRST blocks and one threshold, and there are at most PAIRS items
    least = F.broadcast(found.where(F.col("rank") == k).select("q", F.col("score").alias("least")))
    rest = bounds.join(F.broadcast(first), ["m", "chunk", "q"], "left_anti").join(least, "q", "left").where("least IS NULL OR bound >= least")
    every = found.drop("rank").unionByName(visit(hits, asked(rest), items, k))
    names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "q int, item_id long"))
    return cut(_first(every, k).join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(build(docs), benchmark)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (SELECT d, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, t GROUP BY term),
items AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
),
s AS (
  SELECT i, any_value(item_id) AS item_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN w USING (term) JOIN tf USING (term) JOIN docs USING (d), t GROUP BY i, d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN docs USING (d) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""
