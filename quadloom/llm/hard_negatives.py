"""Hard negatives by maximum inner product, from cover trees over norm-augmented vectors.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M no less than any norm, so that all
lie on one sphere and the inner product with a query (whose own extra coordinate is 0)
falls as the distance grows. Candidates go to the nearest of a few pivots, and each
piece of at most PIECE of a pivot's rows becomes a cover tree: the children of a node
lie within its covering radius, and a child covers half that radius. An angle between
query and node and the angle of the node's radius bound every inner product below it.

A search takes blocks of anchors. For a block it visits trees and then nodes best first,
by the highest bound that lies in some anchor's window; a node whose bounds lie outside
every window, or under the scores that are already held, is skipped with all below it.
What is reached is verified by its exact score. Trees are files in the shared folder that
workers map one at a time, so memory is one tree, one block of anchors and the table of roots.

Every row takes part whose id, label, vector and components are all given and finite. Vectors are compared
with those of their own length only; an empty vector's scores are 0. "Other" rows are those
of another id, so rows that repeat an id never serve themselves; repeated rows stand for
themselves, and an anchor that occurs twice answers twice. Scores are exact while they stay below
2^53, as sums of whole doubles; larger ones are rounded to doubles. An empty table, or one
without anchors, gives no rows. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm._shared import cut, map_array, open_fs, work_dir, write_file

#: Rows of a tree at most, but for equal chance in dealing a pivot's rows to pieces.
PIECE = 2048
#: Rows for each pivot, and pivots at most: the sample that the candidates are dealt by.
PER_PIVOT, PIVOTS = 4096, 256
#: Members up to which a node's descendants are all its children.
LEAF = 32
#: Anchors searched together.
BLOCK = 256
#: Anchors of a task at most.
TASK = 1024


class Tree(NamedTuple):
    """A node for each row, level by level; children of node i are first[i]:last[i]. Radii cover all that lies below."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


# building


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.column_stack([vectors, rest])


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", others, others) - 2 * (points @ others.T)
    return np.sqrt(np.maximum(square, 0))


def net(points: np.ndarray, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
    """Members as centres further than radius apart, each with those that it covers and no earlier one does."""
    out, left = [], members
    while len(left):
        ahead = left[:64]
        apart = distances(points[ahead], points[left]) <= radius
        free = np.ones(len(left), bool)
        for k in range(len(ahead)):
            if free[k]:
                covered = apart[k] & free
                free &= ~covered
                covered[k] = free[k] = False
                out.append((ahead[k], left[covered]))
        left = left[free]
    return out


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm: float) -> Tree:
    points, n = augmented(vectors, norm), len(ids)
    centre = int(np.argmin(distances(points.mean(0, keepdims=True), points)[0]))
    order, radius, first, last = [centre], np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    waiting = [(0, np.delete(np.arange(n), centre))]
    for at, members in waiting:
        if not len(members):
            continue
        radius[at] = distances(points[order[at]][None], points[members])[0].max()
        flat = len(members) <= LEAF or radius[at] <= 1e-6 * norm
        below = [(m, members[:0]) for m in members] if flat else net(points, members, radius[at] / 2)
        first[at] = len(order)
        waiting += [(len(order) + k, covered) for k, (_, covered) in enumerate(below) if len(covered)]
        order += [m for m, _ in below]
        last[at] = len(order)
    return Tree(ids[order], labels[order], vectors[order], radius + 1e-6 * norm * (radius > 0), first, last)


def save(tree: Tree, uri: str) -> None:
    write_file(uri, [np.ascontiguousarray(x, np.float64 if x.dtype.kind == "f" else np.int64).tobytes() for x in tree])


def load(uri: str, n: int, dim: int) -> Tree:
    whole = map_array(uri, np.int64)
    part = lambda k: whole[k * n : (k + 1) * n]
    tail = 2 + dim
    return Tree(part(0), part(1), whole[2 * n : tail * n].view(np.float64).reshape(n, dim), part(tail).view(np.float64), part(tail + 1), part(tail + 2))


def quantized(column: pa.Array, scale: float) -> np.ndarray:
    """The batch's vectors, all of one length, as whole doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), len(flat) // max(len(column), 1))


def plant(rows: DataFrame, scale: float) -> str:
    """Trees over rows (id, label, v, dim); the folder with their table of roots.

    A pivot's rows are dealt to pieces by position, so that copies of one vector, which
    all lie at one pivot, make many pieces too. Which pivots have more than a piece is
    broadcast: at most PIVOTS rows for each length of vector.
    """
    spark = rows.sparkSession
    folder = work_dir(spark, "cover-trees")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * scale + 1, F.lit(2)))
    size, most = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    norm = float(np.sqrt(most or 0.0))
    sample = rows.select("id", "v", "dim").orderBy(F.xxhash64("id", "v"), "id").limit(min(PIVOTS, -(-size // PER_PIVOT))).collect()
    pivots = {d: augmented(np.floor(scale * np.array([r.v for r in sample if r.dim == d], float)), norm) for d in {r.dim for r in sample}}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, at = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                if d in pivots and len(pivots[d]) > 1:
                    mine = np.flatnonzero(dims == d)
                    vectors = quantized(batch.column("v").take(pa.array(mine)), scale)
                    at[mine] = distances(augmented(vectors, norm), pivots[d]).argmin(1)
            yield batch.append_column("pivot", pa.array(at))

    placed = cut(rows.mapInArrow(nearest, "id long, label long, v array<double>, dim int, pivot int"))
    large = placed.groupBy("dim", "pivot").count().where(F.col("count") > PIECE).select("dim", "pivot", F.ceil(F.col("count") / PIECE).alias("pieces"))
    dealt = placed.join(F.broadcast(large), ["dim", "pivot"], "left").withColumn("piece", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("pieces")), F.lit(0)))

    def grow(table: pa.Table) -> pa.Table:
        vectors = quantized(table.column("v").combine_chunks(), scale)
        tree = build(table.column("id").to_numpy(), table.column("label").to_numpy(), vectors, norm)
        name = uuid.uuid4().hex  # an attempt's own; only the names that the table of roots holds are read
        save(tree, f"{folder}/{name}.tree")
        return pa.table({"name": [name], "n": [len(tree.ids)], "dim": pa.array([vectors.shape[1]], pa.int32()), "root": pa.array([tree.vectors[0].tolist()], pa.list_(pa.float64())), "radius": [tree.radius[0]], "norm": [norm]})

    roots = dealt.groupBy("dim", "pivot", "piece").applyInArrow(grow, "name string, n long, dim int, root array<double>, radius double, norm double")
    roots.write.parquet(f"{folder}/roots")
    return folder


# searching


def bounds(scores: np.ndarray, length: np.ndarray, radius: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner products below nodes whose own are scores (anchors x nodes), a little widened.

    The angle between anchor and any vector below differs from that to the node by the
    radius' angle at most.
    """
    if not norm:
        return scores - 1, scores + 1
    reach = length[:, None] * norm  # of an anchor, whatever the direction
    cos = np.clip(1 - np.minimum(radius, 2 * norm) ** 2 / (2 * norm * norm), -1, 1)
    sin = np.sqrt(1 - cos * cos)
    across = np.sqrt(np.maximum(reach * reach - scores * scores, 0)) * sin
    slack = 1e-9 * reach + 1e-3
    high = np.where(scores >= reach * cos, reach, scores * cos + across) + slack
    low = np.where(scores <= -reach * cos, -reach, scores * cos - across) - slack
    return low, high


class Best:
    """The k first (score falling, id rising) of each query."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def least(self, queries: np.ndarray) -> np.ndarray:
        return self.scores[queries, -1]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """scores and fit: queries x candidates."""
        if scores.shape[1] > 8 * self.k:  # only what is among a query's own first can be among its best
            kth = np.partition(np.where(fit, scores, -np.inf), -self.k, axis=1)[:, -self.k]
            fit = fit & (scores >= kth[:, None])
        row, col = np.nonzero(fit)
        if not len(row):
            return
        touched, of = np.unique(row, return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(touched)), self.k), of])
        every = np.concatenate([self.scores[queries[touched]].ravel(), scores[row, col]])
        names = np.concatenate([self.ids[queries[touched]].ravel(), ids[col]])
        order = np.lexsort((names, -every, group))
        place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        first = order[place < self.k]
        self.scores[queries[touched]] = every[first].reshape(-1, self.k)
        self.ids[queries[touched]] = names[first].reshape(-1, self.k)


class Forest:
    """The roots of a folder's trees; the trees themselves are opened where a search reaches them."""

    def __init__(self, folder: str) -> None:
        store, path = open_fs(f"{folder}/roots")
        table = pq.read_table(path, filesystem=store)
        self.folder, self.trees = folder, table.select(["name", "n", "dim", "radius"]).to_pylist()
        self.roots, self.norm = table.column("root").to_pylist(), table.column("norm")[0].as_py() if table.num_rows else 0.0

    def search(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Best:
        """For each query, an anchor (of) and a window [low, high] of scores: the k first others of the same label, or of different ones."""
        best, dim, length = Best(len(of), k), anchors.shape[1], np.linalg.norm(anchors, axis=1)
        mine = [t for t, tree in enumerate(self.trees) if tree["dim"] == dim]
        if not mine or not len(of):
            return best
        radius = np.array([self.trees[t]["radius"] for t in mine])
        lows, highs = bounds(anchors @ np.array([self.roots[t] for t in mine], float).T, length, radius, self.norm)
        lows, highs = lows[of], np.minimum(highs[of], high[:, None])
        order = np.argsort(-np.where((lows <= high[:, None]) & (highs >= low[:, None]), highs, -np.inf).max(0), kind="stable")
        for t in order:
            fit = np.flatnonzero((lows[:, t] <= high) & (highs[:, t] >= np.maximum(low, best.scores[:, -1])))
            if len(fit):
                tree = self.trees[mine[t]]
                descend(load(f"{self.folder}/{tree['name']}.tree", tree["n"], dim), self.norm, anchors, length, ids, labels, of, low, high, same, fit, best)
        return best


def descend(tree: Tree, norm: float, anchors: np.ndarray, length: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, queries: np.ndarray, best: Best) -> None:
    """Best-first through a tree for the queries that may find something there."""

    def verify(at: slice, queries: np.ndarray) -> np.ndarray:
        """Exact scores (queries x nodes), offered to the queries' best."""
        who, back = np.unique(of[queries], return_inverse=True)
        scores = (anchors[who] @ tree.vectors[at].T)[back]
        mine = of[queries][:, None]
        fit = (scores <= high[queries, None]) & (scores >= np.maximum(low[queries], best.least(queries))[:, None])
        fit &= ((labels[mine] == tree.labels[at]) == same) & (ids[mine] != tree.ids[at])
        best.add(queries, scores, tree.ids[at], fit)
        return scores

    verify(slice(0, 1), queries)
    heap, number = [(-np.inf, 0, 0, queries, np.full(len(queries), np.inf))], 0
    while heap:
        _, _, node, queries, above = heapq.heappop(heap)
        queries = queries[above >= np.maximum(low[queries], best.least(queries))]
        start, end = tree.first[node], tree.last[node]
        if not len(queries) or start == end:
            continue
        scores = verify(slice(start, end), queries)
        inner = np.flatnonzero(tree.last[start:end] > tree.first[start:end])
        if not len(inner):
            continue
        lows, highs = bounds(scores[:, inner], length[of[queries]], tree.radius[start:end][inner], norm)
        top, floor = high[queries][:, None], np.maximum(low[queries], best.least(queries))[:, None]
        open_to = (lows <= top) & (highs >= floor)
        for j in np.flatnonzero(open_to.any(0)):
            who = open_to[:, j]
            number += 1
            heapq.heappush(heap, (-np.minimum(highs[who, j], high[queries[who]]).max(), number, int(start + inner[j]), queries[who], highs[who, j]))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v, dim) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return kept.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", finite)).withColumn("dim", F.size("v"))


def mine(anchors: DataFrame, candidates: DataFrame, scale: float = 256, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """Hard negatives of every anchor and positive, anchors and candidates being usable() rows.

    A positive is one of an anchor's first others of its label; its negatives are the first
    of other labels that score from least[0]/least[1] of the positive's score up to it.
    Scores are inner products of floor(scale * x). Anchors are dealt to tasks, the forest
    is open to all of them, and no row is exchanged between tasks.
    """
    folder = plant(candidates, scale)
    asked = cut(anchors)
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None
        for whole in batches:
            forest = forest or Forest(folder)
            dims = whole.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = whole.take(pa.array(np.flatnonzero(dims == d)))
                for at in range(0, rows.num_rows, BLOCK):
                    yield found(forest, rows.slice(at, BLOCK), scale, positives, negatives, least)

    return asked.repartition(tasks, F.xxhash64("id", "v")).mapInArrow(run, RESULT)


def found(forest: Forest, rows: pa.RecordBatch, scale: float, positives: int, negatives: int, least: tuple[int, int]) -> pa.RecordBatch:
    ids, labels, vectors = rows.column("id").to_numpy(), rows.column("label").to_numpy(), quantized(rows.column("v"), scale)
    of = np.arange(len(ids))
    wide = np.full(len(ids), np.inf)
    near = forest.search(vectors, ids, labels, of, -wide, wide, True, positives)
    of, place = np.nonzero(np.isfinite(near.scores))
    scores, names = near.scores[of, place], near.ids[of, place]
    low = np.ceil(least[0] * scores / least[1])
    ok = np.flatnonzero(low <= scores)  # a window below zero is empty
    far = forest.search(vectors, ids, labels, of[ok], low[ok], scores[ok], False, negatives)
    pair, rank = np.nonzero(np.isfinite(far.scores))
    whole = lambda x: pa.array(np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    pairs = ok[pair]
    columns = [pa.array(ids[of[pairs]]), pa.array(names[pairs]), pa.array((rank + 1).astype(np.int32)), pa.array(far.ids[pair, rank]), whole(scores[pairs]), whole(far.scores[pair, rank])]
    return pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def contract(embeddings: DataFrame) -> DataFrame:
    """Anchors are the ids divisible by 100; where 7 divides the id, the label is the next of ten."""
    rows = usable(embeddings)
    rows = cut(rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine(rows.where(F.col("id") % 100 == 0), rows)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
