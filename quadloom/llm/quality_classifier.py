"""Quality scores by a Gaussian kernel, approximated with random Fourier features.

Statistics of whole texts are standardised and mapped to cosines of random
projections. Each partition of labelled rows adds up its share of the ridge
regression's normal equations; the sums are added on executors, so that the driver
solves one system of WIDTH + 1 unknowns. Isotonic regression on labelled rows that
the fit has not seen turns scores into probabilities.

Labels are learnt from bucket 0, 1 (fit) and 3 (calibration) of crc32(id) mod 4;
bucket 2 is held out. All of them are used. Labels that are null or whose id
is null or has no document teach nothing; an id labelled twice counts twice. Null
and empty texts are scored like any other, by their statistics, which are zeros.
Without labels every score is 0.5. Repeated rows keep their places and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import text_stats
from quadloom.llm._arrow import bucket_crc, with_struct
from quadloom.llm._shared import cut, fresh, lookup

#: Random features, their seed and the kernel's width in standard deviations.
WIDTH, SEED, SIGMA = 256, 11, 3.0
RIDGE = 1.0
#: Steps between raw scores that calibration tells apart.
STEP = 0.002
CUTOFF = 0.7

RATIOS = [("n_symbols", "n_words"), ("n_symbols", "n_bytes"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_distinct", "n_words"), ("n_top", "n_words"), ("n_stutter", "n_words"), ("n_upper", "n_bytes"), ("n_digits", "n_bytes"), ("n_stops", "n_words"), ("n_shouts", "n_words"), ("n_bare", "n_words"), ("word_chars", "n_words"), ("n_words", "n_lines")]
NAMES = [f"{a}_{b}" for a, b in RATIOS] + ["log_words"]


def features(texts: pa.StringArray) -> np.ndarray:
    """A row of NAMES for each text; long tails are held by square roots and a logarithm."""
    s = text_stats.stats(texts)
    ratios = [np.sqrt(s[a] / np.maximum(s[b], 1)) for a, b in RATIOS]
    return np.stack([*ratios, np.log1p(s["n_words"])], axis=1)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores of rows of features."""
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / SIGMA, (x.shape[1], WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH)
    return np.concatenate([np.sqrt(2 / WIDTH) * np.cos(np.clip(x, -8, 8) @ w + b), np.ones((len(x), 1))], axis=1)


def isotonic(x: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators over ascending x; knots and levels to interpolate between, ascending strictly in x."""
    blocks: list[list[float]] = []
    for a, p, m in zip(x, positive, n, strict=True):
        blocks.append([a * m, p, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [c + d for c, d in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def with_features(docs: DataFrame, text: str = "text", only: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """docs (those that only leaves) and a struct column __x of NAMES."""
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])
    return with_struct(docs, "__x", kind, lambda t: dict(zip(NAMES, features(t).T, strict=True)), text, only)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column("__x").field(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1) if batch.num_rows else np.zeros((0, len(NAMES)))


def taught(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(__id, y, bucket) of the labels that may be learnt from."""
    return labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).where("__id is not null and y is not null").withColumn("bucket", bucket_crc("__id", 4)).where("bucket <> 2")


def fit(featured: DataFrame, known: DataFrame, id_col: str = "doc_id") -> Model:
    """featured: id_col and __x. known: what taught gives."""
    rows = cut(known.join(featured.select(F.col(id_col).alias("__id"), "__x"), "__id").select("bucket", "y", "__x"))
    train, rest = rows.where("bucket < 2"), rows.where("bucket = 3")
    aggregates = [F.avg(f"__x.{n}") for n in NAMES] + [F.stddev_pop(f"__x.{n}") for n in NAMES]
    stats = train.agg(*aggregates).first()
    if stats[0] is None:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(WIDTH + 1), np.zeros(1), np.full(1, 0.5))
    mean, scale = np.array(stats[: len(NAMES)]), np.array(stats[len(NAMES) :])
    scale = np.where(scale > 1e-9, scale, 1.0)

    def equations(batches):
        a, b = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1)
        for batch in batches:
            z = fourier((_matrix(batch) - mean) / scale)
            a += z.T @ z
            b += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(a, b[None, :], axis=0).tobytes()], pa.binary())], ["sums"])

    def add(batches):
        total = np.zeros((WIDTH + 2, WIDTH + 1))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # however many the rows, partial sums are 64 at most, added in 8 tasks
    partial = train.coalesce(64).mapInArrow(equations, "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()
    sums = np.sum([np.frombuffer(r["sums"]).reshape(WIDTH + 2, WIDTH + 1) for r in partial], axis=0)
    weights = np.linalg.solve(sums[:-1] + RIDGE * np.eye(WIDTH + 1), sums[-1])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(model.raw(_matrix(batch)), -1, 2) / STEP), pa.int64(), from_pandas=True, safe=False), batch.column("y")], ["step", "y"])

    steps = rest.mapInArrow(raw, "step long, y int").groupBy("step").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    if not steps:
        return model
    knots, levels = isotonic(np.array([r["step"] for r in steps]) * STEP, np.array([r["p"] for r in steps], float), np.array([r["n"] for r in steps], float))
    # a thousandth of slope keeps apart what calibration ties
    ends = np.concatenate([[-1.0], knots, [2.0]])
    held = np.concatenate([levels[:1], levels, levels[-1:]])
    return model._replace(knots=ends, levels=0.999 * held + 0.001 * (ends + 1) / 3)


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """docs and their calibrated scores; features and score are made in one pass over the texts."""
    kind = T.StructType([T.StructField("score", T.DoubleType())])
    held = fresh(docs, "__s")
    return with_struct(docs, held, kind, lambda t: {"score": model.score(features(t))}, text).withColumn(name, F.col(f"{held}.score")).drop(held)


def scores(model: Model, x: str = "__x") -> Column:
    """Calibrated score of a column of features."""

    @F.arrow_udf("double")
    def apply(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(np.stack([rows.field(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1)))

    return apply(F.col(x))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """id, held_out, score, predicted for each document. Texts are read once; their features go to the checkpoint folder."""
    rows = cut(with_features(docs.select(id_col, text), text).drop(text))
    model = fit(rows, taught(labels, id_col), id_col)
    return rows.select(id_col, (bucket_crc(id_col, 4) == 2).alias("held_out"), scores(model).alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The documents that classify accepts, with all their columns and no join on ids.

    Only labelled documents' features are made for the fit: their ids' hashes are looked
    up in mapped files (of ids of another type than the labels', all documents' features
    are made). The filter makes all anew, so that whole texts never pass through a
    shuffle or the checkpoint folder.
    """
    known, kind = cut(taught(labels, id_col)), docs.schema[id_col].dataType
    labelled, only = docs.select(F.col(id_col), F.col(text)), None
    if kind == known.schema["__id"].dataType and isinstance(kind, (T.IntegralType, T.StringType)):
        only = fresh(labelled, "__hash"), lookup(known.select(F.xxhash64("__id").alias("id")).distinct())
        labelled = labelled.withColumn(only[0], F.xxhash64(id_col))
    model = fit(with_features(labelled, text, only).drop(text), known, id_col)
    score = fresh(docs, "__score")
    return with_score(docs, model, score, text).where(F.col(score) >= cutoff).drop(score)
