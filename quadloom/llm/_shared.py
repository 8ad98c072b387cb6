"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not base and current.isDefined():
        base = os.path.dirname(current.get())
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not current.isDefined():
        sc.setCheckpointDir(base)
    return base


def work_dir(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared one."""
    base = checkpoint_dir(spark)
    uri = f"{base if '://' in base or base.startswith('file:') else 'file://' + os.path.abspath(base)}/{name}-{uuid.uuid4().hex}"
    store, path = open_fs(uri)
    store.create_dir(path, recursive=True)
    return uri


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; to be called where the files are used."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: list[bytes]) -> None:
    """Whole or not at all: a retried or doubled task leaves one complete file."""
    store, path = open_fs(uri)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    put(store, draft, path)


def put(store: fs.FileSystem, draft: str, path: str) -> None:
    """Gives a finished draft its name; a file of an earlier attempt goes."""
    try:
        store.move(draft, path)
    except OSError:
        store.delete_file(path)
        store.move(draft, path)


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it; Spark's names don't tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(texts: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return texts.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def join_hot(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """rows with the columns of by, which has one row for each key.

    Keys of more than a task's share of the rows, of which there are fewer than tasks,
    are looked up in a broadcast table, so none of them is one task's work; the others
    join by shuffle. Both sides should be cheap to read again.
    """
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = cut(counts.where(F.col("__n") > max(1, total // slots)).select(key))
    if hot.isEmpty():
        return rows.join(by, key)
    few = F.broadcast(hot)
    return rows.join(F.broadcast(by.join(few, key, "left_semi")), key).unionByName(rows.join(few, key, "left_anti").join(by, key))


class Held:
    """What the last `most` keys asked for have made: a process may map only so many files at a time."""

    def __init__(self, most: int):
        self.most, self.held = most, OrderedDict()

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]


def map_array(uri: str, dtype: type):
    """The file as a read-only memory-mapped array.

    It is mapped in place, so a machine's workers share its pages; the shared folder must
    therefore be mounted, and a folder that only a client library can read is an error.
    """
    import numpy as np

    store, path = open_fs(uri)
    if not isinstance(store, fs.LocalFileSystem):
        raise ValueError(f"{uri} cannot be mapped: spark.checkpoint.dir must be a mounted file system")
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def among(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether a long that is not null is one of ids, as lookup has them."""
    has = lookup(ids)

    @F.arrow_udf("boolean")
    def apply(longs: pa.Array) -> pa.Array:
        return pa.array(has(longs.to_numpy(zero_copy_only=False)))

    return apply


def lookup(ids: DataFrame) -> Callable:
    """Function for tasks: which of an array of longs are ids (column id). These go as sorted arrays to the shared folder, where workers map them."""
    import numpy as np

    spark = ids.sparkSession
    uri, shards = work_dir(spark, "ids"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        write_file(f"{uri}/{shard}", [np.sort(table["id"].to_numpy())])
        return pa.table({"shard": pa.array([shard], pa.int64())})

    dealt = ids.withColumn("shard", F.pmod("id", F.lit(shards)))
    written = {r["shard"] for r in dealt.groupBy("shard").applyInArrow(write, "shard long").collect()}

    def has(values: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(values), bool), np.mod(values, shards)
        for s in np.intersect1d(shard, list(written)).tolist():
            at, held = np.flatnonzero(shard == s), map_array(f"{uri}/{s}", np.int64)
            place = np.minimum(np.searchsorted(held, values[at]), len(held) - 1)
            out[at] = held[place] == values[at]
        return out

    return has
