"""One document written by many tasks.

The data source `quadloom_document` takes ordered rows `value`. Each task writes its rows to a
part of its own, with what goes between two of them; the commit lists the parts in order
between the document's head and tail, which may tell the number of rows ({count}). Nothing of the rows
passes the driver: it sees a name and a count for each task, and parts of attempts
that did not count are not listed.

The list is the document: stream() reads it from end to end, read() gives its rows back in
parallel, and join() makes one file of it, for documents that a single machine is to hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quadloom.sources.graph_files import open_store

LIST = "document.json"


@dataclass
class Part(WriterCommitMessage):
    place: int
    name: str
    rows: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.around = options["path"], json.loads(options["around"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, folder = open_store(self.uri)
        store.create_dir(folder, recursive=True)
        place, rows = TaskContext.get().partitionId(), 0
        name, between = f"part-{place:06d}-{uuid.uuid4().hex}", self.around[1].encode()
        out = None
        for batch in batches:
            for value in batch.column("value").to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}")
                elif rows:
                    out.write(between)
                out.write((value or "").encode())
                rows += 1
        if out is not None:
            out.close()
        return Part(place, name if rows else "", rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = open_store(self.uri)
        store.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.place)
        head, between, tail = self.around
        count = sum(m.rows for m in parts)
        told = {"head": head.replace("{count}", str(count)), "between": between, "tail": tail if count or tail != between else "", "parts": [[m.name, m.rows] for m in parts]}
        with store.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = open_store(self.uri)
        for m in messages:
            if m is not None and m.rows:
                store.delete_file(f"{folder}/{m.name}")


class DocumentSource(DataSource):
    """rows.write.format("quadloom_document").mode("append").option("around", ...).save(folder); see write."""

    @classmethod
    def name(cls) -> str:
        return "quadloom_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write(rows: DataFrame, around: tuple[str, str, str], uri: str) -> None:
    """Rows `value`, in ascending order, as one document in a new folder. around: what stands before, between and after them."""
    rows.sparkSession.dataSource.register(DocumentSource)
    rows.select("value").orderBy("value").write.format("quadloom_document").mode("append").option("around", json.dumps(list(around))).save(uri)


def told(uri: str) -> dict:
    store, folder = open_store(uri)
    with store.open_input_stream(f"{folder}/{LIST}") as source:
        return json.loads(source.read())


def stream(uri: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """The document's bytes from end to end, a piece at a time."""
    store, folder = open_store(uri)
    found = told(uri)
    yield found["head"].encode()
    for k, (name, _) in enumerate(found["parts"]):
        if k:
            yield found["between"].encode()
        with store.open_input_stream(f"{folder}/{name}") as source:
            while data := source.read(piece):
                yield data
    yield found["tail"].encode()


def join(uri: str, to: str) -> None:
    """The document as one file."""
    store, path = open_store(to)
    with store.open_output_stream(path) as out:
        for data in stream(uri):
            out.write(data)


def read(spark: SparkSession, uri: str) -> DataFrame:
    """(n, value): the head as row 0, the rows from 1 on, and the tail behind them. Values must not hold what goes between them."""
    found = told(uri)
    starts, at = [], 1
    for name, rows in found["parts"]:
        starts.append((name, at, rows))
        at += rows
    frame = spark.createDataFrame([(0, found["head"]), (at, found["tail"])], "n long, value string")
    if not found["between"]:
        raise ValueError("rows without anything between them cannot be told apart")
    if not starts:
        return frame
    places = F.broadcast(spark.createDataFrame(starts, "name string, start long, rows long"))  # a row for each task
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(uri).select(F.substring_index("path", "/", -1).alias("name"), "content")
    values = files.join(places, "name").select("start", F.posexplode(F.split(F.col("content").cast("string"), F.concat(F.lit("\\Q"), F.lit(found["between"]), F.lit("\\E")), -1)).alias("k", "value"))
    return values.select((F.col("start") + F.col("k")).alias("n"), "value").unionByName(frame)
