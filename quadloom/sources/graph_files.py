"""Folders and files of graphs in mixed syntaxes, in byte ranges.

N-Triples and N-Quads are Spark's own text source: lines split anywhere and are parsed by
native columns. Turtle and TriG split between statements: a first pass, one task a file and
a piece of it in memory at a time, looks for the ends of statements outside of strings, IRIs, comments and
brackets, and notes about every RANGE bytes where a range may begin, with the prefixes,
the base and the graph that hold there. RDF/XML is read as a stream of events.
JSON-LD is one value and stays whole.

The data source `quadloom_graph` plans its partitions from that index: ranges of a
large file apart, small files together up to RANGE bytes. A reader holds one range. Only quads
of the predicates asked for leave it.

Blank nodes with a label are the same in all ranges of a file; others are named by the range.
An empty file or folder has no quads; a file whose ending names no syntax is an error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadloom.functions.iris import resolve
from quadloom.operators.paths import ensure_checkpoints
from quadloom.sources import rdf_text

#: Bytes of a range, about, and of a piece in the first pass.
RANGE, PIECE = 16 << 20, 1 << 20
#: Quads of a batch.
BATCH = 20_000
#: Endings of file names by syntax.
ENDINGS = {"ttl": "text/turtle", "trig": "application/trig", "rdf": "application/rdf+xml", "owl": "application/rdf+xml", "xml": "application/rdf+xml", "jsonld": "application/ld+json", "json": "application/ld+json"}
LINE_ENDINGS = ("nt", "nq", "ntriples", "nquads")
LINES = ("application/n-triples", "application/n-quads")
SPLIT = ("text/turtle", "application/trig")

_SPACE = r"(?:[ \t\r\n]|#[^\n]*\n)"
_PREFIX = re.compile(rf"(?:@prefix|prefix(?={_SPACE})){_SPACE}*([^\s:<>\"]*):{_SPACE}*<([^>\n]*)>", re.IGNORECASE)
_BASE = re.compile(rf"(?:@base|base(?={_SPACE})){_SPACE}*<([^>\n]*)>", re.IGNORECASE)
_DOT = re.compile(rf"{_SPACE}*\.")
#: What the first pass tells apart: what cannot end a statement, and single signs.
_LEXEME = re.compile(
    r'(?P<skip>[ \t\r\n]+|#[^\n]*\n)|(?P<iri><[^>\n]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?!"")(?:[^"\\\n]|\\.)*"|\'(?!\'\')(?:[^\'\\\n]|\\.)*\')'
    r"|(?P<mark>[\[\](){}])|(?P<dot>\.(?![0-9]))|(?P<word>(?:\\.|[^\s\"'<>\[\](){}#\\])+?(?=\.?(?:[\s\"'<>\[\](){}#]|\Z)))",
    re.DOTALL,
)


def known(uri: str) -> bool:
    """Whether a file's ending names its syntax."""
    found = re.search(r"\.([A-Za-z]+)(\.gz)?$", uri)
    return bool(found) and (found[1].lower() in LINE_ENDINGS or found[1].lower() in ENDINGS and not found[2])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def ranges(file, size: int, base: str, span: int) -> Iterator[dict]:
    """Ranges of a Turtle or TriG file that begin between statements: start, end, and the prefixes, base and graph that hold at the start.

    A range that begins inside a graph's block has its name (an empty one for the default graph), else null.
    """
    prefixes: dict[str, str] = {}
    graph: str | None = None
    held, offset, done = "", 0, 0  # text that is not read yet, the bytes before it, the bytes read from the file
    tail = b""
    brackets, fresh, label = 0, True, ""  # open brackets; whether a statement begins; the last term at its beginning
    whole = False  # whether a block without a name of its own is open, which no range may divide
    begin = {"start": 0, "prefixes": {}, "base": base, "graph": None}

    def more() -> bool:
        nonlocal held, done, tail
        piece = file.read_at(min(max(PIECE, len(held)), size - done), done) if done < size else b""
        done += len(piece)
        data = tail + piece
        cut = len(data)
        if done < size:  # a character may go on in the next piece
            while cut > 0 and cut > len(data) - 4 and data[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            if cut > 0 and data[cut - 1] >= 0xC0:
                cut -= 1
            else:
                cut = len(data)
        tail = data[cut:]
        held += data[:cut].decode()
        return bool(piece)

    def take(n: int) -> None:
        nonlocal held, offset
        offset += len(held[:n].encode())
        held = held[n:]

    more()
    if held.startswith("﻿"):
        take(1)
    at = 0  # in held; what lies before is done with and goes at the next cut
    while True:
        if at > PIECE:
            take(at)
            at = 0
        if len(held) - at < 4096 and done < size:
            take(at)
            at = 0
            more()
            continue
        last = done >= size
        if at >= len(held):
            break
        if fresh and brackets == 0 and graph is None:
            found = _PREFIX.match(held, at) or _BASE.match(held, at)
            if found:
                if found.re is _PREFIX:
                    prefixes = {**prefixes, found[1]: resolve(base, rdf_text._plain(found[2]))}
                else:
                    base = resolve(base, rdf_text._plain(found[1]))
                dotted = held[at] == "@"
                at = found.end()
                if dotted:
                    dot = _DOT.match(held, at)
                    if not dot:
                        raise ValueError(f"a directive without its end at byte {offset}")
                    at = dot.end()
                continue
        m = _LEXEME.match(held, at)
        if m is None or (m.end() == len(held) and not last):
            if not last:  # the token goes on beyond what is held
                take(at)
                at = 0
                more()
                continue
            if m is None:
                at += 1  # the end of the file, or what the parser will complain about
                fresh = False
                continue
        kind, text = m.lastgroup, m[0]
        at = m.end()
        ends = False
        if kind == "skip":
            continue
        if kind == "mark" and text in "[(":
            brackets, fresh = brackets + 1, False
        elif kind == "mark" and text in "])":
            brackets, label = max(0, brackets - 1), "[]"
        elif text == "{":
            whole = label == "[]"
            graph, label, fresh, ends = label, "", True, not whole
        elif text == "}":
            graph, label, fresh, ends, whole = None, "", True, True, False
        elif kind == "dot" and brackets == 0:
            label, fresh, ends = "", True, not whole
        else:
            label = "" if text.lower() == "graph" and fresh else text
            fresh = fresh and text.lower() == "graph"
        if ends and offset + at - begin["start"] >= span:  # characters of what is held count as bytes here
            place = offset + len(held[:at].encode())
            if place < size:
                yield {**begin, "end": place, "inside": graph is not None}
                begin = {"start": place, "prefixes": prefixes, "base": base, "graph": graph}
    yield {**begin, "end": size, "inside": graph is not None}


INDEX = "path string, media_type string, start long, end long, context string"


def index(spark: SparkSession, uri: str, span: int = RANGE, media_type: str | None = None) -> DataFrame:
    """The ranges of all files under uri but those of lines; files are listed by Spark, their content is not read where a file stays whole."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path", "length")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)(?:\.gz)?$", 1))
    known = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    media = F.when(ending.isin(*LINE_ENDINGS), F.lit("")).otherwise(F.coalesce(F.try_element_at(known, ending), F.raise_error(F.concat(F.lit("no graph syntax has the ending of "), "path")).cast("string")))
    if media_type is not None:
        media = F.lit("" if media_type in LINES else media_type)
    files = listed.select("path", "length", media.alias("media_type")).where("media_type <> '' and length > 0")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [{"start": 0, "end": size}]
                if kind in SPLIT and size > span:
                    store, name = open_store(path)
                    with store.open_input_file(name) as file:
                        found = list(ranges(file, size, path, span))
                told = [json.dumps({k: v for k, v in f.items() if k not in ("start", "end")}) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([kind] * len(found)), pa.array([f["start"] for f in found], pa.int64()), pa.array([f["end"] for f in found], pa.int64()), pa.array(told)], ["path", "media_type", "start", "end", "context"])

    return files.repartition(F.col("path")).mapInArrow(find, INDEX)


class Ranges(InputPartition):
    def __init__(self, parts: list[tuple]):
        self.parts = parts


class GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.span = options["index"], int(options.get("span", RANGE))
        self.predicates = set(json.loads(options["predicates"])) if options.get("predicates") else None

    def partitions(self) -> list[InputPartition]:
        """Ranges in order of path and place, joined up to the span."""
        store, path = open_store(self.index)
        rows = pq.read_table(path, filesystem=store).sort_by([("path", "ascending"), ("start", "ascending")]).to_pylist()
        out: list[list[tuple]] = []
        room = 0
        for r in rows:
            size = r["end"] - r["start"]
            if size > room or not out:
                out.append([])
                room = self.span
            out[-1].append((r["path"], r["media_type"], r["start"], r["end"], r["context"]))
            room -= size
        return [Ranges(parts) for parts in out] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in partition.parts:
            for quad in self.quads(*part):
                if self.predicates is None or quad[2][1] in self.predicates:
                    rows.append((part[0], *quad))
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def quads(self, path: str, kind: str, start: int, end: int, context: str) -> Iterator[tuple]:
        store, name = open_store(path)
        scope, told = rdf_text.scope_name(path), json.loads(context)
        try:
            with store.open_input_file(name) as file:
                if kind == "application/rdf+xml":
                    yield from rdf_text.stream_rdf_xml(file, scope, path)
                    return
                data = file.read_at(end - start, start)
            text = data.decode().removeprefix("﻿")
            if told.get("graph") is not None:
                text = f"{told['graph']} {{ {text}"
            if told.get("inside"):
                text += "\n}"
            if kind in SPLIT:
                yield from rdf_text._Turtle(text, scope, told.get("base", path), told.get("prefixes"), f"r{start}-" if start else "").run()
            else:
                yield from rdf_text.READERS[kind](text, scope, path).run()
        except rdf_text.FAULTS as e:
            raise ValueError(f"{path} cannot be read between bytes {start} and {end}: {e}") from e


class GraphSource(DataSource):
    """spark.read.format("quadloom_graph").option("index", ...).load(): quads of the ranges of an index; see load."""

    @classmethod
    def name(cls) -> str:
        return "quadloom_graph"

    def schema(self) -> str:
        return "uri string, " + rdf_text.QUAD

    def reader(self, schema) -> DataSourceReader:
        return GraphReader(self.options)


_TERM = pa.struct([("kind", pa.int8()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    uri, *quads = zip(*rows, strict=True)
    columns = [pa.array([None if t is None else dict(zip(("kind", "lex", "dt", "lang"), t, strict=True)) for t in column], _TERM) for column in quads]
    return pa.RecordBatch.from_arrays([pa.array(uri, pa.string()), *columns], ["uri", "g", "s", "p", "o"])


def load(spark: SparkSession, uri: str, predicates: list[str] | None = None, span: int = RANGE, media_type: str | None = None) -> DataFrame:
    """uri, g, s, p, o of every file under a folder, or of a file; of the given predicates only, if any are given. media_type: of all files, whatever their endings.

    The index of ranges is written to the shared checkpoint folder, where the driver reads
    it (a row for each RANGE bytes) to plan partitions.
    """
    ensure_checkpoints(spark.range(0))
    spark.dataSource.register(GraphSource)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graph-index-{os.urandom(8).hex()}"
    index(spark, uri, span, media_type).write.parquet(place)
    options = {"index": place, "span": str(span)} | ({"predicates": json.dumps(predicates)} if predicates is not None else {})
    nested = spark.read.format("quadloom_graph").options(**options).load()
    glob = "*.{" + ",".join([*LINE_ENDINGS, *(f"{e}.gz" for e in LINE_ENDINGS)]) + "}"
    if media_type is not None:
        if media_type not in LINES:
            return nested
        glob = "*"
    text = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(uri).select("value", F.col("_metadata.file_path").alias("uri"))
    if predicates is not None:  # a line that names none of them, escapes apart, is passed over unread
        named = F.lit(False)
        for p in predicates:
            named = named | F.contains("value", F.lit(f"<{p}>"))
        text = text.where(named | F.contains("value", F.lit("\\u")) | F.contains("value", F.lit("\\U")))
    quads = rdf_text.lines(text, rdf_text.scope_of(F.col("uri")), keep=("uri",)).select("uri", "g", "s", "p", "o")
    if predicates is not None:
        quads = quads.where(F.col("p.lex").isin(*predicates))
    return quads.unionByName(nested)
