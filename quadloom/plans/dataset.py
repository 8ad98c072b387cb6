"""Datasets of named graphs: sources resolved by URI, the vocabulary, and answers by media type."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import media, terms
from quadloom.functions.sniff import rdf_syntax
from quadloom.operators import serialize
from quadloom.operators.solutions import Solutions
from quadloom.sources import document_files, graph_files, rdf_text

NS = "http://data.example/ns#"
VOCABULARY_GRAPH = "http://data.example/vocabulary"
#: Our own vocabulary: endpoints, and converters as a kind of them.
VOCABULARY = f"""
@prefix q: <{NS}> .
@prefix rdfs: <{terms.RDFS}> .
q:Endpoint a rdfs:Class ; rdfs:label "Endpoint" .
q:Converter a rdfs:Class ; rdfs:subClassOf q:Endpoint ; rdfs:label "Converter" .
q:id rdfs:domain q:Endpoint .
q:convertsFrom rdfs:domain q:Converter .
q:convertsTo rdfs:domain q:Converter .
"""

Resolver = Callable[[SparkSession, str], DataFrame]


def split_graphs(text: str) -> list[str]:
    """URIs of a list separated by commas, spaces, newlines or tabs."""
    return [u for u in re.split(r"[, \n\t]", text) if u.strip()]


class Dataset:
    """Graphs by URI. Nothing is read until a graph is asked for; then only what the patterns need."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.resolvers = spark, {}, {"file": _file}

    def register(self, uri: str, quads: DataFrame) -> Dataset:
        """A DataFrame of quads (or of triples) under a URI. Its own named graphs keep their names."""
        named = F.col("g") if "g" in quads.columns else F.lit(None).cast(terms.TERM)
        self.known[uri] = quads.select(F.coalesce(named, terms.iri(uri)).alias("g"), "s", "p", "o")
        return self

    def resolver(self, scheme: str, resolve: Resolver) -> Dataset:
        """How URIs of a scheme (http, say) become documents (uri, content, media_type)."""
        self.resolvers[scheme] = resolve
        return self

    def graph(self, uri: str) -> DataFrame:
        if uri in self.known:
            return self.known[uri]
        scheme = uri.split(":", 1)[0]
        if scheme not in self.resolvers:
            raise ValueError(f"nothing resolves {uri}")
        return self.register(uri, _read(self.resolvers[scheme](self.spark, uri))).known[uri]

    def vocabulary(self) -> DataFrame:
        text = self.spark.createDataFrame([(VOCABULARY_GRAPH, VOCABULARY, "text/turtle")], "uri string, content string, media_type string")
        return rdf_text.documents(text).select(terms.iri(VOCABULARY_GRAPH).alias("g"), "s", "p", "o")

    def quads(self, graphs: str = "", vocabulary: bool = True) -> DataFrame:
        """All quads of the listed graphs, a graph listed twice counting once, and of the vocabulary."""
        parts = [self.graph(u) for u in dict.fromkeys(split_graphs(graphs))] + ([self.vocabulary()] if vocabulary else [])
        return reduce(lambda a, b: a.union(b), parts)


def _file(spark: SparkSession, uri: str) -> DataFrame:
    """A folder, or a file whose ending names its syntax: quads, large files in ranges. Other files are documents whose syntax is sniffed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    if whole or graph_files.known(uri):
        return graph_files.load(spark, uri).select("g", "s", "p", "o")
    files = spark.read.format("binaryFile").load(uri)
    return files.select(F.col("path").alias("uri"), "content", F.lit(None).cast("string").alias("media_type"))


def _read(documents: DataFrame) -> DataFrame:
    """Quads of documents by media type, or by sniffing where that is no graph format. Quads stay as they are."""
    if "content" not in documents.columns:
        return documents
    form = F.coalesce(media.graph_format_column(F.col("media_type")), media.graph_format_column(rdf_syntax(F.col("content"))))
    text = documents.select("uri", F.col("content").cast("string").alias("content"), form.alias("form"))
    each = text.where("form in ('ntriples', 'nquads')").select("uri", F.explode(F.split("content", "\n")).alias("value"))
    nested = text.where("form not in ('ntriples', 'nquads')")
    names = F.create_map(*(F.lit(x) for k, v in media.GRAPH_FORMATS.items() for x in (v, k)))
    quads = rdf_text.documents(nested.select("uri", "content", F.element_at(names, F.col("form")).alias("media_type")), base=True)
    return rdf_text.lines(each, rdf_text.scope_of(F.col("uri"))).union(quads.select("g", "s", "p", "o"))


def _rows(result: Solutions | DataFrame, as_: str | None) -> tuple[str, DataFrame, tuple[str, str, str]]:
    """Format, rows and what goes around them, of solutions or triples."""
    if isinstance(result, Solutions):
        form = media.result_format(as_)
        return form, serialize.solution_rows(result, form), serialize.frame(form, result.variables)
    form = media.graph_format(as_) or "turtle"
    return form, *serialize.graph_rows(result.select(F.lit(None).cast(terms.TERM).alias("g"), "s", "p", "o"), form)


def write_answer(result: Solutions | DataFrame, uri: str, as_: str | None = None) -> str:
    """Writes solutions or triples as one document in a folder, by many tasks; its media type. Solutions are in ascending order of their text."""
    form, rows, around = _rows(result, as_)
    document_files.write(rows, around, uri)
    return media.canonical(form)


def answer(result: Solutions | DataFrame, as_: str | None = None) -> tuple[str, DataFrame]:
    """Media type and one text for solutions, an ASK's row (column answer) or triples; an unknown `as` falls back silently. The text is one task's work; write_answer writes large ones."""
    if not isinstance(result, Solutions) and result.columns == ["answer"]:
        form = media.result_format(as_)
        return media.canonical(form), result.select(serialize.boolean_document(F.col("answer"), form).alias("value"))
    form, rows, around = _rows(result, as_)
    return media.canonical(form), serialize.document(rows, around)
