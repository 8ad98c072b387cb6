"""Conversions between media types: a registry of edges, chains over them, and dispatch by sniffing.

A converter takes documents (uri, content binary, media_type) and a target type and
returns such documents. Chains are chosen on the driver from the few types there are;
all content stays in DataFrames.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import media
from quadloom.functions.sniff import JSON_LD, OCTETS, RDF_XML, TURTLE, rdf_syntax, sniff
from quadloom.operators import serialize
from quadloom.operators.paths import ensure_checkpoints
from quadloom.sources import rdf_text

Converter = Callable[[DataFrame, str], DataFrame]

#: Media types that the graph converter reads and writes; HTML is only written.
READS = [*media.GRAPH_FORMATS, OCTETS]
WRITES = [*media.GRAPH_FORMATS, media.HTML]


class Registry:
    """Edges from media type to media type, in order of registration."""

    def __init__(self) -> None:
        self.edges: dict[str, list[tuple[str, Converter]]] = {}

    def register(self, sources: list[str], targets: list[str], converter: Converter) -> Registry:
        for source in sources:
            self.edges.setdefault(source, []).extend((t, converter) for t in targets if t != source)
        return self

    def chain(self, source: str, target: str) -> list[tuple[str, Converter]] | None:
        """Steps of a shortest chain, the first registered one of several; None without any."""
        queue, seen = deque([(source, [])]), {source}
        while queue:
            at, steps = queue.popleft()
            if at == target:
                return steps
            for to, converter in self.edges.get(at, []):
                if to not in seen:
                    seen.add(to)
                    queue.append((to, [*steps, (to, converter)]))
        return None

    def pairs(self) -> list[tuple[str, str, int]]:
        """(source, target, steps) of everything that can be reached."""
        every = sorted({*self.edges, *(t for v in self.edges.values() for t, _ in v)})
        return [(a, b, len(c)) for a in every for b in every if (c := self.chain(a, b)) is not None]


def convert_graphs(documents: DataFrame, to: str) -> DataFrame:
    """Graph documents in another syntax; their own is sniffed. One text row for each document, its statements in order.

    A document without statements gives an empty one, and rows that share a uri stay apart.
    """
    form = media.target_format(to)
    text = documents.withColumn("media_type", rdf_syntax(F.col("content"))).withColumn("content", F.col("content").cast("string"))
    quads = rdf_text.documents(text, keep=True)
    return _per_document(quads, form).select("uri", F.col("value").cast("binary").alias("content"), F.lit(media.base(to)).alias("media_type"))


def _per_document(quads: DataFrame, form: str) -> DataFrame:
    """(uri, value): the serialisation of each document's quads; rows without a quad stand for the document alone."""
    cells = {"ntriples": ("s", "p", "o"), "nquads": ("s", "p", "o", "g")}.get(form)
    if cells:
        line = F.when(F.col("s").isNotNull(), F.concat_ws(" ", *(serialize.terms.n_triples(F.col(c)) for c in cells), F.lit(".")))
        whole = F.array_join(F.array_sort(F.collect_list(F.concat(line, F.lit("\n")))), "")
    elif form == "html":
        whole = serialize.html_table(F.col("s"), serialize.html_row())
    else:
        # nested syntaxes group by subject first: the document rides along as part of the key
        return serialize.grouped(quads, form)
    return quads.groupBy("doc", "uri").agg(whole.alias("value")).drop("doc")


def default_registry() -> Registry:
    return Registry().register(READS, WRITES, convert_graphs)


def auto(documents: DataFrame, to: str = TURTLE, registry: Registry | None = None) -> DataFrame:
    """Sniffs documents (uri, content) and sends each type down its chain; those of the target type pass unchanged.

    Types without a chain, and null contents, are an error that names both ends. Types compare
    as exact text. Content is sniffed once: the typed documents go to the checkpoint folder, where the
    list of types and every branch read them.
    """
    registry = registry or default_registry()
    ensure_checkpoints(documents)
    typed = documents.select("uri", "content", sniff(F.col("content")).alias("media_type")).checkpoint()
    branches = []
    for source in sorted((r[0] for r in typed.select("media_type").distinct().collect()), key=str):
        steps = None if source is None else registry.chain(source, to)
        if steps is None:
            raise ValueError(f"no conversion from sniffed `{source}` to `{to}`")
        branch = typed.where(F.col("media_type") == source)
        for target, converter in steps:
            branch = converter(branch, target)
        branches.append(branch)
    return reduce(lambda a, b: a.unionByName(b), branches) if branches else typed


def reachable(media_type: Column, to: str, registry: Registry | None = None) -> Column:
    """Steps from each media type to `to`; null where there is no chain."""
    steps = {a: n for a, b, n in (registry or default_registry()).pairs() if b == to} | {to: 0}
    known = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))
    return F.try_element_at(known, media_type)


#: Syntaxes that sniffing tells apart; the others need their media type.
SNIFFED = [TURTLE, RDF_XML, JSON_LD]
