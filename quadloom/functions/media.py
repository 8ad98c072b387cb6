"""Media types, their aliases, and formats for results and graphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Graph formats by media type, and their aliases.
GRAPH_FORMATS = {
    "text/turtle": "turtle", "application/n-triples": "ntriples", "application/n-quads": "nquads",
    "application/trig": "trig", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld",
}
GRAPH_ALIASES = {
    "turtle": "turtle", "ttl": "turtle", "ntriples": "ntriples", "nt": "ntriples", "n-triples": "ntriples",
    "nquads": "nquads", "nq": "nquads", "n-quads": "nquads", "trig": "trig",
    "rdfxml": "rdfxml", "rdf/xml": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld", "json-ld": "jsonld", "json": "jsonld",
}
#: Result formats by media type, and their aliases.
RESULT_FORMATS = {"application/sparql-results+json": "json", "application/sparql-results+xml": "xml", "text/csv": "csv", "text/tab-separated-values": "tsv"}
RESULT_ALIASES = {"json": "json", "xml": "xml", "csv": "csv", "tsv": "tsv"}
HTML = "text/html"


def base(spec: str) -> str:
    """The media type without parameters."""
    return spec.split(";", 1)[0].strip()


def base_column(spec: Column) -> Column:
    return F.trim(F.split_part(spec, F.lit(";"), F.lit(1)))


def graph_format(spec: str | None) -> str | None:
    return GRAPH_FORMATS.get(base(spec or "")) or GRAPH_ALIASES.get(base(spec or ""))


def graph_format_column(spec: Column) -> Column:
    """graph_format of a column; null for what it does not know."""
    known = F.create_map(*(F.lit(x) for pair in (GRAPH_FORMATS | GRAPH_ALIASES).items() for x in pair))
    return F.try_element_at(known, base_column(spec))


def result_format(spec: str | None, default: str = "json") -> str:
    """What a query's `as` asks for; anything unknown falls back silently."""
    return RESULT_FORMATS.get(base(spec or "")) or RESULT_ALIASES.get(base(spec or ""), default)


def target_format(spec: str) -> str:
    """What a conversion's `as` asks for; unknown targets are an error. HTML goes by its media type alone."""
    if base(spec) == HTML:
        return "html"
    if found := graph_format(spec):
        return found
    raise ValueError(f"unknown target `{spec}`: one of {', '.join([*GRAPH_FORMATS, HTML])}")


def canonical(form: str) -> str:
    """Media type of a format."""
    return {v: k for k, v in (GRAPH_FORMATS | RESULT_FORMATS).items()}[form]
