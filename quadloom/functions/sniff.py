"""Media types of opaque bytes, as column expressions over BINARY.

A detector is a name and a function from a View to a column that is the media type
or null. The first that is not null wins; then valid UTF-8 without NUL is text and
anything else an octet stream. Pass a longer list to sniff to add detectors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by family.
TURTLE, RDF_XML, XML, JSON_LD, JSON = "text/turtle", "application/rdf+xml", "application/xml", "application/ld+json", "application/json"
HTML, PLAIN, OCTETS = "text/html", "text/plain", "application/octet-stream"
#: Leading bytes in hexadecimal.
MAGIC = {
    "255044462D": "application/pdf",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "474946383761": "image/gif",
    "474946383961": "image/gif",
    "1F8B": "application/gzip",
}
#: Quoted names that make JSON linked data.
LD_KEYS = ['"@context"', '"@id"', '"@graph"', '"@type"']
#: Bytes behind the leading white space in which keywords count.
WINDOW = 2048
#: Space, TAB, LF, FF and CR, but not VT.
BLANKS = r" \t\n\f\r"


class View(NamedTuple):
    """Bytes, and as Latin-1 (a character for each byte) what follows a byte order mark and white space."""

    raw: Column
    lead: Column

    @property
    def first(self) -> Column:
        return F.substring(self.lead, 1, 1)

    @property
    def window(self) -> Column:
        return F.substring(self.lead, 1, WINDOW)

    @property
    def names_iri(self) -> Column:
        """A leading <...> token with a scheme and authority."""
        return F.regexp_extract(self.lead, f"^<([^>{BLANKS}]*)", 1).contains("://")


def view(raw: Column) -> View:
    return View(raw, F.regexp_replace(F.decode(raw, "ISO-8859-1"), f"^(ï»¿)?[{BLANKS}]*", ""))


def magic(v: View) -> Column:
    out = F.lit(None).cast("string")
    for lead, media in MAGIC.items():
        out = F.coalesce(out, F.when(F.startswith(v.raw, F.unhex(F.lit(lead))), media))
    return out


def json(v: View) -> Column:
    linked = F.lit(False)
    for key in LD_KEYS:
        linked = linked | v.window.contains(key)
    return F.when(v.first.isin("{", "["), F.when(linked, JSON_LD).otherwise(JSON))


def turtle(v: View) -> Column:
    header = F.lower(F.substring(v.lead, 1, 7))
    return F.when(v.first.isin("@", "#") | v.names_iri | (header == "prefix ") | header.startswith("base "), TURTLE)


def markup(v: View) -> Column:
    low = F.lower(v.window)
    kind = F.when(low.startswith("<!doctype html") | low.contains("<html"), HTML).when(low.contains("<rdf:rdf") | low.contains("22-rdf-syntax-ns#"), RDF_XML).otherwise(XML)
    return F.when((v.first == "<") & ~v.names_iri, kind)


DETECTORS: list[tuple[str, Callable[[View], Column]]] = [("magic", magic), ("json", json), ("turtle", turtle), ("markup", markup)]


def is_text(raw: Column) -> Column:
    return ~F.contains(raw, F.unhex(F.lit("00"))) & F.is_valid_utf8(raw.cast("string"))


def sniff(raw: Column, detectors: list[tuple[str, Callable[[View], Column]]] | None = None) -> Column:
    """Media type of each value; null for null."""
    v = view(raw)
    found = [find(v) for _, find in (DETECTORS if detectors is None else detectors)]
    return F.when(raw.isNotNull(), F.coalesce(*found, F.when(is_text(raw), PLAIN), F.lit(OCTETS)))


def rdf_syntax(raw: Column) -> Column:
    """Linked-data syntax of a document known to be one: JSON-LD, RDF/XML, or Turtle. A byte order mark is not skipped."""
    v = View(raw, F.regexp_replace(F.decode(raw, "ISO-8859-1"), f"^[{BLANKS}]*", ""))
    return F.when(v.first.isin("{", "["), JSON_LD).when((v.first == "<") & ~v.names_iri, RDF_XML).otherwise(TURTLE)
