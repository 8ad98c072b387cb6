import pytest
from pyspark.sql import functions as F

from quadloom.functions import media, sniff

NS = b"http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def at(place, mark, head=b"{"):
    """A mark whose first byte is at a place behind the leading white space."""
    return b" \t" + head + b" " * (place - len(head)) + mark


# Rule by rule, in the order in which the detectors go; each with the nearest inputs on either side of it.
CASES = [
    # signatures count at the very first byte, whole
    (b"%PDF-", "application/pdf"), (b"%PDF", "text/plain"), (b" %PDF-1.4", "text/plain"), (b"GIF87a\x00", "image/gif"), (b"GIF88a", "text/plain"), (b"\x1f\x8b", "application/gzip"), (b"\x1f", "text/plain"),
    (bytes.fromhex("FFD8FF"), "image/jpeg"), (bytes.fromhex("FFD8FE"), "application/octet-stream"), (bytes.fromhex("89504E470D0A1A0A00"), "image/png"), (bytes.fromhex("89504E470D0A1A"), "application/octet-stream"), (b"GIF89a{}", "image/gif"),
    # brackets are JSON, linked if a quoted keyword begins inside the window and ends there
    (b"[", "application/json"), (b'{"graph": "@graph"}', "application/ld+json"), (b"{'@id': 1}", "application/json"), (b'{"@ID": 1}', "application/json"), (b'[[{"@type": []}]]', "application/ld+json"), (b"{ not json @context", "application/json"),
    (at(2043, b'"@id"'), "application/ld+json"), (at(2044, b'"@id"'), "application/json"), (at(2041, b'"@graph"', b"["), "application/json"), (b"{ <html", "application/json"),
    # Turtle by its first byte, by a keyword and one space, or by an IRI with an authority in angle brackets
    (b"@", "text/turtle"), (b"#!/bin/sh", "text/turtle"), (b"pReFiX :", "text/turtle"), (b"prefixes", "text/plain"), (b"BASE <x>", "text/turtle"), (b"base\n<x>", "text/plain"), (b"Based on", "text/plain"), (b"prefix", "text/plain"),
    (b"<a://", "text/turtle"), (b"<a:/ /b>", "application/xml"), (b"<" + b"x" * 5000 + b"://y", "text/turtle"), (b"<x\x0c://", "application/xml"), (b"<x\x0b://", "text/turtle"), (b"<!--x://-->", "text/turtle"), (b"<tag y='z://'>", "application/xml"),
    # markup: HTML before RDF before XML, without regard to case, inside the window
    (b"<!DocType HTML SYSTEM 'x'>", "text/html"), (b"<x><HTML>" + NS, "text/html"), (b"<x>" + NS, "application/rdf+xml"), (b"<r xmlns='" + NS.upper() + b"'/>", "application/rdf+xml"), (b"<a><RDF:RDF", "application/rdf+xml"), (b"<RDF>", "application/xml"),
    (at(2043, b"<html", b"<x>"), "text/html"), (at(2044, b"<html", b"<x>"), "application/xml"), (b"<", "application/xml"), (b"<urn:isbn:1> <is> <mailto:a@b> .", "application/xml"), (b"<doctype html>", "application/xml"),
    # one byte order mark, then white space; vertical tabs are none
    (b"\xef\xbb\xbf\r\n\x0c\t [", "application/json"), (b"\xef\xbb\xbf\xef\xbb\xbf[", "text/plain"), (b"\r\xef\xbb\xbf[", "text/plain"), (b"\x0b@", "text/plain"), (b"\n\n<b>", "application/xml"),
    # what is left is text if it is UTF-8 throughout and has no NUL
    (b"", "text/plain"), (b" \n", "text/plain"), ("Ünïcode".encode(), "text/plain"), ("Ünïcode".encode("utf-16"), "application/octet-stream"), (b"x" * 9000 + b"\x00", "application/octet-stream"), (b"x" * 9000 + b"\xc3", "application/octet-stream"), (b"\xed\xa0\x80", "application/octet-stream"), (b"a:b c:d e:f .", "text/plain"), (b"_:x <p> 1 .", "text/plain"),
]


def test_media_types(spark):
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(CASES)] + [(99, None)], "k int, b binary")
    got = {r.k: r.m for r in df.select("k", sniff.sniff(F.col("b")).alias("m")).collect()}
    assert [got[k] for k in range(len(CASES))] == [m for _, m in CASES]
    assert got[99] is None


def test_plan_has_no_python(spark):
    df = spark.range(1).select(sniff.sniff(F.lit("x").cast("binary")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_more_detectors_go_first(spark):
    mine = [("zip", lambda v: F.when(F.startswith(v.raw, F.lit(b"PK")), "application/zip")), *sniff.DETECTORS]
    assert spark.range(1).select(sniff.sniff(F.lit(b"PK\x03"), mine)).first()[0] == "application/zip"


def test_rdf_syntax_keeps_the_byte_order_mark(spark):
    cases = [(b"\xef\xbb\xbf{}", "text/turtle"), (b" {}", "application/ld+json"), (b"<a>", "application/rdf+xml"), (b"<http://a>", "text/turtle"), (b"", "text/turtle")]
    df = spark.createDataFrame([(bytearray(b),) for b, _ in cases], "b binary")
    assert [r[0] for r in df.select(sniff.rdf_syntax(F.col("b"))).collect()] == [m for _, m in cases]


def test_formats():
    assert media.graph_format("ttl") == "turtle" and media.graph_format("text/turtle; charset=utf-8") == "turtle" and media.graph_format("TTL") is None
    assert media.result_format("application/nonsense") == "json" and media.result_format("text/csv") == "csv"
    assert media.target_format("text/html;x=y") == "html"
    for bad in ("html", "application/pdf"):
        with pytest.raises(ValueError, match="unknown target"):
            media.target_format(bad)
