"""Graph files: ranges of large ones against the whole-document readers, folders of mixed syntaxes, streams of events."""

import io
import random
import re
import tracemalloc

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.plans import dataset
from quadloom.sources import graph_files, rdf_text

TURTLE = '''# begins with a comment . @prefix no: <http://no/> .
@prefix e: <http://e/> .
PREFIX f: <f/>
e:s e:p "dot . \\" in text . " , 'single . \\' <x> ', """long . "quoted" . \n# no comment . """, \'\'\'also . '' . \'\'\' ; e:q 1.5 , .5 , 2. # a comment . "
<http://h/a.b#c> e:p <http://i/.> .
e:s f:p [ e:q "nested . " ; e:r ( 1 2.5 "x . " [ e:t e:u ] ) ] .
[] e:p <o>.e:x e:p e:o .
@base <http://base/> .
<rel> a <#frag> ; e:esc e:O\\'Neil\\.x , "ü 東京 𝄞"@de-AT , "5"^^e:t .
@prefix e: <http://other/> .
e:late e:p _:shared .
BASE <deeper/>
<again> e:p _:shared , "\\u00e9 ." .
'''
TRIG = TURTLE + '''
e:g { e:a e:p e:b . e:c e:p "in . block" . e:d e:p _:shared } e:outside e:p e:o .
GRAPH <named> { e:a e:p e:b ; e:q [ e:r e:t ] . e:c e:p e:d . e:e e:p e:f }
{ e:default e:p e:o . e:default e:q e:o . }
[] { e:anonymous e:p e:one . e:anonymous e:p e:two . }
_:graph { e:x e:p e:y . e:z e:p e:w . }
'''


class Text:
    """A file in memory, and how much of it was read at a time."""

    def __init__(self, text):
        self.data, self.most = text.encode(), 0

    def read_at(self, n, at):
        self.most = max(self.most, n)
        return self.data[at : at + n]


def shape(quads):
    """Quads as text; blank nodes without a label by what is said of and with them."""
    quads = list(quads)
    named = lambda t: t is None or t[0] != 1 or not re.search(r"-(r\d+-)?x\d+$", t[1])
    around = {}
    for _ in range(4):
        told = lambda t: repr(t) if named(t) else f"[{around.get(t[1], '')}]"
        fresh = {}
        for g, s, p, o in quads:
            if not named(s):
                fresh.setdefault(s[1], []).append(f"{p[1]} {told(o)}")
            if not named(o):
                fresh.setdefault(o[1], []).append(f"{told(s)} {p[1]}")
            if not named(g):
                fresh.setdefault(g[1], []).append("graph")
        around = {k: " ".join(sorted(v)) for k, v in fresh.items()}
    return sorted(" ".join(repr(t) if named(t) else f"[{around[t[1]]}]" for t in q) for q in quads)


@pytest.mark.parametrize("span", [1, 40, 200, 10**9])
@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
@pytest.mark.parametrize("text", [TURTLE, TRIG], ids=["turtle", "trig"])
def test_ranges_equal_the_whole(monkeypatch, tmp_path, text, span, piece):
    monkeypatch.setattr(graph_files, "PIECE", piece)
    kind = "application/trig" if text is TRIG else "text/turtle"
    base = f"file:{tmp_path}/x"
    (tmp_path / "x").write_text(text)
    whole = shape(rdf_text._Turtle(text, rdf_text.scope_name(base), base).run())
    found = list(graph_files.ranges(Text(text), len(text.encode()), base, span))
    assert [f["start"] for f in found] == [0, *(f["end"] for f in found[:-1])] and found[-1]["end"] == len(text.encode())
    assert len(found) >= {1: 8, 40: 6, 200: 3, 10**9: 1}[span]
    import json

    reader = graph_files.GraphReader({"index": ""})
    parts = [q for f in found for q in reader.quads(base, kind, f["start"], f["end"], json.dumps({k: v for k, v in f.items() if k not in ("start", "end")}))]
    assert shape(parts) == whole


def test_ranges_of_random_statements(tmp_path):
    rng = random.Random(4)
    parts, n = ["@prefix e: <http://e/> .\n"], 0
    bits = ["e:a", "<http://x/y.z>", '"a . b"', "'''x\n. '''", "1.5", "[ e:p (1 2) ]", "_:l", '"q\\" ."@en', "true", "-2", "e:a.b", "(e:x . )".replace(" . ", " ")]
    for _ in range(400):
        if rng.random() < 0.05:
            n += 1
            parts.append(rng.choice([f"@prefix e: <http://e{n}/> .", f"prefix e: <http://e{n}/>", f"base <http://b{n}/>", f"@base <b{n}/> ."]) + rng.choice(["\n", " ", " # c .\n"]))
        parts.append(f"e:s{rng.randrange(9)} e:p {rng.choice(bits)} , {rng.choice(bits)} ; e:q {rng.choice(bits)}{rng.choice([' .', '.'])}{rng.choice([chr(10), ' ', ' # . ' + chr(10)])}")
    text = "".join(parts)
    (tmp_path / "x").write_text(text)
    base = f"file:{tmp_path}/x"
    import json

    reader = graph_files.GraphReader({"index": ""})
    found = list(graph_files.ranges(Text(text), len(text), base, 300))
    assert len(found) > 40
    got = [q for f in found for q in reader.quads(base, "text/turtle", f["start"], f["end"], json.dumps({k: v for k, v in f.items() if k not in ("start", "end")}))]
    assert shape(got) == shape(rdf_text._Turtle(text, rdf_text.scope_name(base), base).run())


def folder(tmp_path):
    rows = {"a.ttl": "@prefix e: <http://e/> . " + " ".join(f"e:s{k} e:p {k} ; e:q 'x' ." for k in range(300)), "b.nt": "<urn:s> <http://e/p> _:b .\n_:b <http://e/q> <urn:o> .\n", "sub/c.nq": '# c\n<urn:s> <http://e/p> "v"@en <urn:g> .\n\n', "d.trig": "<urn:g> { <urn:t> <http://e/p> 1 }", "e.rdf": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description rdf:about="urn:x"><e:p>t</e:p></rdf:Description></rdf:RDF>', "f.jsonld": '{"@id": "urn:j", "http://e/p": 7}', "empty.ttl": "", "empty.nt": ""}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in rows.items():
        (tmp_path / "in" / name).write_text(text)
    return f"file:{tmp_path}/in"


@pytest.mark.parametrize("span", [500, 16 << 20])
def test_a_folder_of_mixed_syntaxes(spark, tmp_path, span):
    uri = folder(tmp_path)
    got = graph_files.load(spark, uri, span=span).collect()
    by = lambda end: [r for r in got if r.uri.endswith(end)]
    assert len(by("a.ttl")) == 600 and len(by("b.nt")) == 2 and len(by("e.rdf")) == len(by("f.jsonld")) == 1
    assert [(r.g.lex, r.o.lang) for r in by("c.nq")] == [("urn:g", "en")] and [r.g.lex for r in by("d.trig")] == ["urn:g"] and len(got) == 606
    only = graph_files.load(spark, uri, predicates=["http://e/q"], span=span).collect()
    assert len(only) == 301 and {r.p.lex for r in only} == {"http://e/q"}
    assert graph_files.load(spark, uri, predicates=[], span=span).count() == 0
    if span == 500:
        assert graph_files.index(spark, uri, span).where("path like '%a.ttl'").count() > 10
    (tmp_path / "in" / "g.bin").write_text("x")
    with pytest.raises(Exception, match="no graph syntax"):
        graph_files.load(spark, uri)


def test_a_dataset_reads_folders(spark, tmp_path):
    uri = folder(tmp_path)
    every = dataset.Dataset(spark).quads(uri, vocabulary=False)
    assert every.count() == 606 and every.where("g.lex = 'urn:g'").count() == 2
    one = dataset.Dataset(spark).quads(f"{uri}/sub/c.nq", vocabulary=False).first()
    assert (one.s.lex, one.o.lex) == ("urn:s", "v")


HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://h/">'


def test_rdf_xml_by_events_keeps_little():
    """Many descriptions, and one that nests many: memory stays with what is open."""
    for make in (lambda k: f'<rdf:Description rdf:about="s{k}"><e:p>text {k}</e:p><e:q rdf:parseType="Literal">a<b>c</b></e:q></rdf:Description>', lambda k: f"<e:p><rdf:Description><e:q>{k}</e:q></rdf:Description></e:p>"):
        nested = "<e:p>" in make(0)[:6]

        class Endless(io.RawIOBase):
            def __init__(self, n):
                self.n, self.k, self.rest = n, 0, (HEAD + ('<rdf:Description rdf:about="one">' if nested else "")).encode()

            def read(self, size=-1):
                while len(self.rest) < size and self.k <= self.n:
                    self.rest += (make(self.k) if self.k < self.n else ("</rdf:Description>" if nested else "") + "</rdf:RDF>").encode()
                    self.k += 1
                out, self.rest = self.rest[:size], self.rest[size:]
                return out

        peaks = []
        for n in (2_000, 20_000):
            tracemalloc.start()
            count = sum(1 for _ in rdf_text.stream_rdf_xml(Endless(n), "d-"))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert count == 2 * n
        assert peaks[1] < 1.5 * peaks[0] + 500_000


def test_rdf_xml_in_pieces_equals_the_whole():
    body = "".join(f'<e:T rdf:about="x{k}" e:a="v" xml:lang="EN"><e:p rdf:ID="i{k}">ü{k}</e:p><rdf:li>1</rdf:li><rdf:li rdf:parseType="Collection"><e:U/><rdf:Description rdf:about="y"><e:q rdf:parseType="Resource"><e:r>2</e:r><rdf:li>3</rdf:li></e:q></rdf:Description></rdf:li><e:l rdf:parseType="Literal">a<e:b e:c="d">e</e:b>f</e:l></e:T>' for k in range(5))
    text = f"{HEAD}{body}</rdf:RDF>"
    whole = list(rdf_text._RdfXml(text, "d-").run())
    assert len(whole) == 5 * (2 + 5 + 1 + 1 + 4 + 1 + 3 + 1)
    for piece in (1, 3, 50):
        assert list(rdf_text.stream_rdf_xml(io.BytesIO(text.encode()), "d-", piece=piece)) == whole
    for wrong in (text[:-4], text.replace("</e:l>", "</e:m>")):
        with pytest.raises(Exception, match="."):
            list(rdf_text.stream_rdf_xml(io.BytesIO(wrong.encode()), "d-"))


def test_documents_by_many_tasks(spark, tmp_path):
    """Order, head and tail, parts of attempts that did not count, no rows at all."""
    from quadloom.sources import document_files

    rows = spark.range(500).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("value")).repartition(7)
    place = f"file:{tmp_path}/doc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's
    try:
        document_files.write(rows, ("[{count}|", ",", "]"), place)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (tmp_path / "doc" / "part-000000-of-another-attempt").write_text("99999")
    want = "[500|" + ",".join(f"{k:05d}" for k in range(500)) + "]"
    assert b"".join(document_files.stream(place, piece=7)).decode() == want and len(document_files.told(place)["parts"]) > 1
    document_files.join(place, f"file:{tmp_path}/one")
    assert (tmp_path / "one").read_text() == want
    got = document_files.read(spark, place).orderBy("n").collect()
    assert [r.value for r in got] == ["[500|", *(f"{k:05d}" for k in range(500)), "]"] and [r.n for r in got] == list(range(502))
    document_files.write(rows.limit(0), ("n\r\n", "\r\n", "\r\n"), f"file:{tmp_path}/none")
    assert b"".join(document_files.stream(f"file:{tmp_path}/none")) == b"n\r\n" and document_files.read(spark, f"file:{tmp_path}/none").count() == 2
