"""Reading, writing and converting graphs; datasets; catalog; cache; streams."""

import pytest
from pyspark.sql import functions as F

from quadloom.functions import media, terms
from quadloom.operators import paths, quads, serialize
from quadloom.plans import cache, catalog, convert, dataset
from quadloom.sources import rdf_text
from quadloom.streaming import graphs

#: Sea marks: 13 triples with numbers, two languages, a blank node, a datatype of its own and a list.
SEA = "http://sea.example/terms/"
MARKS = f'''@prefix m: <{SEA}> .
@base <http://sea.example/mark/> .
<skerry> m:depth 12.5 , 7 ; m:called "Skerry"@en , "Schäre"@de ; m:neighbour [ m:called "Holm"@en ; m:since "1904"^^m:year ] ; m:tides ( "low" "high" ) .
<holm> m:fedBy <skerry> .
'''


def docs(spark, *texts):
    return spark.createDataFrame([(f"u{k}", bytearray(t.encode())) for k, t in enumerate(texts)], "uri string, content binary")


def text(df):
    return bytes(df.first().content).decode()


def test_turtle_to_lines_and_html(spark):
    lines = [x for x in text(convert.convert_graphs(docs(spark, MARKS), "nt")).split("\n") if x]
    assert len(lines) == 13 and f'<http://sea.example/mark/skerry> <{SEA}depth> "12.5"^^<{terms.DECIMAL}> .' in lines
    assert f"<http://sea.example/mark/holm> <{SEA}fedBy> <http://sea.example/mark/skerry> ." in lines and sum(x.startswith("_:") for x in lines) == 6
    html = text(convert.convert_graphs(docs(spark, MARKS), media.HTML))
    assert "<caption>13 triples</caption>" in html and html.count("<tr>") == 14 and f"<td>&lt;{SEA}fedBy&gt;</td>" in html and '<td>"Schäre"@de</td>' in html
    with pytest.raises(ValueError, match="unknown target"):
        convert.convert_graphs(docs(spark, MARKS), "application/msword")


RICH = '''PREFIX ex: <http://ex/>
ex:me a ex:Person ; ex:name "A\\"d\\na"@EN-gb, """long "text" """ ; ex:n 1, -2.5, 3e0, true, "5"^^ex:t ; ex:list (1 ex:x) ; ex:knows [ ex:age 4 ] .
_:b ex:p _:b , <#frag> .'''


def triples(df):
    return sorted(map(repr, df.select("s", "p", "o").collect()))


@pytest.mark.parametrize("to", ["text/turtle", "application/rdf+xml", "application/ld+json", "application/n-triples"])
def test_round_trips_keep_every_triple(spark, to):
    source = convert.convert_graphs(docs(spark, RICH.replace(", <#frag>", "")), to).withColumn("uri", F.lit("v"))
    once = text(convert.convert_graphs(docs(spark, RICH.replace(", <#frag>", "")), "nt"))
    again = text(convert.convert_graphs(source.select("uri", "content"), "nt"))
    shape = lambda t: sorted(__import__("re").sub(r"_:\S+", "_:x", line) for line in t.split("\n") if line)
    assert shape(once) == shape(again) and len(shape(once)) == 16


def test_documents_without_statements_and_of_one_uri_stay(spark):
    rows = [("a", "# nothing"), ("a", '<http://s> <http://p> _:x .'), ("a", '<http://t> <http://p> _:x .'), ("b", ""), ("b", "")]
    df = spark.createDataFrame([(u, bytearray(t.encode())) for u, t in rows], "uri string, content binary").repartition(3)
    for to in ("text/turtle", "application/trig", "application/rdf+xml", "application/ld+json", "nt", "nq", "text/html"):
        made = convert.convert_graphs(df, to).collect()
        assert sorted(r.uri for r in made) == ["a", "a", "a", "b", "b"], to
        back = [bytes(r.content).decode() for r in made]
        assert sum("http://s" in t for t in back) == sum("http://t" in t for t in back) == 1 and not any("http://s" in t and "http://t" in t for t in back)
    assert sum("<caption>0 triples" in t for t in back) == 3
    assert convert.convert_graphs(df.limit(0), "nt").count() == 0


def read(spark, text, media, base=""):
    """Triples of a document as text, its blank nodes numbered by first use in order of predicate and object."""
    reader = rdf_text.READERS[media](text, "", base)
    return sorted((reader_text(s), p[1].rsplit("#", 1)[-1].rsplit("/", 1)[-1], reader_text(o)) for _, s, p, o in reader.run())


def reader_text(t):
    return t[1] if t[0] == 2 else "_" if t[0] == 1 else f"{t[1]}@{t[3]}" if t[3] else f"{t[1]}^{t[2].rsplit('#', 1)[-1]}"


def lists(found):
    """The values of rdf:first in any order, and how many cells end a list."""
    return sorted(o for _, p, o in found if p == "first"), sum(o.endswith("#nil") for _, p, o in found if p == "rest")


RDF_HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://h/a/b">'


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<e:T rdf:about="x"><e:p rdf:resource="../y"/></e:T>', [("http://h/a/x", "p", "http://h/y"), ("http://h/a/x", "type", "http://e/T")]),
        ('<rdf:Description rdf:ID="i" e:q="v" rdf:type="http://e/U" xml:lang="EN"/>', [("http://h/a/b#i", "q", "v@en"), ("http://h/a/b#i", "type", "http://e/U")]),
        ('<rdf:Description rdf:about=""><e:p rdf:nodeID="n"/><e:q e:r="1"/></rdf:Description>', [("_", "r", "1^string"), ("http://h/a/b", "p", "_"), ("http://h/a/b", "q", "_")]),
        ('<rdf:Bag rdf:about="x"><rdf:li>1</rdf:li><rdf:li rdf:resource="y"/></rdf:Bag>', [("http://h/a/x", "_1", "1^string"), ("http://h/a/x", "_2", "http://h/a/y"), ("http://h/a/x", "type", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag")]),
        ('<rdf:Description rdf:about="x"><e:p rdf:parseType="Literal">a<b>c</b></e:p></rdf:Description>', [("http://h/a/x", "p", "a<b>c</b>^XMLLiteral")]),
        ('<rdf:Description rdf:about="x"><e:p rdf:parseType="Resource"><e:q>1</e:q></e:p></rdf:Description>', [("_", "q", "1^string"), ("http://h/a/x", "p", "_")]),
        ('<rdf:Description rdf:about="x"><e:p rdf:ID="s" rdf:datatype="http://e/#t">1</e:p></rdf:Description>', [("http://h/a/b#s", "object", "1^t"), ("http://h/a/b#s", "predicate", "http://e/p"), ("http://h/a/b#s", "subject", "http://h/a/x"), ("http://h/a/b#s", "type", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement"), ("http://h/a/x", "p", "1^t")]),
    ],
)
def test_rdf_xml_statements(spark, body, want):
    assert read(spark, f"{RDF_HEAD}{body}</rdf:RDF>", "application/rdf+xml") == want


def test_collections_of_every_syntax(spark):
    xml = f'{RDF_HEAD}<rdf:Description rdf:about="x"><e:p rdf:parseType="Collection"><e:T rdf:about="1"/><rdf:Description rdf:about="2"/><rdf:Description rdf:about="3"/></e:p><e:q rdf:parseType="Collection"/></rdf:Description></rdf:RDF>'
    found = read(spark, xml, "application/rdf+xml")
    assert lists(found) == (["http://h/a/1", "http://h/a/2", "http://h/a/3"], 1) and ("http://h/a/x", "q", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil") in found and len(found) == 9
    json = '{"@id": "http://x", "http://p": {"@list": [1, "a", {"@id": "http://y"}, {"@list": []}]}, "http://q": {"@list": []}}'
    found = read(spark, json, "application/ld+json")
    assert lists(found) == (["1^integer", "a^string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", "http://y"], 1) and len(found) == 10
    for bad in ('<e:T rdf:about="x"><rdf:Description/></e:T>', '<rdf:li rdf:about="x"/>', '<e:T rdf:about="x"><e:p><e:A/><e:B/></e:p></e:T>', '<e:T rdf:about="x" rdf:li="1"/>'):
        with pytest.raises(ValueError, match="."):
            read(spark, f"{RDF_HEAD}{bad}</rdf:RDF>", "application/rdf+xml")


@pytest.mark.parametrize(
    ("context", "body", "want"),
    [
        ('{"@base": "http://h/a/", "@vocab": "http://v/", "@language": "DE"}', '"@id": "../x", "p": "w", "q": {"@value": "u"}, "r": {"@value": "f", "@language": "fr"}', [("http://h/x", "p", "w@de"), ("http://h/x", "q", "u^string"), ("http://h/x", "r", "f@fr")]),
        ('{"id": "@id", "type": "@type", "e": "http://e/"}', '"id": "e:s", "type": ["e:T"], "e:p": {"id": "e:o"}', [("http://e/s", "p", "http://e/o"), ("http://e/s", "type", "http://e/T")]),
        ('{"e": "http://e/", "child": {"@reverse": "e:parent"}}', '"@id": "e:s", "child": [{"@id": "e:a"}, "e:b"], "@reverse": {"e:of": {"@id": "e:c"}}', [("http://e/a", "parent", "http://e/s"), ("http://e/b", "parent", "http://e/s"), ("http://e/c", "of", "http://e/s")]),
        ('{"e": "http://e/", "l": {"@id": "e:l", "@container": "@language"}, "s": {"@id": "e:s", "@container": "@set"}, "i": {"@id": "e:i", "@container": "@index"}}', '"@id": "e:x", "l": {"en": "a", "de": ["b", "c"]}, "s": [1, 2], "i": {"k": 3}', [("http://e/x", "i", "3^integer"), ("http://e/x", "l", "a@en"), ("http://e/x", "l", "b@de"), ("http://e/x", "l", "c@de"), ("http://e/x", "s", "1^integer"), ("http://e/x", "s", "2^integer")]),
        ('{"e": "http://e/", "d": {"@id": "e:d", "@type": "http://www.w3.org/2001/XMLSchema#date"}, "n": {"@id": "e:n", "@language": null}, "@language": "en"}', '"@id": "e:x", "d": "2020-01-01", "n": "plain", "e:f": [1.5, true, 10.0, null]', [("http://e/x", "d", "2020-01-01^date"), ("http://e/x", "f", "1.5E0^double"), ("http://e/x", "f", "10^integer"), ("http://e/x", "f", "true^boolean"), ("http://e/x", "n", "plain^string")]),
    ],
)
def test_json_ld_statements(spark, context, body, want):
    assert read(spark, f'{{"@context": {context}, {body}}}', "application/ld+json") == want


@pytest.mark.parametrize("body", ['"@context": "http://c/x"', '"@context": {"@propagate": false}', '"@context": {"t": {"@id": "http://t", "@nest": "n"}}, "t": 1', '"http://p": {"@nest": 1, "@id": "http://x"}', '"@context": {"t": {"@id": "http://t", "@container": "@id"}}, "t": {"a": 1}'])
def test_json_ld_that_is_not_supported_is_an_error(spark, body):
    with pytest.raises(ValueError, match="."):
        read(spark, f"{{{body}}}", "application/ld+json")


def test_blank_nodes_are_scoped_by_document(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.nt").write_text(f'_:x <http://p> "{name}" .\n_:x <http://q> _:y .\n')
        (tmp_path / f"{name}.ttl").write_text(f'_:x <http://p> "{name}" .')
    data = dataset.Dataset(spark)
    lines = data.quads(f"file://{tmp_path}/a.nt file://{tmp_path}/b.nt", vocabulary=False)
    assert lines.count() == 4 and lines.select("s").distinct().count() == 2 and lines.where("p.lex = 'http://q'").select("o").distinct().count() == 2
    nested = data.quads(f"file://{tmp_path}/a.ttl file://{tmp_path}/b.ttl", vocabulary=False)
    assert nested.select("s").distinct().count() == 2
    held = spark.createDataFrame([("u1", b'_:x <http://p> "1" .', "nt"), ("u2", b'_:x <http://p> "2" .', "nt")], "uri string, content binary, media_type string")
    assert dataset.Dataset(spark).resolver("m", lambda s, u: held).quads("m:x", vocabulary=False).select("s").distinct().count() == 2
    assert "_metadata.row_index" not in str(data.graph(f"file://{tmp_path}/a.nt").columns)


def test_trig_and_quads_keep_graphs(spark):
    trig = "@prefix e: <http://e/> . e:g { e:a e:b e:c . } e:a e:b e:d . GRAPH <http://h> { e:x e:y 'z' }"
    df = spark.createDataFrame([("u", trig, "application/trig")], "uri string, content string, media_type string")
    got = rdf_text.documents(df)
    assert sorted(str(r.g and r.g.lex) for r in got.collect()) == ["None", "http://e/g", "http://h"]
    assert triples(rdf_text.lines(serialize.n_quads(got))) == triples(got)
    with pytest.raises(Exception, match="named graph"):
        serialize.n_triples(serialize.require_default(got)).collect()


def test_lines_escapes_and_errors(spark):
    lines = ['<http://a> <http://b> "x\\u00e9\\U0001F600\\\\n\\t" . # end', "", "# only a note", "_:x <http://b> _:y <http://g> .", '<http://a> <http://b> "5"^^<http://t> .', '<http://a> <http://b> "v"@en-GB .', '<http://a> <http://b> "' + "q" * 300_000 + '" .']
    got = rdf_text.lines(spark.createDataFrame([(x,) for x in lines], "value string"), "s-").collect()
    assert [r.o.lex if len(r.o.lex) < 99 else "long" for r in got] == ["xé😀\\n\t", "s-y", "5", "v", "long"] and got[1].g.lex == "http://g" and got[3].o.lang == "en-gb"
    bad = spark.createDataFrame([("nonsense",)], "value string")
    assert rdf_text.lines(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="no statement"):
        rdf_text.lines(bad).collect()


def test_escapes_of_lines(spark):
    """Noncharacters, escaped escapes and points in IRIs; expected values are written by hand."""
    text = {
        r'<http://h/\u00E9> <http://h/p> "\ufdd0 \uFDD1\\n" .'.replace("\\ufdd0", "\ufdd0"): ("http://h/é", "\ufdd0 \ufdd1\\n"),
        r'<http://h/a> <http://h/p> "\u005Cu0041\U0001F600\t\"\'" .': ("http://h/a", "\\u0041😀\t\"'"),
        r'<http://h/b> <http://h/p> "x"^^<http://h/\u0064> .' + "\r\n": ("http://h/b", "x"),
    }
    got = {(q.s.lex, q.o.lex) for q in rdf_text.lines(spark.createDataFrame([(x,) for x in text], "value string")).collect()}
    assert got == set(text.values())
    bad = [r'<http://h/a> <http://h/p> "\x" .', r"<http://h/\n> <http://h/p> <http://h/a> .", '<http://h/a> <http://h/p> "a" .\n<http://h/a> <http://h/p> "b" .', "\n".join("a" * 10)]
    assert rdf_text.lines(spark.createDataFrame([(x,) for x in bad], "value string"), strict=False).count() == 0



def test_strict_documents_fail_and_lenient_ones_keep_what_was_read(spark):
    df = spark.createDataFrame([("u", "<http://a> <http://b> <http://c> . broken", "text/turtle")], "uri string, content string, media_type string")
    assert rdf_text.documents(df, strict=False).count() == 1
    with pytest.raises(Exception, match="cannot be read"):
        rdf_text.documents(df).collect()
    remote = spark.createDataFrame([("u", '{"@context": "http://c/x", "@id": "http://a"}', "application/ld+json")], "uri string, content string, media_type string")
    with pytest.raises(Exception, match="remote context"):
        rdf_text.documents(remote).collect()


ODD = ["a\r\nb\rc\n", "tab\tand \"quotes\" \\ back", "<&>' ünï 𝄞", " lead and trail ", ""]


@pytest.mark.parametrize("to", ["text/turtle", "application/trig", "application/rdf+xml", "application/ld+json", "application/n-triples", "application/n-quads"])
def test_no_character_is_lost(spark, to):
    """Carriage returns, escapes, labels beyond ASCII and IRIs with characters that need escapes."""
    term = lambda k, x, dt=None: (k, x, dt, None)
    rows = [(term(1, "é·1:x.y"), term(2, f"http://e/p{n}"), term(3, x, terms.STRING)) for n, x in enumerate(ODD)] + [(term(2, "http://e/s"), term(2, "http://e/q"), term(2, "http://e/a b>c" if "xml" not in to and "json" not in to else "http://e/é"))]
    df = spark.createDataFrame(rows, "s struct<kind:tinyint,lex:string,dt:string,lang:string>, p struct<kind:tinyint,lex:string,dt:string,lang:string>, o struct<kind:tinyint,lex:string,dt:string,lang:string>")
    if to == "application/rdf+xml":
        df = df.withColumn("s", F.when(F.col("s.kind") == 1, terms.blank(F.lit("é1"))).otherwise(F.col("s")))
    one = dataset.answer(df.select("s", "p", "o"), to)[1].first().value
    back = rdf_text.documents(spark.createDataFrame([("u", one, to)], "uri string, content string, media_type string")) if to in rdf_text.READERS else rdf_text.lines(spark.createDataFrame([(x,) for x in one.split("\n")], "value string"))
    got = back.select("s", "p", "o").collect()
    assert sorted((r.p.lex, r.o.lex) for r in got) == sorted((p[1], o[1]) for _, p, o in rows)
    assert len({r.s.lex for r in got if r.s.kind == 1}) == 1


def test_xml_refuses_what_it_cannot_write(spark):
    df = spark.range(1).select(terms.iri("urn:s").alias("s"), terms.iri("http://e/p").alias("p"), terms.literal(F.lit("a\x01b")).alias("o"))
    with pytest.raises(Exception, match="no XML"):
        dataset.answer(df, "application/rdf+xml")[1].collect()


def test_labels_of_lines(spark):
    good = ["_:a:b", "_:é", "_:0", "_:a.b", "_:a-b·", "_:𝄞"]
    rows = [(f"{x} <urn:p> {x} .",) for x in good]
    assert sorted(r.s.lex for r in rdf_text.lines(spark.createDataFrame(rows, "value string")).collect()) == sorted(x[2:] for x in good[:-1] + ["_:𝄞"])
    assert rdf_text.lines(spark.createDataFrame([(f"{x} <urn:p> <urn:o> .",) for x in ("_:-a", "_:·a", "_:", "_:a.", "<urn:\\uD800>")], "value string"), strict=False).count() == 0
    assert [s for s, _, _ in read(spark, "_:é <urn:p> _:a:b . _:a.b <urn:p> 1 .", "text/turtle")] == ["_", "_"]


@pytest.mark.parametrize("bad", ['"lit" <urn:p> <urn:o> .', "42 <urn:p> 1 .", "<urn:g> { true <urn:p> 1 }", '<urn:s> <urn:p> "\\q" .', '<urn:s> <urn:p> "\\uD800" .', '<urn:s> <urn:p> "\\U00110000" .', "<urn:\\q> <urn:p> 1 ."])
def test_turtle_refuses(spark, bad):
    with pytest.raises(ValueError, match="."):
        read(spark, bad, "text/turtle")


def test_turtle_numbers(spark):
    found = read(spark, "<urn:s> <urn:p> .5e3 , 1.5E-2, -.5, +7, 1.e1, 3. <urn:s> <urn:q> 2.", "text/turtle")
    assert [o for _, _, o in found] == sorted(["+7^integer", "-.5^decimal", ".5e3^double", "1.5E-2^double", "1.e1^double", "3^integer"]) + ["2^integer"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"@context": {"@vocab": "http://v/", "p": null, "q": {"@id": null}, "T": null}, "@id": "urn:s", "@type": ["T", "U"], "p": 1, "q": 2, "r": 3}', [("urn:s", "r", "3^integer"), ("urn:s", "type", "http://v/U")]),
        ('{"@id": "urn:s", "urn:p": {"@value": [1]}}', None), ('{"@id": "urn:s", "urn:p": {"@value": "x", "@id": "urn:o"}}', None), ('{"@id": "urn:s", "urn:p": {"@value": "x", "@direction": "rtl"}}', None), ('{"@id": "urn:s", "urn:p": {"@value": "x", "@nonsense": 1}}', None),
    ],
)
def test_json_ld_values(spark, body, want):
    if want is None:
        with pytest.raises(ValueError, match="@value"):
            read(spark, body, "application/ld+json")
    else:
        assert read(spark, body, "application/ld+json") == want


def test_unknown_media_types_are_errors(spark):
    df = spark.createDataFrame([("u", "x", "application/zip")], "uri string, content string, media_type string")
    with pytest.raises(Exception, match="nothing reads"):
        rdf_text.documents(df, strict=False).collect()


def test_subclass_pairs(spark):
    ttl = "@prefix r: <http://www.w3.org/2000/01/rdf-schema#> . <http://a> r:subClassOf <http://b>, <http://c> ; r:label 'x' . _:n r:subClassOf <http://a> ."
    df = spark.createDataFrame([("u", ttl, "text/turtle")], "uri string, content string, media_type string")
    assert sorted(map(tuple, quads.subclass_pairs(rdf_text.documents(df)).collect())) == [("http://a", "http://b"), ("http://a", "http://c")]


def test_federation_and_vocabulary(spark, tmp_path):
    a = rdf_text.documents(spark.createDataFrame([("a", MARKS, "text/turtle")], "uri string, content string, media_type string"))
    (tmp_path / "b.nt").write_text(f'<http://sea.example/mark/nore> <{SEA}called> "Nore" .\n')
    data = dataset.Dataset(spark).register("http://g/a", a).resolver("http", lambda s, u: docs(s, f'<urn:lune> <{SEA}called> "Lune" .').withColumn("media_type", F.lit("nt")))
    every = data.quads(f"http://g/a, file://{tmp_path}/b.nt\nhttp://g/c http://g/a")
    assert sorted(r.n.lex for r in quads.match(every, "?s", SEA + "called", "?n").df.collect()) == ["Holm", "Lune", "Nore", "Schäre", "Skerry"]
    assert sorted(r.n.lex for r in quads.match(every, "?s", SEA + "called", "?n", "http://g/a").df.collect()) == ["Holm", "Schäre", "Skerry"]
    q = dataset.NS
    assert quads.match(data.quads(), q + "Converter", terms.SUBCLASS, q + "Endpoint").ask().first().answer
    with pytest.raises(ValueError, match="nothing resolves"):
        data.quads("ftp://x")


def test_catalog_joins_the_vocabulary(spark):
    data = dataset.Dataset(spark).register("urn:catalog", catalog.triples(catalog.catalog(spark)))
    every, q = data.quads("urn:catalog"), dataset.NS
    kinds = paths.sequence(paths.link(every, terms.TYPE), paths.zero_or_more(paths.link(every, terms.SUBCLASS), every=every.select("s").union(every.select("o")).distinct()))
    found = kinds.where(F.col("o") == terms.iri(q + "Endpoint")).select("s").distinct()
    assert found.count() == len(catalog.ENDPOINTS)
    assert quads.match(every, "?e", q + "convertsTo", terms.literal(F.lit("text/html"))).df.first().e.lex == "urn:graph:convert"
    row = catalog.catalog(spark).where("urn = 'urn:graph:convert'").first()
    assert "text/html" in row.to and "text/html" not in row["from"] and "application/octet-stream" in row["from"]


@pytest.mark.parametrize(
    ("as_", "kind", "inside"),
    [
        (None, "application/sparql-results+json", f'"value":"1904","datatype":"{SEA}year"'), ("text/csv", "text/csv", "n\r\n1904\r\n"), ("xml", "application/sparql-results+xml", f'<literal datatype="{SEA}year">1904</literal>'),
        ("tsv", "text/tab-separated-values", f'?n\n"1904"^^<{SEA}year>\n'), ("nonsense", "application/sparql-results+json", "bindings"),
    ],
)
def test_answers(spark, as_, kind, inside):
    a = rdf_text.documents(spark.createDataFrame([("a", MARKS, "text/turtle")], "uri string, content string, media_type string"))
    found = quads.match(a, "?s", SEA + "since", "?n").project("n")
    media_type, body = dataset.answer(found, as_)
    assert media_type == kind and inside in body.first().value
    assert "true" in dataset.answer(found.ask(), as_)[1].first().value
    made = quads.construct(quads.match(a, "?s", SEA + "since", "?n"), ("?s", "urn:founded", "?n"))
    assert dataset.answer(made)[0] == "text/turtle" and "urn:founded" in dataset.answer(made)[1].first().value


def test_auto_dispatch(spark):
    made = convert.auto(docs(spark, MARKS, '[{"@id": "urn:q", "urn:r": [4, {"@id": "urn:s"}]}]'), media.HTML)
    assert sorted(bytes(r.content).decode().split(" triples")[0][-2:] for r in made.collect()) == ["13", ">2"] and {r.media_type for r in made.collect()} == {"text/html"}
    assert text(convert.auto(docs(spark, MARKS), "text/turtle")) == MARKS
    with pytest.raises(ValueError, match="text/turtle.*application/zip"):
        convert.auto(docs(spark, MARKS), "application/zip")
    with pytest.raises(ValueError, match="application/gzip"):
        convert.auto(spark.createDataFrame([("u", bytearray(b"\x1f\x8b\x08\x00"))], "uri string, content binary"))
    with pytest.raises(ValueError, match="None"):
        convert.auto(docs(spark, MARKS).union(spark.createDataFrame([("u", None)], "uri string, content binary")))
    chain = convert.Registry().register(["a"], ["b"], None).register(["b"], ["c"], None).chain("a", "c")
    assert [t for t, _ in chain] == ["b", "c"]


def test_cache_follows_its_sources(spark, tmp_path):
    path, calls, held = str(tmp_path / "t"), [], cache.Cache()

    def make():
        calls.append(1)
        return spark.read.parquet(path).groupBy().count()

    for n in (3, 3, 5):
        if not calls or n == 5:
            spark.range(n).write.mode("overwrite").parquet(path)
        out = held.get("count", (), [spark.read.parquet(path)], make).first()[0]
        assert out == n
    assert len(calls) == 2


def test_cached_results_follow_each_other(spark, tmp_path):
    """Two levels over two sources: a changed file makes again what was made from it, and nothing else."""
    calls, held = [], cache.Cache()
    for name in "ab":
        spark.range(3).write.parquet(f"{tmp_path}/{name}")

    def read(name):
        return spark.read.parquet(f"{tmp_path}/{name}")

    def make(name):
        return lambda *dfs: (calls.append(name), dfs[0].crossJoin(dfs[1]).groupBy().count() if len(dfs) == 2 else (dfs[0] if dfs else read(name)))[1]

    def ask():
        calls.clear()
        for name in "ab":
            held.get(name, (), [read(name)], make(name))
        held.get("on a", (), [], make("on a"), after=[("a", ())])
        return held.get("on both", (), [], make("on both"), after=[("on a", ()), ("b", ())]).first()[0]

    assert ask() == 9 and calls == ["a", "b", "on a", "on both"]
    assert ask() == 9 and calls == []
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/b")
    assert ask() == 24 and calls == ["b", "on both"]
    spark.range(1).write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert ask() == 8 and calls == ["a", "on a", "on both"]
    assert held.stale() == []
    with pytest.raises(KeyError):
        held.get("x", (), [], make("x"), after=[("never made", ())])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<http://a> <http://b> <http://c> .\n<http://a>  <http://b> <http://c> .\nbroken\n<http://a> <http://b> "a  b" .\n<http://a> <http://b> "a b" .\n<http://a> <http://b> "a\\u0020b".\n')
    stream = spark.readStream.text(str(tmp_path / "in")).withColumn("at", F.current_timestamp())
    for df, name in ((graphs.triples(stream, "at"), "t1"), (graphs.sniffed(stream, "value"), "t2")):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.o.lex for r in spark.table("t1").collect()) == ["a  b", "a b", "http://c"]
    assert sorted(r.media_type for r in spark.table("t2").collect()) == ["text/plain"] + ["text/turtle"] * 5
