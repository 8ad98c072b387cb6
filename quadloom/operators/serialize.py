"""Serialisations as one text row for each solution, triple or subject, made of native columns.

Rows are written in parallel (write.text); what a document needs around them comes
from frame(). document() joins it all into one text, for results that are to be
one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.operators.solutions import Solutions


def _escaped(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, sign in pairs:
        text = F.replace(text, F.lit(raw), F.lit(sign))
    return text


def html_escaped(text: Column) -> Column:
    return _escaped(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


#: Characters that no XML document can have, escaped or not.
NO_XML = "[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"


def xml_escaped(text: Column) -> Column:
    """A carriage return as a reference, since readers turn a bare one into a line feed; a character that XML cannot have is an error."""
    plain = _escaped(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")))
    return F.when(text.rlike(NO_XML), F.raise_error(F.concat(F.lit("no XML for a control character in "), F.substring(text, 1, 80))).cast("string")).otherwise(plain)


# solutions


def _json_term(t: Column) -> Column:
    plain = (t.dt == terms.STRING) | t.lang.isNotNull()
    return F.when(t.isNotNull(), F.struct(F.when(t.kind == terms.IRI, "uri").when(t.kind == terms.BLANK, "bnode").otherwise("literal").alias("type"), t.lex.alias("value"), t.lang.alias("xml:lang"), F.when(~plain, t.dt).alias("datatype")))


def _xml_term(t: Column) -> Column:
    text = xml_escaped(t.lex)
    head = F.when(t.lang.isNotNull(), F.concat(F.lit('<literal xml:lang="'), t.lang, F.lit('">'))).when(t.dt == terms.STRING, "<literal>").otherwise(F.concat(F.lit('<literal datatype="'), xml_escaped(t.dt), F.lit('">')))
    return F.when(t.kind == terms.IRI, F.concat(F.lit("<uri>"), text, F.lit("</uri>"))).when(t.kind == terms.BLANK, F.concat(F.lit("<bnode>"), text, F.lit("</bnode>"))).otherwise(F.concat(head, text, F.lit("</literal>")))


def _csv_field(t: Column) -> Column:
    text = F.when(t.kind == terms.BLANK, F.concat(F.lit("_:"), t.lex)).otherwise(t.lex)
    return F.coalesce(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def solution_rows(found: Solutions, form: str) -> DataFrame:
    """A row `value` for each solution, its term columns in the given results format."""
    df, names = found.df, found.variables
    if form == "json":
        value = F.to_json(F.struct(*(_json_term(df[v]).alias(v) for v in names)))
    elif form == "xml":
        bindings = [F.coalesce(F.concat(F.lit(f'<binding name="{v}">'), _xml_term(df[v]), F.lit("</binding>")), F.lit("")) for v in names]
        value = F.concat(F.lit("<result>"), *bindings, F.lit("</result>"))
    elif form == "csv":
        value = F.concat_ws(",", *(_csv_field(df[v]) for v in names))
    else:
        value = F.concat_ws("\t", *(F.coalesce(terms.n_triples(df[v]), F.lit("")) for v in names))
    return df.select(value.alias("value"))


def frame(form: str, variables: list[str]) -> tuple[str, str, str]:
    """Text before, between and after the rows of a results document."""
    if form == "json":
        return '{"head":{"vars":[' + ",".join(f'"{v}"' for v in variables) + ']},"results":{"bindings":[', ",", "]}}"
    if form == "xml":
        head = "".join(f'<variable name="{v}"/>' for v in variables)
        return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>', "", "</results></sparql>"
    if form == "csv":
        return ",".join(variables) + "\r\n", "\r\n", "\r\n"
    return "\t".join("?" + v for v in variables) + "\n", "\n", "\n"


def boolean_document(answer: Column, form: str) -> Column:
    """An ASK's answer."""
    text = answer.cast("string")
    if form == "json":
        return F.concat(F.lit('{"head":{},"boolean":'), text, F.lit("}"))
    if form == "xml":
        return F.concat(F.lit('<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>'), text, F.lit("</boolean></sparql>"))
    return text


def document(rows: DataFrame, around: tuple[str, str, str], order: Column | None = None) -> DataFrame:
    """One row `value`: all rows' values in one text, ascending by value unless order says otherwise. One text is one task's, whatever writes it; large results are better left as rows."""
    before, between, after = around
    key = (F.col("value") if order is None else order).alias("k")
    held = F.array_sort(F.collect_list(F.struct(key, F.col("value").alias("value"))))
    body = F.array_join(F.transform(held, lambda x: x.value), between)
    tail = F.when(F.count(F.lit(1)) > 0, F.lit(after)).otherwise(F.lit(after if after != between else ""))
    return rows.agg(F.concat(F.lit(before), body, tail).alias("value"))


# triples and quads


def n_triples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", *(terms.n_triples(F.col(c)) for c in ("s", "p", "o")), F.lit(".")).alias("value"))


def n_quads(quads: DataFrame) -> DataFrame:
    """concat_ws passes over a null graph, which is the default one."""
    return quads.select(F.concat_ws(" ", *(terms.n_triples(F.col(c)) for c in ("s", "p", "o", "g")), F.lit(".")).alias("value"))


def triples_only(quads: DataFrame) -> DataFrame:
    """Quads as triples of the default graph."""
    return quads.select("s", "p", "o")


def require_default(quads: DataFrame) -> DataFrame:
    """quads, which fail when read if one has a named graph: triple syntaxes have no place for it."""
    return quads.select(F.when(F.col("g").isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a named graph does not fit a triple syntax"))).alias("__ok"), "g", "s", "p", "o").where("__ok").drop("__ok")


def _statement(objects: Column) -> Column:
    return F.array_join(F.array_sort(objects), " ;\n    ")


def turtle(triples: DataFrame, *keys: str) -> DataFrame:
    """A statement for each subject with full IRIs, its pairs in order. keys: more columns to group by and keep."""
    pair = F.concat_ws(" ", terms.n_triples(F.col("p")), terms.n_triples(F.col("o")))
    return triples.groupBy(*keys, "s").agg(F.collect_set(pair).alias("pairs")).select(*keys, F.concat(terms.n_triples(F.col("s")), F.lit(" "), _statement(F.col("pairs")), F.lit(" .")).alias("value"))


def trig(quads: DataFrame, *keys: str) -> DataFrame:
    """A block for each graph and subject."""
    pair = F.concat_ws(" ", terms.n_triples(F.col("p")), terms.n_triples(F.col("o")))
    each = quads.groupBy(*keys, "g", "s").agg(F.collect_set(pair).alias("pairs"))
    text = F.concat(terms.n_triples(F.col("s")), F.lit(" "), _statement(F.col("pairs")), F.lit(" ."))
    return each.select(*keys, F.when(F.col("g").isNull(), text).otherwise(F.concat(terms.n_triples(F.col("g")), F.lit(" {\n"), text, F.lit("\n}"))).alias("value"))


RDF_XML = ('<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n', "\n", "\n</rdf:RDF>\n")


def rdf_xml(triples: DataFrame, *keys: str) -> DataFrame:
    """A description for each subject. Predicates split before their last name; one that does not split is an error."""
    split = r"^(.*?)([A-Za-z_][A-Za-z0-9_.-]*)$"
    space, name = (F.regexp_extract(F.col("p.lex"), split, k) for k in (1, 2))
    o = F.col("o")
    open_ = F.concat(F.lit("<n:"), name, F.lit(' xmlns:n="'), xml_escaped(space), F.lit('"'))
    rest = F.when(o.kind == terms.IRI, F.concat(F.lit(' rdf:resource="'), xml_escaped(o.lex), F.lit('"/>'))).when(o.kind == terms.BLANK, F.concat(F.lit(' rdf:nodeID="'), o.lex, F.lit('"/>')))
    kind = F.when(o.lang.isNotNull(), F.concat(F.lit(' xml:lang="'), o.lang, F.lit('"'))).when(o.dt == terms.STRING, "").otherwise(F.concat(F.lit(' rdf:datatype="'), xml_escaped(o.dt), F.lit('"')))
    whole = F.concat(kind, F.lit(">"), xml_escaped(o.lex), F.lit("</n:"), name, F.lit(">"))
    property_ = F.when(name == "", F.raise_error(F.concat(F.lit("no XML name for "), F.col("p.lex")))).otherwise(F.concat(open_, F.coalesce(rest, whole)))
    s = F.col("s")
    about = F.when(s.kind == terms.IRI, F.concat(F.lit('rdf:about="'), xml_escaped(s.lex), F.lit('"'))).otherwise(F.concat(F.lit('rdf:nodeID="'), s.lex, F.lit('"')))
    return triples.groupBy(*keys, "s").agg(F.collect_set(property_).alias("x")).select(*keys, F.concat(F.lit("<rdf:Description "), about, F.lit(">"), F.array_join(F.array_sort("x"), ""), F.lit("</rdf:Description>")).alias("value"))


JSON_LD = ("[", ",", "]")


def json_ld(quads: DataFrame, *keys: str) -> DataFrame:
    """An expanded node object for each graph and subject."""
    node = lambda t: F.when(t.kind == terms.BLANK, F.concat(F.lit("_:"), t.lex)).otherwise(t.lex)
    o = F.col("o")
    typed = ~((o.dt == terms.STRING) | o.lang.isNotNull())
    value = F.when(o.kind == terms.LITERAL, F.to_json(F.struct(o.lex.alias("@value"), o.lang.alias("@language"), F.when(typed, o.dt).alias("@type")))).otherwise(F.to_json(F.struct(node(o).alias("@id"))))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    by_predicate = quads.groupBy(*keys, "g", "s", "p").agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values"))
    member = F.concat(quoted(F.col("p.lex")), F.lit(":["), F.col("values"), F.lit("]"))
    by_subject = by_predicate.groupBy(*keys, "g", "s").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))
    body = F.concat(F.lit('{"@id":'), quoted(node(F.col("s"))), F.lit(","), F.col("members"), F.lit("}"))
    body = F.when(F.col("s").isNotNull(), body)
    return by_subject.select(*keys, F.when(F.col("g").isNull(), body).otherwise(F.concat(F.lit('{"@id":'), quoted(node(F.col("g"))), F.lit(',"@graph":['), body, F.lit("]}"))).alias("value"))


def html_row() -> Column:
    """A table row for a triple; the graph's name is dropped."""
    cells = [F.concat(F.lit("<td>"), html_escaped(terms.n_triples(F.col(c))), F.lit("</td>")) for c in ("s", "p", "o")]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def html_table(counted: Column, row: Column) -> Column:
    """Aggregate: the table in one text, its caption saying how many triples it has."""
    head = "<thead><tr><th>subject</th><th>predicate</th><th>object</th></tr></thead>"
    return F.concat(F.lit('<table class="rdf"><caption>'), F.count(counted).cast("string"), F.lit(f" triples</caption>{head}<tbody>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</tbody></table>"))


def html_rows(quads: DataFrame) -> DataFrame:
    return quads.select(html_row().alias("value"))


#: Around the rows of a table that many tasks write; {count} is their number.
HTML = ('<table class="rdf"><caption>{count} triples</caption><thead><tr><th>subject</th><th>predicate</th><th>object</th></tr></thead><tbody>\n', "\n", "\n</tbody></table>")


def html(quads: DataFrame) -> DataFrame:
    return html_rows(quads).agg(html_table(F.col("value"), F.col("value")).alias("value"))


def graph_rows(quads: DataFrame, form: str) -> tuple[DataFrame, tuple[str, str, str]]:
    """Rows of a graph format and what goes around them."""
    plain = ("", "\n", "\n")
    if form in ("nquads", "trig", "jsonld"):
        return {"nquads": n_quads, "trig": trig, "jsonld": json_ld}[form](quads), JSON_LD if form == "jsonld" else plain
    triples = triples_only(require_default(quads))
    return {"ntriples": n_triples, "turtle": turtle, "rdfxml": rdf_xml}[form](triples), RDF_XML if form == "rdfxml" else plain


def grouped(quads: DataFrame, form: str) -> DataFrame:
    """(uri, value): each document's quads (columns doc, uri) in a nested syntax."""
    rows = {"turtle": turtle, "trig": trig, "rdfxml": rdf_xml, "jsonld": json_ld}[form](quads, "doc", "uri")
    before, between, after = RDF_XML if form == "rdfxml" else JSON_LD if form == "jsonld" else ("", "\n", "\n")
    return rows.groupBy("doc", "uri").agg(F.concat(F.lit(before), F.array_join(F.array_sort(F.collect_list("value")), between), F.lit(after)).alias("value")).drop("doc")
