"""Quads from linked-data text.

N-Triples and N-Quads are read line by line with native columns and so split freely.
The nested syntaxes are read a document at a time, by a small reader inside
mapInPandas; a document is then one row's work, and documents are read in parallel.
Blank nodes are scoped to their document by a prefix from its URI. What a reader does
not know is an error, never passed over.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.functions.iris import resolve
from quadloom.functions.sniff import JSON_LD, RDF_XML, TURTLE
from quadloom.functions.terms import RDF, XSD

QUAD = "g struct<kind:tinyint,lex:string,dt:string,lang:string>, s struct<kind:tinyint,lex:string,dt:string,lang:string>, p struct<kind:tinyint,lex:string,dt:string,lang:string>, o struct<kind:tinyint,lex:string,dt:string,lang:string>"

#: Escapes of characters, which surrogates are not.
_POINT = r"\\u(?:[0-9A-CEFa-cef][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
#: Characters that a blank node's label begins with and goes on with (N-Triples; the colon is one of them).
_START = "A-Za-z0-9_:\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
_ON = _START + "\u00b7\u0300-\u036f\u203f-\u2040-"
_IRI, _BLANK = rf"<((?:[^<>\"{{}}|^`\\\x00-\x20]++|{_POINT})*+)>", rf"_:([{_START}](?:[.{_ON}]*[{_ON}])?)"
_LITERAL = rf'"((?:[^"\\\r\n]++|\\[tbnrf"\'\\]|{_POINT})*+)"(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
LINE = rf"^[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|{_LITERAL})[ \t]*(?:(?:{_IRI}|{_BLANK})[ \t]*)?\.[ \t]*(?:#.*)?$"


def _unescaped(text):
    """String and unicode escapes resolved in one pass; a text without a backslash is returned as it is."""
    runs = F.regexp_extract_all(text, F.lit(rf"[^\\]++|{_POINT}|\\."), F.lit(0))
    point = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
    sign = lambda x: F.translate(F.substring(x, 2, 1), "tbnrf", "\t\b\n\r\f")
    plain = lambda x: F.when(~x.startswith("\\"), x).when(F.length(x) > 2, point(x)).otherwise(sign(x))
    return F.when(text.contains("\\"), F.array_join(F.transform(runs, plain), "")).otherwise(text)


def scope_of(uri):
    """Prefix of the blank nodes of the document at uri (a column)."""
    return F.concat(F.lit("d"), F.substring(F.md5(F.coalesce(uri, F.lit(""))), 1, 16), F.lit("-"))


def scope_name(uri: str | None) -> str:
    """scope_of on the side of Python."""
    return f"d{hashlib.md5((uri or '').encode()).hexdigest()[:16]}-"


def lines(text: DataFrame, scope: str | Column = "", strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quads of N-Triples or N-Quads lines in column value, and the columns keep; scope is put in front of blank nodes' names.

    Empty and comment lines give nothing. Another line that is no statement is an
    error when it is read or, if not strict, is passed over.
    """
    x = lambda k: F.nullif(F.col("__part")[k - 1], F.lit(""))
    none = F.lit(None).cast(terms.TERM)
    node = lambda i, b: F.coalesce(terms.iri(_unescaped(x(i))), terms.blank(F.concat(F.col("__scope"), x(b))))
    # one match for all groups; a line break, which no line holds, parts them, and a line that does not match keeps as it is
    line = F.rtrim(F.col("value"), F.lit("\r\n"))
    parts = F.array(F.split(F.regexp_replace(line, LINE, "\n".join(f"${k}" for k in range(1, 11))), "\n"))
    fits = lambda part: (F.size(part) == 10) & ~line.contains("\n")
    said = F.raise_error(F.concat(F.lit("no statement: "), F.substring("value", 1, 80))).cast("array<string>")
    kept = F.transform(parts, lambda part: F.when(fits(part), part).otherwise(said)) if strict else F.filter(parts, fits)
    # a generator, since filters would be pushed below the match and repeat it
    each = F.explode(F.when(line.rlike(r"^[ \t\r]*(#.*)?$"), F.array().cast("array<array<string>>")).otherwise(kept)).alias("__part")
    parted = text.select("value", (F.lit(scope) if isinstance(scope, str) else scope).alias("__scope"), *keep).select("__scope", *keep, each)
    named = parted.select("__part", "__scope", *keep, F.when(x(4).isNull() & x(5).isNull(), _unescaped(F.col("__part")[5])).alias("__raw"))
    value = F.when(x(8).isNotNull(), terms.tagged(F.col("__raw"), x(8))).otherwise(terms.typed(F.col("__raw"), F.coalesce(_unescaped(x(7)), F.lit(terms.STRING))))
    return named.select(F.coalesce(node(9, 10), none).alias("g"), node(1, 2).alias("s"), terms.iri(_unescaped(x(3))).alias("p"), F.coalesce(node(4, 5), value).alias("o"), *keep)


# one document at a time. A term here is a tuple (kind, lex, dt, lang).

Term = tuple
_TOKEN = re.compile(
    r'(?P<skip>\s+|#[^\n]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
    rf"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:[{_START}](?:[.{_ON}]*[{_ON}])?)"
    r"|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<mark>\^\^|[.;,\[\](){}])|(?P<name>(?:[^\W\d_][\w.·-]*)?:(?:(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\.|\.(?=[\w:·%-]))*)|[A-Za-z]+)"
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_SIMPLE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    """Escapes resolved; what is no escape, and numbers of no character, are errors."""

    def sign(m: re.Match) -> str:
        if not (m[1] or m[2]):
            return _SIMPLE[m[3]] if m[3] in _SIMPLE else _fail(f"no escape: {m[0]!r}")
        code = int(m[1] or m[2], 16)
        return _fail(f"no character: {m[0]!r}") if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code)

    return _ESCAPE.sub(sign, text)


def _fail(said: str):
    raise ValueError(said)


class _Turtle:
    """Turtle and TriG by descent over tokens."""

    def __init__(self, text: str, scope: str, base: str = "", prefixes: dict[str, str] | None = None, own: str = ""):
        """prefixes that hold already; own: what names blank nodes without a label, besides scope."""
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no token at {text[at : at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.scope, self.prefixes, self.base, self.graph, self.fresh, self.own = 0, scope, dict(prefixes or {}), base, None, 0, own

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        found = self.peek()
        if wanted is not None and found[1] != wanted:
            raise ValueError(f"{wanted!r} wanted, {found[1]!r} found")
        self.at += 1
        return found

    def blank(self) -> Term:
        self.fresh += 1
        return 1, f"{self.scope}{self.own}x{self.fresh}", None, None

    def iri(self, found: tuple[str, str]) -> Term:
        kind, text = found
        if kind == "iri":
            lex = _plain(text[1:-1])
            return 2, resolve(self.base, lex), None, None
        prefix, colon, local = text.partition(":")
        if kind != "name" or not colon or prefix not in self.prefixes:
            raise ValueError(f"no IRI: {text!r}")
        return 2, self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), None, None

    def run(self) -> Iterator[tuple]:
        while self.peek()[0] != "end":
            word = self.peek()[1].lower()
            if word in ("@prefix", "prefix", "@base", "base"):
                self.take()
                if word.endswith("prefix"):
                    name = self.take()[1]
                    self.prefixes[name.removesuffix(":")] = self.iri(self.take())[1]
                else:
                    self.base = self.iri(self.take())[1]
                if word[0] == "@":
                    self.take(".")
                continue
            if word == "graph":
                self.take()
                word = ""
            if word == "{":
                yield from self.block(None)
                continue
            if [t[1] for t in self.tokens[self.at : self.at + 3] if t[0] == "mark"] == ["[", "]", "{"]:
                self.at += 2
                yield from self.block(self.blank())
                continue
            if self.tokens[self.at + 1 : self.at + 2] == [("mark", "{")]:
                yield from self.block(self.node(self.take()))
                continue
            yield from self.statement()
            self.take(".")

    def block(self, graph: Term | None) -> Iterator[tuple]:
        self.take("{")
        self.graph = graph
        while self.peek()[1] != "}":
            yield from self.statement()
            if self.peek()[1] == ".":
                self.take()
        self.take("}")
        self.graph = None

    def statement(self) -> Iterator[tuple]:
        out: list[tuple] = []
        alone = self.peek()[1] == "["
        subject = self.object(out)
        if subject[0] == 3:
            raise ValueError(f"a literal is no subject: {subject[1]!r}")
        if not (alone and self.peek()[1] in (".", "}")):
            self.pairs(subject, out)
        yield from out

    def pairs(self, subject: Term, out: list[tuple]) -> None:
        while True:
            found = self.take()
            predicate = (2, RDF + "type", None, None) if found == ("name", "a") else self.iri(found)
            while True:
                out.append((self.graph, subject, predicate, self.object(out)))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] not in (".", "]", "}", ";"):
                    break
            else:
                return

    def node(self, found: tuple[str, str]) -> Term:
        return (1, self.scope + found[1][2:], None, None) if found[0] == "blank" else self.iri(found)

    def object(self, out: list[tuple]) -> Term:
        kind, text = found = self.take()
        if text == "[" and kind == "mark":
            node = self.blank()
            if self.peek()[1] != "]":
                self.pairs(node, out)
            self.take("]")
            return node
        if text == "(" and kind == "mark":
            items = []
            while self.peek()[1] != ")":
                items.append(self.object(out))
            self.take(")")
            rest: Term = (2, RDF + "nil", None, None)
            for item in reversed(items):
                node = self.blank()
                out += [(self.graph, node, (2, RDF + "first", None, None), item), (self.graph, node, (2, RDF + "rest", None, None), rest)]
                rest = node
            return rest
        if kind == "text":
            size = 3 if text[:3] in ('"""', "'''") else 1
            lex = _plain(text[size:-size])
            if self.peek()[0] == "lang":
                return 3, lex, terms.LANG_STRING, self.take()[1][1:].lower()
            if self.peek()[1] == "^^":
                self.take()
                return 3, lex, self.iri(self.take())[1], None
            return 3, lex, terms.STRING, None
        if kind == "number":
            return 3, text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if found in (("name", "true"), ("name", "false")):
            return 3, text, terms.BOOLEAN, None
        return self.node(found)


_R, _X = "{" + RDF + "}", "{http://www.w3.org/XML/1998/namespace}"
#: Names of the syntax that are no properties.
_SYNTAX = {_R + n for n in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "aboutEach", "aboutEachPrefix", "bagID", "Description")}


def _iri(lex: str) -> Term:
    return 2, lex, None, None


class _Frame:
    """An open element: a node, whose children are properties, or a property, whose children are nodes."""

    def __init__(self, element: ET.Element, base: str, lang: str | None, subject: Term | None = None):
        self.element, self.base, self.lang, self.subject = element, base, lang, subject
        self.number = 0  # of the last rdf:li
        self.predicate: Term | None = None  # of a property
        self.about: str | None = None
        self.kind: str | None = None
        self.items: list[Term] = []  # the nodes in a property


class _RdfXml:
    """RDF/XML by events: a stack of open elements with their bases, languages and subjects; an element that has ended is freed.

    What is kept besides is the items of a collection and the markup of a literal that are open.
    """

    def __init__(self, text: str | None, scope: str, base: str = ""):
        self.text, self.scope, self.base, self.fresh, self.out = text, scope, base, 0, []
        self.parser, self.frames, self.depth = ET.XMLPullParser(("start", "end")), [], 0  # depth: of elements open in a literal

    def run(self) -> Iterator[tuple]:
        yield from self.feed(self.text)
        yield from self.close()

    def feed(self, data: str | bytes) -> Iterator[tuple]:
        """The quads that are certain once data has been read."""
        self.parser.feed(data)
        for event, element in self.parser.read_events():
            if event == "start":
                self.begin(element)
            else:
                self.end(element)
            yield from self.out
            self.out = []

    def close(self) -> Iterator[tuple]:
        self.parser.close()
        return iter(())

    def begin(self, element: ET.Element) -> None:
        top = self.frames[-1] if self.frames else None
        if self.depth:
            self.depth += 1
            return
        base, lang = self.around(element, top.base if top else self.base, top.lang if top else None)
        if top is None and element.tag == _R + "RDF":
            self.frames.append(_Frame(element, base, lang))
        elif top is None or (top.predicate is None and top.subject is None) or (top.predicate is not None and top.kind in (None, "Collection")):
            if top is not None and top.predicate is not None and top.kind is None and (top.items or (top.element.text or "").strip()):
                raise ValueError(f"{top.element.tag!r} holds more than one node")
            subject = self.node(element, base, lang)
            if top is not None and top.predicate is not None:
                top.items.append(subject)
            self.frames.append(_Frame(element, base, lang, subject))
        else:
            self.property(top, element, base, lang)

    def property(self, top: _Frame, element: ET.Element, base: str, lang: str | None) -> None:
        if element.tag in _SYNTAX:
            raise ValueError(f"{element.tag!r} is no property")
        top.number += element.tag == _R + "li"
        frame = _Frame(element, base, lang, top.subject)
        frame.predicate = _iri(f"{RDF}_{top.number}" if element.tag == _R + "li" else self.name(element.tag))
        frame.about = None if element.get(_R + "ID") is None else resolve(base, "#" + element.get(_R + "ID"))
        frame.kind = element.get(_R + "parseType")
        if frame.kind == "Resource":  # its children are properties of a node of its own
            node = self.blank()
            self.add(top.subject, frame.predicate, node, frame.about)
            frame.subject, frame.predicate = node, None
        elif frame.kind not in (None, "Collection"):
            self.depth = 1
        self.frames.append(frame)

    def end(self, element: ET.Element) -> None:
        if self.depth > 1:
            self.depth -= 1
            return
        self.depth = 0
        frame = self.frames.pop()
        if frame.predicate is not None:
            if frame.kind == "Collection":
                value = self.list(frame.items)
            elif frame.items:
                value = frame.items[0]
            else:
                value = self.value(element, frame.base, frame.lang)
            self.add(frame.subject, frame.predicate, value, frame.about)
        element.clear()
        if self.frames:
            self.frames[-1].element.remove(element)

    def around(self, element: ET.Element, base: str, lang: str | None) -> tuple[str, str | None]:
        return resolve(base, element.get(_X + "base", base)), element.get(_X + "lang", lang) or None

    def list(self, items: list[Term]) -> Term:
        rest = _iri(RDF + "nil")
        for item in reversed(items):
            cell = self.blank()
            self.add(cell, _iri(RDF + "first"), item)
            self.add(cell, _iri(RDF + "rest"), rest)
            rest = cell
        return rest

    def add(self, subject: Term, predicate: Term, value: Term, about: str | None = None) -> None:
        self.out.append((None, subject, predicate, value))
        if about is not None:  # a statement with an ID is described as well
            for name, x in (("type", _iri(RDF + "Statement")), ("subject", subject), ("predicate", predicate), ("object", value)):
                self.out.append((None, _iri(about), _iri(RDF + name), x))

    def blank(self, name: str | None = None) -> Term:
        self.fresh += name is None
        return 1, self.scope + (f"n-{name}" if name is not None else f"x{self.fresh}"), None, None

    def name(self, tag: str) -> str:
        if tag[:1] != "{":
            raise ValueError(f"{tag!r} has no namespace")
        return tag[1:].replace("}", "", 1)

    def literal(self, text: str, lang: str | None) -> Term:
        return 3, text, terms.LANG_STRING if lang else terms.STRING, lang and lang.lower()

    def node(self, element: ET.Element, base: str, lang: str | None) -> Term:
        """The subject of a node element, with what its name and attributes say of it."""
        if (about := element.get(_R + "about")) is not None:
            subject = _iri(resolve(base, about))
        elif (name := element.get(_R + "ID")) is not None:
            subject = _iri(resolve(base, "#" + name))
        else:
            subject = self.blank(element.get(_R + "nodeID"))
        if element.tag != _R + "Description":
            if element.tag in _SYNTAX or element.tag == _R + "li":
                raise ValueError(f"{element.tag!r} is no node")
            self.add(subject, _iri(RDF + "type"), _iri(self.name(element.tag)))
        self.attributes(subject, element, base, lang)
        return subject

    def attributes(self, subject: Term, element: ET.Element, base: str, lang: str | None) -> None:
        for key, value in element.attrib.items():
            if key == _R + "type":
                self.add(subject, _iri(RDF + "type"), _iri(resolve(base, value)))
            elif key.startswith(_X) or key in (_R + "about", _R + "ID", _R + "nodeID", _R + "resource"):
                continue
            elif key in _SYNTAX or key == _R + "li":
                raise ValueError(f"{key!r} does not fit here")
            else:
                self.add(subject, _iri(self.name(key)), self.literal(value, lang))

    def value(self, child: ET.Element, base: str, lang: str | None) -> Term:
        """The object of a property element without nodes in it."""
        if child.get(_R + "parseType") is not None:  # Literal, and any kind that is not known
            inside = escape(child.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in child)
            return 3, inside, RDF + "XMLLiteral", None
        if (dt := child.get(_R + "datatype")) is not None:
            return 3, child.text or "", resolve(base, dt), None
        more = [k for k in child.attrib if not k.startswith(_X) and k not in (_R + "ID", _R + "resource", _R + "nodeID")]
        if (to := child.get(_R + "resource")) is not None:
            node = _iri(resolve(base, to))
        elif more or child.get(_R + "nodeID") is not None:
            node = self.blank(child.get(_R + "nodeID"))
        else:
            return self.literal(child.text or "", lang)
        self.attributes(node, child, base, lang)
        return node


def stream_rdf_xml(file, scope: str, base: str = "", piece: int = 1 << 16) -> Iterator[tuple]:
    """Quads of an open binary file, read piece by piece."""
    reader = _RdfXml(None, scope, base)
    while data := file.read(piece):
        yield from reader.feed(data)
    yield from reader.close()


class _JsonLd:
    """JSON-LD with contexts inside the document: terms, prefixes, aliases of keywords, @vocab, @base, @language, containers of lists, sets, languages and indexes, and reverse properties. Anything else of the syntax is an error."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.loaded, self.scope, self.fresh, self.out, self.start = json.loads(text), scope, 0, [], {"@base": base}

    def run(self) -> Iterator[tuple]:
        for item in self.loaded if isinstance(self.loaded, list) else [self.loaded]:
            if not isinstance(item, dict):
                raise ValueError("no node object")
            self.node(item, self.start, None)
        yield from self.out

    def blank(self) -> Term:
        self.fresh += 1
        return 1, f"{self.scope}x{self.fresh}", None, None

    def context(self, given, context: dict) -> dict:
        for part in given if isinstance(given, list) else [given]:
            if part is None:
                context = self.start
                continue
            if not isinstance(part, dict):
                raise ValueError(f"remote context {part!r}")
            wrong = [k for k in part if k[:1] == "@" and k not in ("@base", "@vocab", "@language", "@version")]
            if wrong:
                raise ValueError(f"{wrong[0]} in a context is not supported")
            context = {**context, **part}
            if part.get("@base") is not None:
                context["@base"] = resolve(context.get("@base") or "", part["@base"])
        return context

    def entry(self, key: str, context: dict) -> dict:
        """The term's definition as a dictionary."""
        found = context.get(key) if key[:1] != "@" else None
        found = {"@id": found} if isinstance(found, str) else found or {}
        wrong = [k for k in found if k not in ("@id", "@type", "@language", "@container", "@reverse")]
        if wrong:
            raise ValueError(f"{wrong[0]} in a term is not supported")
        return found

    def expand(self, name: str, context: dict, vocab: bool) -> str:
        if name[:1] == "@":
            return name
        found = self.entry(name, context) if vocab and name in context else {}
        if vocab and name in context and (context[name] is None or "@id" in found and found["@id"] is None):
            return ""  # a term that means nothing
        if to := found.get("@id") or found.get("@reverse"):
            return self.expand(to, {k: v for k, v in context.items() if k != name}, True)
        prefix, colon, local = name.partition(":")
        if colon and prefix != "_" and not local.startswith("//") and prefix in context:
            return self.expand(prefix, context, True) + local
        if vocab and not colon:
            return context["@vocab"] + name if context.get("@vocab") is not None else name
        return name if prefix == "_" and colon else resolve(context.get("@base") or "", name)

    def ref(self, value: str, context: dict, vocab: bool = False) -> Term:
        lex = self.expand(value, context, vocab)
        return (1, f"{self.scope}n-{lex[2:]}", None, None) if lex.startswith("_:") else _iri(resolve(context.get("@base") or "", lex))

    def scalar(self, value, kind: str | None, lang: str | None) -> Term:
        if isinstance(value, bool):
            return 3, json.dumps(value), kind or terms.BOOLEAN, None
        if isinstance(value, float) and (value % 1 or abs(value) >= 1e21 or kind == terms.DOUBLE):
            mantissa, power = f"{value:.15E}".split("E")
            return 3, f"{mantissa.rstrip('0') if not mantissa.rstrip('0').endswith('.') else mantissa.rstrip('0') + '0'}E{int(power)}", kind or terms.DOUBLE, None
        if isinstance(value, (int, float)):
            return 3, str(int(value)), kind or terms.INTEGER, None
        if kind:
            return 3, value, kind, None
        return 3, value, terms.LANG_STRING if lang else terms.STRING, lang and lang.lower()

    def value(self, value, found: dict, context: dict, graph) -> Term | None:
        """The object that a value stands for; None for a null."""
        kind = found.get("@type")
        if isinstance(value, dict):
            names = {self.expand(k, context, True): v for k, v in value.items()}
            if "@value" in names:
                if wrong := [k for k in names if k not in ("@value", "@type", "@language", "@index", "@context")]:
                    raise ValueError(f"{wrong[0]} beside @value")
                if names["@value"] is None:
                    return None
                own = names.get("@type")
                if isinstance(names["@value"], (list, dict)) and own != "@json":
                    raise ValueError("@value is no scalar")
                if own == "@json":
                    return 3, json.dumps(names["@value"], sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON", None
                return self.scalar(names["@value"], self.expand(own, context, True) if own else None, names.get("@language"))
            if "@list" in names:
                return self.list(names["@list"], found, context, graph)
            return self.node(value, context, graph)
        if kind == "@json":
            return 3, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), RDF + "JSON", None
        if isinstance(value, list):
            return self.list(value, found, context, graph)
        if kind in ("@id", "@vocab") and isinstance(value, str):
            return self.ref(value, context, kind == "@vocab")
        lang = found.get("@language", context.get("@language")) if kind in (None, "@none") else None
        return None if value is None else self.scalar(value, self.expand(kind, context, True) if kind and kind[:1] != "@" else None, lang)

    def list(self, items, found: dict, context: dict, graph) -> Term:
        items = items if isinstance(items, list) else [items]
        rest = _iri(RDF + "nil")
        for item in reversed([x for x in (self.value(i, found, context, graph) for i in items) if x is not None]):
            cell = self.blank()
            self.out += [(graph, cell, _iri(RDF + "first"), item), (graph, cell, _iri(RDF + "rest"), rest)]
            rest = cell
        return rest

    def values(self, value, found: dict, context: dict) -> list:
        """The values of a property, its container undone."""
        container = found.get("@container")
        container = container[0] if isinstance(container, list) and len(container) == 1 else container
        if container == "@list":
            return [value if isinstance(value, dict) else {"@list": value}]
        if container == "@language" and isinstance(value, dict):
            return [{"@value": v, **({} if k == "@none" else {"@language": k})} for k, vs in value.items() for v in (vs if isinstance(vs, list) else [vs])]
        if container == "@index" and isinstance(value, dict):
            return [v for vs in value.values() for v in (vs if isinstance(vs, list) else [vs])]
        if container not in (None, "@set", "@language", "@index"):
            raise ValueError(f"container {container!r} is not supported")
        out = []
        for v in value if isinstance(value, list) else [value]:  # nested arrays and sets are one
            sets = [x for k, x in v.items() if self.expand(k, context, True) == "@set"] if isinstance(v, dict) else []
            out += self.values(sets[0], found, context) if sets else self.values(v, found, context) if isinstance(v, list) else [v]
        return out

    def node(self, item: dict, context: dict, graph: Term | None) -> Term:
        if "@context" in item:
            context = self.context(item["@context"], context)
        named = [(self.expand(k, context, True), k, v) for k, v in item.items() if k != "@context"]
        ids = [v for name, _, v in named if name == "@id"]
        subject = self.ref(ids[0], context) if ids and ids[0] is not None else self.blank()
        plain = {"@id", "@graph", "@context"}
        for name, key, value in named:
            found = self.entry(key, context)
            if name == "@type":
                self.out += [(graph, subject, _iri(RDF + "type"), self.ref(v, context, True)) for v in (value if isinstance(value, list) else [value]) if self.expand(v, context, True)]
            elif name in ("@graph", "@included"):
                # a graph without a name and without properties of its own is the graph around it
                alone = name == "@included" or (not ids and all(n in plain for n, _, _ in named))
                for v in value if isinstance(value, list) else [value]:
                    self.node(v, context, graph if alone else subject)
            elif name == "@reverse":
                for inner, v in value.items():
                    self.reversed(subject, self.expand(inner, context, True), self.entry(inner, context), v, context, graph)
            elif name[:1] == "@" and name not in ("@id", "@index"):
                raise ValueError(f"{name} is not supported")
            elif "@reverse" in found:
                self.reversed(subject, name, found, value, context, graph)
            elif name[:1] != "@" and ":" in name:
                for v in self.values(value, found, context) if found.get("@type") != "@json" else [value]:
                    if (x := self.value(v, found, context, graph)) is not None:
                        self.out.append((graph, subject, self.ref(name, {}), x))
        return subject

    def reversed(self, subject: Term, name: str, found: dict, value, context: dict, graph) -> None:
        for v in self.values(value, found, context):
            other = self.value(v, {**found, "@type": found.get("@type", "@id")}, context, graph)
            if other is None or other[0] == 3:
                raise ValueError(f"{name} reversed needs nodes")
            self.out.append((graph, other, _iri(name), subject))


#: What readers raise over a document that is wrong.
FAULTS = (ValueError, KeyError, IndexError, TypeError, AttributeError, ET.ParseError)
READERS = {TURTLE: _Turtle, "application/trig": _Turtle, RDF_XML: _RdfXml, JSON_LD: _JsonLd}
_COLUMNS = ["uri", "g", "s", "p", "o"]


def documents(df: DataFrame, strict: bool = True, keep: bool = False, base: bool = False) -> DataFrame:
    """Quads of nested documents: columns uri, content (string) and media_type; g is null where a document names none.

    A document that cannot be read is an error or, if not strict, gives what was read
    before the fault. Each quad carries its document's uri in column uri. With keep a
    column doc tells rows apart that share a uri, and every document has a row without
    a quad besides. With base relative IRIs are resolved against the document's uri.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, part = 0, TaskContext.get().partitionId()
        for frame in frames:
            rows = []
            for uri, content, media in zip(frame["uri"], frame["content"], frame["media_type"], strict=True):
                if media not in READERS:
                    raise ValueError(f"{uri} cannot be read: nothing reads {media!r}")
                doc, number = f"{part}-{number}", number + 1
                scope = scope_name(uri)
                if keep:
                    scope += f"{doc}-"
                    rows.append((uri, None, None, None, None, doc))
                try:
                    for g, s, p, o in READERS[media](content, scope, (uri or "") if base else "").run():
                        rows.append((uri, *(None if t is None else dict(zip(("kind", "lex", "dt", "lang"), t, strict=True)) for t in (g, s, p, o)), doc))
                except FAULTS as e:
                    if strict:
                        raise ValueError(f"{uri} cannot be read: {e}") from e
            made = pd.DataFrame(rows, columns=[*_COLUMNS, "doc"])
            yield made if keep else made[_COLUMNS]

    return df.select("uri", "content", "media_type").mapInPandas(run, "uri string, " + QUAD + (", doc string" if keep else ""))
