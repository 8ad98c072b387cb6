"""RDF terms as a struct column, and SPARQL's value semantics over it.

A term is struct<kind, lex, dt, lang>: kind 1 is a blank node, 2 an IRI, 3 a literal.
A null term is unbound, and a null value is SPARQL's error: Kleene logic over nulls
is then SPARQL's logic over errors. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK, IRI, LITERAL = 1, 2, 3
TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
STRING, BOOLEAN, INTEGER, DECIMAL, FLOAT, DOUBLE, DATETIME = (XSD + n for n in ("string", "boolean", "integer", "decimal", "float", "double", "dateTime"))
LANG_STRING, TYPE, SUBCLASS = RDF + "langString", RDF + "type", RDFS + "subClassOf"

#: Datatypes derived from xsd:integer.
INTEGERS = [XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
#: Lexical forms of numbers and times.
INTEGER_FORM, DECIMAL_FORM = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
DOUBLE_FORM = r"^(?:[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|[+-]?INF|NaN)$"
DATETIME_FORM = r"^(-?[0-9]{4,})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-4]):([0-5][0-9]):([0-5][0-9](?:\.[0-9]+)?)(Z|[+-](?:0[0-9]|1[0-4]):[0-5][0-9])?$"
#: Characters that an IRI has only as escapes.
NO_IRI = r"[\x00-\x20<>\"{}|^`\\]"


def _term(kind: int, lex: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    made = F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.cast("string").alias("lex"), (none if dt is None else dt).alias("dt"), (none if lang is None else lang).alias("lang"))
    return F.when(lex.isNotNull(), made)


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use names it; keeps long expressions from multiplying when they nest."""
    return F.transform(F.array(value), use)[0]


def iri(lex: Column | str) -> Column:
    """IRI of a column, or of a Python string as a constant."""
    return _term(IRI, F.lit(lex) if isinstance(lex, str) else lex)


def blank(lex: Column) -> Column:
    return _term(BLANK, lex)


def literal(lex: Column, dt: str = STRING) -> Column:
    return _term(LITERAL, lex, F.lit(dt))


def typed(lex: Column, dt: Column) -> Column:
    """Literal whose datatype is a column of IRIs."""
    return _term(LITERAL, lex, dt)


def tagged(lex: Column, lang: Column) -> Column:
    """Language-tagged string; tags compare in lower case."""
    return _term(LITERAL, lex, F.lit(LANG_STRING), F.lower(lang))


def native_datatype(kind: T.DataType) -> str:
    """Datatype of the literals that of_native makes of a type's cells."""
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, T.DecimalType):
        return DECIMAL
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return DOUBLE
    return DATETIME if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else STRING


def of_native(c: Column, kind: T.DataType) -> Column:
    """A table's cell as a literal; null stays unbound."""
    dt, text = native_datatype(kind), c.cast("string")
    if dt == DOUBLE:
        text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(text)
    if dt == DATETIME:
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return literal(text, dt)


# what a term is


def is_string(t: Column) -> Column:
    return (t.kind == LITERAL) & t.dt.isin(STRING, LANG_STRING)


def is_integer(t: Column) -> Column:
    return (t.kind == LITERAL) & t.dt.isin(INTEGERS) & t.lex.rlike(INTEGER_FORM)


def is_exact(t: Column) -> Column:
    return is_integer(t) | ((t.kind == LITERAL) & (t.dt == DECIMAL) & t.lex.rlike(DECIMAL_FORM))


def is_numeric(t: Column) -> Column:
    return is_exact(t) | ((t.kind == LITERAL) & t.dt.isin(FLOAT, DOUBLE) & t.lex.rlike(DOUBLE_FORM))


def parsed(lex: Column, kind: str = "double") -> Column:
    """A number's lexical form as double or float; null if Spark cannot read it."""
    return F.when(lex.endswith("INF"), F.replace(lex, F.lit("INF"), F.lit("Infinity"))).otherwise(lex).try_cast(kind)


def double_of(t: Column, of: str | None = None) -> Column:
    """Numeric value as a double, null for anything else; of is the datatype of all literals, where it is known."""
    return F.when(is_numeric(t) if of not in (FLOAT, DOUBLE) else t.lex.rlike(DOUBLE_FORM), parsed(t.lex))


def decimal_of(t: Column) -> Column:
    """Value of an integer or decimal at 28 digits, 8 of them fractional."""
    return F.when(is_exact(t), t.lex.try_cast("decimal(28,8)"))


def exact_of(t: Column) -> Column:
    """Value of an integer or decimal as its whole and fractional parts, which compare in that order; null beyond 38 digits on either side."""
    whole = F.regexp_extract(t.lex, r"^([+-]?[0-9]*)", 1)
    fraction = F.concat(F.when(F.startswith(t.lex, F.lit("-")), "-").otherwise(""), F.lit("0."), F.regexp_extract(t.lex, r"\.([0-9]*)", 1))
    part = F.when(whole.rlike("[0-9]"), whole.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    return F.when(is_exact(t) & part.isNotNull() & (F.length(fraction) <= 40), F.struct(part.alias("whole"), fraction.try_cast("decimal(38,37)").alias("fraction")))


def boolean_of(t: Column) -> Column:
    return F.when((t.kind == LITERAL) & (t.dt == BOOLEAN), F.when(t.lex.isin("true", "1"), True).when(t.lex.isin("false", "0"), False))


def time_of(t: Column) -> Column:
    """Instant of a dateTime; without an offset it is taken as UTC. Null for dates that don't exist."""
    return F.when((t.kind == LITERAL) & (t.dt == DATETIME) & t.lex.rlike(DATETIME_FORM), t.lex.try_cast("timestamp"))


def string_of(t: Column) -> Column:
    """Text of a string literal, null for anything else."""
    return F.when(is_string(t), t.lex)


def effective(t: Column) -> Column:
    """Effective boolean value: false for booleans and numbers with an ill-formed text, null (an error) for terms that have none."""
    number = parsed(t.lex)
    fine = (number != 0) & ~F.isnan(number) & t.lex.rlike(DOUBLE_FORM) & (~t.dt.isin(INTEGERS) | t.lex.rlike(INTEGER_FORM))
    return F.when(t.dt == BOOLEAN, t.lex.isin("true", "1")).when(t.dt.isin(STRING, LANG_STRING), F.length(t.lex) > 0).when(t.dt.isin(*INTEGERS, DECIMAL, FLOAT, DOUBLE), F.coalesce(fine, F.lit(False)))


# comparison by value


def _compared(a: Column, b: Column, op) -> Column:
    """op over the pair's common value space, null where there is none."""
    return F.coalesce(
        F.when(is_exact(a) & is_exact(b), op(exact_of(a), exact_of(b))),
        F.when(is_numeric(a) & is_numeric(b), op(double_of(a), double_of(b))),
        F.when(is_string(a) & is_string(b) & a.dt.eqNullSafe(b.dt) & a.lang.eqNullSafe(b.lang), op(a.lex, b.lex)),
        op(boolean_of(a), boolean_of(b)),
        op(time_of(a), time_of(b)),
    )


def equal(a: Column, b: Column) -> Column:
    """SPARQL's =: values where both have one, else the same term; two different literals of unknown types are an error."""
    known = lambda t: is_numeric(t) | is_string(t) | boolean_of(t).isNotNull() | time_of(t).isNotNull()
    return F.coalesce(_compared(a, b, lambda x, y: x == y), F.when(a == b, True), F.when((a.kind != LITERAL) | (b.kind != LITERAL) | (known(a) & known(b)), False))


def less(a: Column, b: Column) -> Column:
    return _compared(a, b, lambda x, y: x < y)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def less_equal(a: Column, b: Column) -> Column:
    return _compared(a, b, lambda x, y: x <= y)


def greater_equal(a: Column, b: Column) -> Column:
    return less_equal(b, a)


def one_of(a: Column, *others: Column) -> Column:
    """IN: a disjunction of value comparisons, with its errors."""
    out = F.lit(False)
    for b in others:
        out = out | equal(a, b)
    return out


def same_term(a: Column, b: Column) -> Column:
    return a == b


def sort_key(t: Column) -> Column:
    """Order of terms: unbound, blank nodes, IRIs, literals; literals by value (numbers that round to one double by all their digits), then by text."""
    return F.struct(F.coalesce(t.kind, F.lit(0).cast("tinyint")).alias("kind"), double_of(t).alias("number"), exact_of(t).alias("exact"), time_of(t).alias("time"), t.lex.alias("lex"), t.dt.alias("dt"), t.lang.alias("lang"))


# text forms


def escaped(text: Column) -> Column:
    """Backslash escapes of N-Triples."""
    for raw, sign in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(sign))
    return text


def escaped_iri(lex: Column) -> Column:
    """An IRI's text with the characters that it may not have as numbered escapes."""
    sign = lambda c: F.when(c.rlike(NO_IRI), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c)
    return F.when(lex.rlike(NO_IRI), F.array_join(F.transform(F.regexp_extract_all(lex, F.lit("(?s)."), F.lit(0)), sign), "")).otherwise(lex)


def n_triples(t: Column) -> Column:
    """The term in N-Triples."""
    tail = F.when(t.lang.isNotNull(), F.concat(F.lit("@"), t.lang)).when(t.dt == STRING, "").otherwise(F.concat(F.lit("^^<"), escaped_iri(t.dt), F.lit(">")))
    return F.when(t.kind == IRI, F.concat(F.lit("<"), escaped_iri(t.lex), F.lit(">"))).when(t.kind == BLANK, F.concat(F.lit("_:"), t.lex)).otherwise(F.concat(F.lit('"'), escaped(t.lex), F.lit('"'), tail))
