"""SPARQL 1.1's scalar functions over term columns. An error is a null term."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import iris
from quadloom.functions import terms as t


def _of(term: Column, text: Column) -> Column:
    """text with the datatype and language of term."""
    return F.when(t.is_string(term) & text.isNotNull(), F.struct(term.kind.alias("kind"), text.alias("lex"), term.dt.alias("dt"), term.lang.alias("lang")))


def _bool(c: Column) -> Column:
    return t.literal(c.cast("string"), t.BOOLEAN)


def _int(c: Column) -> Column:
    return t.literal(c.cast("string"), t.INTEGER)


def _made(dt: str, value: Column) -> Column:
    """Literal of a long expression, null if the expression is; nullif names it once and stays in generated code."""
    whole = lambda lex: F.struct(F.lit(t.LITERAL).cast("tinyint").alias("kind"), lex.cast("string").alias("lex"), F.lit(dt).alias("dt"), F.lit(None).cast("string").alias("lang"))
    return F.nullif(whole(value), whole(F.lit(None)))


def _fits(a: Column, b: Column) -> Column:
    """Arguments are compatible if the second has no language or the first's."""
    return t.is_string(a) & t.is_string(b) & (b.lang.isNull() | b.lang.eqNullSafe(a.lang))


# terms


def str_(a: Column) -> Column:
    return t.literal(F.when(a.kind != t.BLANK, a.lex))


def lang(a: Column) -> Column:
    return t.literal(F.when(a.kind == t.LITERAL, F.coalesce(a.lang, F.lit(""))))


def datatype(a: Column) -> Column:
    return t.iri(F.when(a.kind == t.LITERAL, a.dt))


def iri(a: Column, base: str = "") -> Column:
    """IRI of a string or IRI, resolved against base; an error if it has a character that no IRI has."""
    made = iris.resolved(a.lex, base)
    return t.iri(F.when(((a.kind == t.IRI) | (a.dt == t.STRING)) & ~made.rlike(t.NO_IRI), made))


def bnode(row: Column, a: Column | None = None) -> Column:
    """A blank node for the row, or for the row and a string; row: what identifies the solution."""
    return t.blank(F.concat(F.lit("b"), F.sha1(F.concat_ws("\x1f", row.cast("string"), *([] if a is None else [t.string_of(a)])))))


def strdt(a: Column, dt: Column) -> Column:
    return F.when((a.dt == t.STRING) & (dt.kind == t.IRI), F.struct(a.kind.alias("kind"), a.lex.alias("lex"), dt.lex.alias("dt"), F.lit(None).cast("string").alias("lang")))


def strlang(a: Column, tag: Column) -> Column:
    return t.tagged(F.when((a.dt == t.STRING) & (tag.dt == t.STRING), a.lex), tag.lex)


def uuid() -> Column:
    return t.iri(F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))


def struuid() -> Column:
    return t.literal(F.expr("uuid()"))


def is_iri(a: Column) -> Column:
    return _bool(a.kind == t.IRI)


def is_blank(a: Column) -> Column:
    return _bool(a.kind == t.BLANK)


def is_literal(a: Column) -> Column:
    return _bool(a.kind == t.LITERAL)


def is_numeric(a: Column) -> Column:
    return _bool(F.when(a.isNotNull(), F.coalesce(t.is_numeric(a), F.lit(False))))


def same_term(a: Column, b: Column) -> Column:
    return _bool(t.same_term(a, b))


# strings


def strlen(a: Column) -> Column:
    return _int(F.char_length(t.string_of(a)))


def substr(a: Column, start: Column, length: Column | None = None) -> Column:
    """Characters whose place p has round(start) <= p < round(start) + round(length), as XPath has it; places begin at 1, and no place compares with NaN."""
    text = t.string_of(a)
    rounded = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x + 0.5).cast("double")).otherwise(x)
    begin = rounded(start.cast("double"))
    behind = F.char_length(text) + F.lit(1.0) if length is None else F.least(begin + rounded(length.cast("double")), F.char_length(text) + F.lit(1.0))
    first = F.greatest(begin, F.lit(1.0))
    some = ~F.isnan(begin) & ~F.isnan(behind) & (behind > first)
    if length is not None:
        some = some & ~F.isnan(begin + rounded(length.cast("double")))
    return _of(a, F.when(text.isNotNull() & begin.isNotNull() & behind.isNotNull(), F.when(some, F.substring(text, first.try_cast("int"), (behind - first).try_cast("int"))).otherwise("")))


def ucase(a: Column) -> Column:
    return _of(a, F.upper(a.lex))


def lcase(a: Column) -> Column:
    return _of(a, F.lower(a.lex))


def strstarts(a: Column, b: Column) -> Column:
    return _bool(F.when(_fits(a, b), F.startswith(a.lex, b.lex)))


def strends(a: Column, b: Column) -> Column:
    return _bool(F.when(_fits(a, b), F.endswith(a.lex, b.lex)))


def contains(a: Column, b: Column) -> Column:
    return _bool(F.when(_fits(a, b), F.contains(a.lex, b.lex)))


def strbefore(a: Column, b: Column) -> Column:
    """Text before b; a plain empty string on a miss."""
    at = F.position(b.lex, a.lex)
    return F.when(_fits(a, b), F.when(at > 0, _of(a, F.substring(a.lex, F.lit(1), at - 1))).otherwise(t.literal(F.lit(""))))


def strafter(a: Column, b: Column) -> Column:
    at = F.position(b.lex, a.lex)
    return F.when(_fits(a, b), F.when(at > 0, _of(a, F.substring(a.lex, at + F.char_length(b.lex), F.char_length(a.lex)))).otherwise(t.literal(F.lit(""))))


def encode_for_uri(a: Column) -> Column:
    text = F.url_encode(t.string_of(a))
    for raw, sign in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(text, F.lit(raw), F.lit(sign))
    return t.literal(text)


def concat(*parts: Column) -> Column:
    """The language stays if all parts have the same one."""
    text = F.concat(*(t.string_of(p) for p in parts))
    same = F.lit(True)
    for p in parts[1:]:
        same = same & p.lang.eqNullSafe(parts[0].lang)
    return F.when(text.isNotNull(), F.when(same & parts[0].lang.isNotNull(), t.tagged(text, parts[0].lang)).otherwise(t.literal(text)))


def lang_matches(tag: Column, wanted: Column) -> Column:
    a, b = F.lower(tag.lex), F.lower(wanted.lex)
    return _bool(F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))


#: XPath's \\i and \\c, the characters that XML names begin with and go on with.
NAME_START = ":A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
NAME = NAME_START + "\\-.0-9\u00b7\u0300-\u036f\u203f-\u2040"
MEMBERS = r"(?:\\.|[^\[\]\\])*?"
#: What XPath's patterns write otherwise than Java's: blocks of characters, and classes less other classes.
TRANSLATED = [
    (r"\\([pP])\{Is", r"\\$1{In"),
    (rf"\[\^({MEMBERS})-\[\^({MEMBERS})\]\]", "[[^$1]&&[$2]]"),
    (rf"\[\^({MEMBERS})-\[({MEMBERS})\]\]", "[[^$1]&&[^$2]]"),
    (rf"\[({MEMBERS})-\[\^({MEMBERS})\]\]", "[[$1]&&[$2]]"),
    (rf"\[({MEMBERS})-\[({MEMBERS})\]\]", "[[$1]&&[^$2]]"),
]


def _translated(text: Column) -> Column:
    """An XPath pattern in Java's syntax: subtraction of classes, blocks, and the characters of names."""
    text = F.replace(text, F.lit("&&"), F.lit("&\\&"))
    for at, by in TRANSLATED:
        text = F.regexp_replace(text, at, by)
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    inside = lambda x: F.when(x == "\\i", f"[{NAME_START}]").when(x == "\\I", f"[^{NAME_START}]").when(x == "\\c", f"[{NAME}]").when(x == "\\C", f"[^{NAME}]").otherwise(x)
    return F.when(text.rlike(r"\\[iIcC]"), F.array_join(F.transform(parts, inside), "")).otherwise(text)


def _pattern(pattern: str | Column, flags: str) -> Column:
    """A pattern (text, or a column of string terms) in Java's syntax, with SPARQL's flags put into it; null for a malformed one or an unknown flag."""
    if set(flags) - set("smixq"):
        return F.lit(None).cast("string")
    text = F.lit(pattern) if isinstance(pattern, str) else t.string_of(pattern)
    if "q" in flags:
        text, flags = F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}\-&#\s])", "\\\\$1"), "i" * ("i" in flags)
    else:
        text = _translated(text)
    inline = "".join(sorted(set(flags) & set("smix")))
    if inline:
        text = F.concat(F.lit(f"(?{inline}{'u' if 'i' in inline else ''})"), text)
    if isinstance(pattern, str):
        return F.lit(_compiled(text))
    # the compiled pattern's text is the pattern; what cannot be compiled is null
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), text)


def _compiled(text: Column) -> str | None:
    """A constant pattern's text, None if it is malformed; looked at once, while the query is put together."""
    spark = SparkSession.active()
    made = spark.sql("SELECT 1").select(text.alias("text")).first()[0]
    try:
        return spark._jvm.java.util.regex.Pattern.compile(made).pattern()
    except (Py4JJavaError, IllegalArgumentException):
        return None


def regex(a: Column, pattern: str | Column, flags: str = "") -> Column:
    """An error for a malformed pattern."""
    return _bool(F.regexp_like(t.string_of(a), _pattern(pattern, flags)))


def _replacement(by: str | Column, pattern: Column, flags: str) -> Column:
    """A replacement in which every group exists: one beyond the pattern's is empty. Null if a backslash or dollar sign stands alone; with flag q all of it is text."""
    text = F.lit(by) if isinstance(by, str) else t.string_of(by)
    if "q" in flags:
        return F.regexp_replace(text, r"([\\$])", "\\\\$1")
    bare = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\.", ""), r"\[[^\]]*\]", "")
    groups = F.regexp_count(bare, F.lit(r"\((?!\?)"))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|\$[0-9]+|[^\\$]+"), F.lit(0))
    known = lambda x: F.when(x.rlike(r"^\$") & (F.substring(x, 2, 1).try_cast("int") > groups), F.substring(x, 3, 1 << 20)).otherwise(x)
    return F.when(text.rlike(r"^(?:[^\\$]|\\[\\$]|\$[0-9])*+$"), F.array_join(F.transform(parts, known), ""))


def replace(a: Column, pattern: str | Column, by: str | Column, flags: str = "") -> Column:
    """An error if the pattern is malformed or matches the empty string, or if the replacement is malformed."""
    found = _pattern(pattern, flags).cast("string")
    text = F.regexp_replace(t.string_of(a), found, _replacement(by, found, flags))
    return _of(a, F.when(~F.regexp_like(F.lit(""), found), text))


# numbers


def _numeric(a: Column, whole, exact, approximate) -> Column:
    """Result in the argument's own type: whole over integers of 38 digits, exact over decimals, approximate over doubles."""
    integer, number = a.lex.try_cast("decimal(38,0)"), t.parsed(a.lex)
    value = (
        F.when(a.dt.isin(t.INTEGERS), F.when(a.lex.rlike(t.INTEGER_FORM), whole(integer).cast("string")))
        .when(a.dt == t.DECIMAL, _plain(exact(t.decimal_of(a))))
        .when(a.dt.isin(t.FLOAT, t.DOUBLE) & a.lex.rlike(t.DOUBLE_FORM), _double_text(approximate(number)))
    )
    dt = F.when(a.dt.isin(t.INTEGERS), t.INTEGER).otherwise(a.dt)
    return t.once(F.struct(value.alias("lex"), dt.alias("dt")), lambda x: t.typed(x.lex, x.dt))


def _plain(x: Column) -> Column:
    """A decimal without trailing zeros; null beyond 28 digits."""
    return F.regexp_replace(F.regexp_replace(x.try_cast("decimal(28,8)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _double_text(x: Column) -> Column:
    return F.replace(x.cast("string"), F.lit("Infinity"), F.lit("INF"))


def _same(x: Column) -> Column:
    return x


def _stepped(step):
    """A rounding that Spark does by way of 64-bit integers; doubles that large have no fraction, and stay."""
    return lambda x: F.when(F.abs(x) < float(1 << 52), step(x).cast("double")).otherwise(x)


def abs_(a: Column) -> Column:
    return _numeric(a, F.abs, F.abs, F.abs)


def ceil(a: Column) -> Column:
    return _numeric(a, _same, F.ceil, _stepped(F.ceil))


def floor(a: Column) -> Column:
    return _numeric(a, _same, F.floor, _stepped(F.floor))


def round_(a: Column) -> Column:
    """Ties go up."""
    return _numeric(a, _same, lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")), _stepped(lambda x: F.floor(x + 0.5)))


def rand() -> Column:
    return t.literal(F.rand().cast("string"), t.DOUBLE)


def _arithmetic(a: Column, b: Column, whole, exact, approximate) -> Column:
    """Integers by whole over 38 digits, exact numbers by exact over decimals of a given type, others over doubles; null (an error) beyond the digits."""
    integers = a.dt.isin(t.INTEGERS) & b.dt.isin(t.INTEGERS)
    valid = t.is_numeric(a) & t.is_numeric(b)
    some = _plain(exact(t.decimal_of(a), t.decimal_of(b)))
    all_ = some if whole is None else whole(a.lex.try_cast("decimal(38,0)"), b.lex.try_cast("decimal(38,0)")).cast("string")
    both = a.dt.isin(*t.INTEGERS, t.DECIMAL) & b.dt.isin(*t.INTEGERS, t.DECIMAL)
    double = (a.dt == t.DOUBLE) | (b.dt == t.DOUBLE)
    rough = lambda kind: _double_text(approximate(t.parsed(a.lex, kind), t.parsed(b.lex, kind)).cast(kind))
    value = F.when(valid, F.when(integers, all_).when(both, some).when(double, rough("double")).otherwise(rough("float")))
    floats = F.when(double, t.DOUBLE).otherwise(t.FLOAT)
    dt = F.when(integers, F.lit(t.DECIMAL if whole is None else t.INTEGER)).when(both, t.DECIMAL).otherwise(floats)
    return t.once(F.struct(value.alias("lex"), dt.alias("dt")), lambda x: t.typed(x.lex, x.dt))


def add(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, F.try_add, F.try_add, F.try_add)


def subtract(a: Column, b: Column) -> Column:
    return _arithmetic(a, b, F.try_subtract, F.try_subtract, F.try_subtract)


def multiply(a: Column, b: Column) -> Column:
    def exact(x: Column, y: Column) -> Column:  # Spark keeps 8 places of a product only for narrower factors
        return F.coalesce(F.try_multiply(x.try_cast("decimal(20,8)"), y.try_cast("decimal(20,8)")).try_cast("decimal(28,8)"), F.try_multiply(x, y).try_cast("decimal(28,8)"))

    return _arithmetic(a, b, F.try_multiply, exact, F.try_multiply)


def divide(a: Column, b: Column) -> Column:
    """Integers divide to a decimal; division of exact numbers by zero is an error, of doubles it is not."""

    def approximate(x: Column, y: Column) -> Column:
        nothing = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return F.coalesce(F.try_divide(x, y), nothing)

    return _arithmetic(a, b, None, F.try_divide, approximate)


def minus(a: Column) -> Column:
    return _numeric(a, F.negative, F.negative, F.negative)


# times, read from the lexical form so that the offset is not applied


def now() -> Column:
    return t.literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), t.DATETIME)


def _part(a: Column, group: int) -> Column:
    """A part of a dateTime; null for days that their month does not have."""
    year = F.regexp_extract(a.lex, t.DATETIME_FORM, 1).try_cast("bigint")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    none = a.lex.rlike(r"^-?[0-9]+-(?:(?:0[469]|11)-31|02-3[01])T|T24:(?!00:00(?:\.0+)?(?:Z|[+-]|$))") | (a.lex.rlike(r"^-?[0-9]+-02-29T") & ~leap)
    return F.when((a.dt == t.DATETIME) & a.lex.rlike(t.DATETIME_FORM) & ~none, F.regexp_extract(a.lex, t.DATETIME_FORM, group))


def year(a: Column) -> Column:
    return _int(_part(a, 1).try_cast("bigint"))


def month(a: Column) -> Column:
    return _int(_part(a, 2).try_cast("bigint"))


def day(a: Column) -> Column:
    return _int(_part(a, 3).try_cast("bigint"))


def hours(a: Column) -> Column:
    return _int(_part(a, 4).try_cast("bigint"))


def minutes(a: Column) -> Column:
    return _int(_part(a, 5).try_cast("bigint"))


def seconds(a: Column) -> Column:
    return t.literal(_plain(_part(a, 6).try_cast("decimal(28,8)")), t.DECIMAL)


def tz(a: Column) -> Column:
    return t.literal(_part(a, 7))


def timezone(a: Column) -> Column:
    """The offset as a dayTimeDuration; an error where there is none."""
    zone = _part(a, 7)
    sign, h, m = (F.regexp_extract(zone, r"([+-])([0-9]{2}):([0-9]{2})", k) for k in (1, 2, 3))
    hour, minute = h.try_cast("int"), m.try_cast("int")
    text = F.concat(F.when(sign == "-", "-").otherwise(""), F.lit("PT"), F.when(hour > 0, F.concat(hour.cast("string"), F.lit("H"))).otherwise(""), F.when(minute > 0, F.concat(minute.cast("string"), F.lit("M"))).otherwise(""))
    return t.literal(F.when((zone == "Z") | ((hour == 0) & (minute == 0)), "PT0S").when(zone != "", text), t.XSD + "dayTimeDuration")


# hashes


def md5(a: Column) -> Column:
    return t.literal(F.md5(t.string_of(a)))


def sha1(a: Column) -> Column:
    return t.literal(F.sha1(t.string_of(a)))


def sha256(a: Column) -> Column:
    return t.literal(F.sha2(t.string_of(a), 256))


def sha384(a: Column) -> Column:
    return t.literal(F.sha2(t.string_of(a), 384))


def sha512(a: Column) -> Column:
    return t.literal(F.sha2(t.string_of(a), 512))


# casts: one branch for each datatype that can be cast, so that a row is tested once. Where the datatype of all of a
# column's literals is known (of), as it is for a table's columns, only its branch is made.


def _cast(a: Column, of: str | None, whole, exact, approximate, text, flag) -> Column:
    """Values by the argument's datatype, of its lexical form; flag is given the value itself."""
    lex = a.lex
    branches = (
        ((t.FLOAT, t.DOUBLE), F.when(lex.rlike(t.DOUBLE_FORM), approximate(lex))),
        (t.INTEGERS, F.when(lex.rlike(t.INTEGER_FORM), whole(lex))),
        ((t.DECIMAL,), F.when(lex.rlike(t.DECIMAL_FORM), exact(lex))),
        ((t.STRING, t.LANG_STRING), text(lex)),
        ((t.BOOLEAN,), flag(F.when(lex.isin("true", "1"), 1).when(lex.isin("false", "0"), 0))),
    )
    if of is not None:
        return next((value for dts, value in branches if of in dts), F.lit(None))
    out = F
    for dts, value in branches:
        out = out.when(a.dt.isin(*dts), value)
    return out


def to_boolean(a: Column, of: str | None = None) -> Column:
    def number(lex: Column) -> Column:
        value = t.parsed(lex)
        return (value != 0) & ~F.isnan(value)

    words = lambda lex: F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)
    return _made(t.BOOLEAN, _cast(a, of, number, number, number, words, lambda x: x == 1))


def to_integer(a: Column, of: str | None = None) -> Column:
    """Truncates numbers; strings must look like integers. Null beyond 38 digits."""
    wide = "decimal(38,0)"

    def approximate(lex: Column) -> Column:
        value = t.parsed(lex)
        return F.when(F.abs(value) < 9e18, value.try_cast("bigint").cast("string")).otherwise(value.try_cast(wide).cast("string"))

    whole = lambda lex: F.coalesce(lex.try_cast("bigint").cast("string"), lex.try_cast(wide).cast("string"))
    exact = lambda lex: F.coalesce(whole(F.substring_index(lex, ".", 1)), F.lit("0"))
    return _made(t.INTEGER, _cast(a, of, whole, exact, approximate, lambda lex: F.when(lex.rlike(t.INTEGER_FORM), whole(lex)), lambda x: x.cast("string")))


def to_decimal(a: Column, of: str | None = None) -> Column:
    exact = lambda lex: lex.try_cast("decimal(28,8)")
    text = lambda lex: F.when(lex.rlike(t.DECIMAL_FORM), exact(lex))
    return _made(t.DECIMAL, _plain(_cast(a, of, exact, exact, lambda lex: t.parsed(lex).try_cast("decimal(28,8)"), text, lambda x: x.cast("decimal(28,8)"))))


def _float(a: Column, of: str | None, kind: str, dt: str) -> Column:
    number = lambda lex: t.parsed(lex, kind)
    return _made(dt, _double_text(_cast(a, of, number, number, number, lambda lex: F.when(lex.rlike(t.DOUBLE_FORM), number(lex)), lambda x: x.cast(kind))))


def to_float(a: Column, of: str | None = None) -> Column:
    return _float(a, of, "float", t.FLOAT)


def to_double(a: Column, of: str | None = None) -> Column:
    return _float(a, of, "double", t.DOUBLE)


def to_string(a: Column) -> Column:
    return str_(a)


def to_datetime(a: Column) -> Column:
    return t.literal(F.when(((a.dt == t.DATETIME) | (a.dt == t.STRING)) & a.lex.rlike(t.DATETIME_FORM) & a.lex.try_cast("timestamp").isNotNull(), a.lex), t.DATETIME)


# control


def if_(condition: Column, then: Column, other: Column) -> Column:
    """An error in the condition is an error of the whole."""
    return F.when(condition, then).when(~condition, other)


def coalesce(*parts: Column) -> Column:
    return F.coalesce(*parts)


def bound(a: Column) -> Column:
    return a.isNotNull()
