"""Values, patterns and times at their edges: one bad row gives null there and nothing else."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quadloom.functions import scalar, terms
from quadloom.operators import aggregates as agg

INT, DEC, DBL, FLT, STR, TIME = terms.INTEGER, terms.DECIMAL, terms.DOUBLE, terms.FLOAT, terms.STRING, terms.DATETIME


def frame(spark, rows, width=1):
    """Literals (lex, dt), as many a row as width says."""
    kind = ", ".join(f"c{k} struct<kind:tinyint,lex:string,dt:string,lang:string>" for k in range(width))
    rows = [r if width > 1 else (r,) for r in rows]
    return spark.createDataFrame([(n, *(x and (3, x[0], x[1], None) for x in r)) for n, r in enumerate(rows)], f"n int, {kind}").repartition(2)


def got(df, *columns):
    out = df.select("n", *columns).orderBy("n").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def test_numbers_compare_by_all_their_digits(spark):
    big = 10**24
    pairs = [(str(big), str(big + 1)), (str(-big - 1), str(-big)), ("9007199254740992", "9007199254740993"), ("0.000000001", "0.000000002"), ("-0.5", "-.25"), ("-1.5", "-1.2"), ("99999999999999999999999999.1", "99999999999999999999999999.2"), ("-.1", "+0")]
    rows = [((a, INT if "." not in a else DEC), (b, INT if "." not in b else DEC)) for a, b in pairs]
    df = frame(spark, rows + [(b, a) for a, b in rows] + [(a, a) for a, _ in rows], 2)
    a, b = F.col("c0"), F.col("c1")
    n = len(rows)
    assert got(df, terms.less(a, b).alias("l"), terms.equal(a, b).alias("e"), terms.greater_equal(a, b).alias("g")) == [(True, False, False)] * n + [(False, False, True)] * n + [(False, True, True)] * n


def test_order_of_large_numbers(spark):
    values = [2**53 + 1, 2**53, -(2**53) - 1, -(2**53), 10**24 + 1, 10**24, -(10**30), 3]
    df = frame(spark, [(str(v), INT) for v in values] + [("2.5", DEC), ("1e3", DBL), ("10.0", DEC)])
    ordered = [float(r.c0.lex) if "e" in r.c0.lex or "." in r.c0.lex else int(r.c0.lex) for r in df.orderBy(terms.sort_key(F.col("c0"))).collect()]
    assert ordered == sorted([*values, 2.5, 1000.0, 10.0])
    few = df.where(f"n in ({values.index(2**53)}, {values.index(2**53 + 1)}, {values.index(-(2**53))}, {values.index(-(2**53) - 1)})")
    least, most = few.agg(agg.least_term(F.col("c0")).lex.alias("a"), agg.greatest_term(F.col("c0")).lex.alias("b")).first()
    assert (least, most) == (str(-(2**53) - 1), str(2**53 + 1))


def test_floats_add_as_floats(spark):
    df = frame(spark, [(("0.1", FLT), ("0.2", FLT)), (("0.1", FLT), ("0.2", DBL)), (("1", INT), ("0.1", FLT)), (("INF", FLT), ("1", FLT))], 2)
    assert [(x.lex, x.dt) for x in got(df, scalar.add(F.col("c0"), F.col("c1")).alias("s"))] == [("0.3", FLT), ("0.30000000000000004", DBL), ("1.1", FLT), ("INF", FLT)]


@pytest.mark.parametrize(("start", "length", "want"), [(2, None, "2345"), (1.5, 2.6, "234"), (0, 3, "12"), (float("nan"), 3, ""), (1, float("nan"), ""), (-42, float("inf"), "12345"), (float("-inf"), float("inf"), ""), (5, 0, ""), (9, None, ""), (-1, 3, "1"), (2.5, None, "345")])
def test_substr_as_xpath_has_it(spark, start, length, want):
    df = frame(spark, [("12345", STR), None])
    found = scalar.substr(F.col("c0"), F.lit(start), None if length is None else F.lit(length))
    assert got(df, found.lex.alias("s")) == [want, None]


def test_dates_that_do_not_exist(spark):
    good = ["2024-02-29T00:00:00", "2000-02-29T23:59:59.5Z", "-0044-03-15T12:00:00+05:30", "12345-12-31T24:00:00"]
    bad = ["2023-02-29T00:00:00", "1900-02-29T00:00:00", "2024-13-01T00:00:00", "2024-00-10T00:00:00", "2024-04-31T00:00:00", "2024-01-32T00:00:00", "2024-01-01T25:00:00", "2024-01-01T24:00:01", "2024-01-01T00:60:00", "2024-01-01T00:00:60", "2024-01-01", "x"]
    df = frame(spark, [(x, TIME) for x in good + bad])
    assert got(df, scalar.year(F.col("c0")).lex.alias("y")) == ["2024", "2000", "-0044".replace("-0044", "-44"), "12345"] + [None] * len(bad)


PATTERNS = [
    ("abc", "b", "", "true"), ("abc", "B", "i", "true"), ("a\nb", "a.b", "", "false"), ("a\nb", "a.b", "s", "true"), ("a\nb", "^b", "m", "true"), ("ab", "a b", "x", "true"),
    ("a.b", "a.b", "q", "true"), ("axb", "a.b", "q", "false"), (r"a\Eb", r"\Eb", "q", "true"), ("A-[b]", "a-[B]", "qi", "true"), ("a", "a", "z", None), ("a", "(", "", None), ("a", "[z-a]", "", None), ("a", "*a", "", None),
    ("hello", "^[a-z-[aeiou]]", "", "true"), ("ello", "^[a-z-[aeiou]]", "", "false"), ("b1", "^[^a-[b]]", "", "false"), ("c1", "^[^a-[b]]", "", "true"), ("e", "^[a-z-[^aeiou]]$", "", "true"), ("x", "^[a-z-[^aeiou]]$", "", "false"),
    ("_é", r"^\i\c$", "", "true"), ("9", r"^\i$", "", "false"), ("9", r"^\c$", "", "true"), (" ", r"^\C\I?$", "", "true"), (r"\i", r"^\\i$", "", "true"), ("é", r"^\p{IsLatin-1Supplement}$", "", "true"), ("é", r"^\p{IsBasicLatin}$", "", "false"), ("é", r"^\P{IsBasicLatin}$", "", "true"),
    ("ÄÖ", "äö", "i", "true"), ("a-[bc]", "a-[bc]", "", "false"), ("a-b", "a-[bc]", "", "true"), ("x&&y", "^x&&y$", "", "true"),
]


def test_patterns(spark):
    """Each pattern as a constant and as a value of a row; malformed ones stand beside good ones."""
    df = frame(spark, [((text, STR), (pattern, STR)) for text, pattern, _, _ in PATTERNS], 2)
    for flags in sorted({f for _, _, f, _ in PATTERNS}):
        mine = [n for n, (_, _, f, _) in enumerate(PATTERNS) if f == flags]
        found = dict(df.where(F.col("n").isin(mine)).select("n", scalar.regex(F.col("c0"), F.col("c1"), flags).lex.alias("r")).collect())
        assert found == {n: PATTERNS[n][3] for n in mine}
    constants = [scalar.regex(terms.literal(F.lit(text)), pattern, flags).lex.alias(f"r{n}") for n, (text, pattern, flags, _) in enumerate(PATTERNS)]
    assert list(spark.range(1).select(constants).first()) == [want for *_, want in PATTERNS]


REPLACEMENTS = [
    ("abcd", "b", "Z", "", "aZcd"), ("abcd", "(b)(c)", "$2$1", "", "acbd"), ("abcd", "b", "$1", "", "acd"), ("abcd", "(b)", "$12", "", "ab2cd"), ("abcd", "b", "$0$0", "", "abbcd"), ("abcd", "b", "\\$", "", "a$cd"), ("abcd", "b", "$", "", None), ("abcd", "b", "\\x", "", None),
    ("a.b.c", ".", "$1\\", "q", "a$1\\b$1\\c"), ("abcd", "x*", "Z", "", None), ("abcd", "(", "Z", "", None), ("aBcd", "b", "$3.", "i", "a.cd"), ("a(b", "\\(", "[$1]", "", "a[]b"), ("abcd", "[(]|b", "<$1>", "", "a<>cd"),
]


def test_replacements(spark):
    df = frame(spark, [tuple((x, STR) for x in r[:3]) for r in REPLACEMENTS], 3)
    for flags in ("", "i", "q"):
        mine = [n for n, r in enumerate(REPLACEMENTS) if r[3] == flags]
        found = dict(df.where(F.col("n").isin(mine)).select("n", scalar.replace(F.col("c0"), F.col("c1"), F.col("c2"), flags).lex.alias("r")).collect())
        assert found == {n: REPLACEMENTS[n][4] for n in mine}
    constants = [scalar.replace(terms.literal(F.lit(text)), pattern, by, flags).lex.alias(f"r{n}") for n, (text, pattern, by, flags, _) in enumerate(REPLACEMENTS)]
    assert list(spark.range(1).select(constants).first()) == [r[4] for r in REPLACEMENTS]


def test_hashes(spark):
    texts = ["", "abc", "Grüße 東京"]
    df = frame(spark, [(x, STR) for x in texts])
    for made, want in ((scalar.md5, "md5"), (scalar.sha1, "sha1"), (scalar.sha256, "sha256"), (scalar.sha384, "sha384"), (scalar.sha512, "sha512")):
        assert got(df, made(F.col("c0")).lex.alias("h")) == [hashlib.new(want, x.encode()).hexdigest() for x in texts]


def test_iris_with_characters_that_none_has(spark):
    df = frame(spark, [("http://h/ok", STR), ("a b", STR), ("a>b", STR), ("a\\b", STR), ("é", STR)])
    assert [x and x.lex for x in got(df, scalar.iri(F.col("c0"), "http://h/").alias("i"))] == ["http://h/ok", None, None, None, "http://h/é"]
    odd = ["http://h/a b>c", 'x"y{}|^`\\', "\n\x00\x1f", "fine"]
    made = spark.createDataFrame([(n, (2, x, None, None)) for n, x in enumerate(odd)], "n int, t struct<kind:tinyint,lex:string,dt:string,lang:string>")
    for text, x in zip(got(made, terms.n_triples(F.col("t")).alias("x")), odd, strict=True):
        assert re.fullmatch(r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-F]{4})*>", text)
        assert re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), text) == f"<{x}>"


def test_exact_values_by_brute_force(spark):
    from decimal import Decimal

    rng = random.Random(2)
    text = lambda: f"{rng.choice(['', '-', '+'])}{rng.randrange(10 ** rng.randint(1, 30))}{'.' + str(rng.randrange(10**9)) if rng.random() < 0.5 else ''}"
    pairs = [(text(), text()) for _ in range(80)] + [(x, x + "0") if "." in x else (x, "0" + x.lstrip("+-")) for x in (text() for _ in range(20))]
    df = frame(spark, [tuple((x, DEC) for x in p) for p in pairs], 2)
    assert got(df, terms.less(F.col("c0"), F.col("c1")).alias("l"), terms.equal(F.col("c0"), F.col("c1")).alias("e")) == [(Decimal(a) < Decimal(b), Decimal(a) == Decimal(b)) for a, b in pairs]
