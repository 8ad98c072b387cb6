"""Patterns over quads: a DataFrame of g, s, p, o terms, g being null in the default graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.operators.paths import MERGED, ensure_checkpoints
from quadloom.operators.solutions import Solutions

#: A pattern's place: "?name", an IRI as text, or a term column.
Place = str | Column


def _constant(place: Place) -> Column | None:
    if isinstance(place, str):
        return None if place.startswith("?") else terms.iri(place)
    return place


def match(quads: DataFrame, s: Place, p: Place, o: Place, g: Place | None = None, once: bool = False) -> Solutions:
    """Solutions of one triple pattern. Without g in the union of all graphs, in which a triple counts once; "?g" ranges over named graphs.

    once: no triple occurs in quads twice, as in graphs of different tables, so that the
    union needs no distinct.
    """
    places = {"s": s, "p": p, "o": o} | ({} if g is None else {"g": g})
    found = quads if g is None else quads.where("g is not null")
    columns: dict[str, Column] = {}
    for name, place in places.items():
        if (constant := _constant(place)) is not None:
            found = found.where(F.col(name) == constant)
        elif place[1:] in columns:
            found = found.where(F.col(name) == columns[place[1:]])
        else:
            columns[place[1:]] = F.col(name)
    if not once:
        found = found.select("s", "p", "o", *([] if g is None else ["g"])).distinct()
    return Solutions(found.select(*(c.alias(v) for v, c in columns.items())) if columns else found.select(F.lit(True).alias("__found")))


#: Triples of a subject from which its star is joined, not gathered.
HUB = 1 << 16


def star(quads: DataFrame, s: Place, *cells: tuple[str, Place], g: Place | None = None, once: bool = False) -> Solutions:
    """Patterns (predicate IRI, object) of one subject: one scan of their predicates, grouped by subject once.

    A group holds the objects of each predicate, made distinct as the union and sets of
    triples want it, and the solutions are its combinations. Subjects of more than HUB
    such triples (a lookup that reads subjects and predicates finds them, and at most one
    in HUB triples can be one) are matched pattern by pattern and joined instead.
    """
    held = quads.where(F.col("p.lex").isin(*{p for p, _ in cells}) & (F.col("p.kind") == terms.IRI))
    for name, place in {"s": s, "g": g}.items():
        if place is not None and (constant := _constant(place)) is not None:
            held = held.where(F.col(name) == constant)
    keys = ["s"] if g is None else ["g", "s"]
    if g is not None:
        held = held.where("g is not null")
    hubs = held.groupBy("s").count().where(F.col("count") > HUB).select("s")
    if hubs.isEmpty():
        return _gathered(held, s, cells, g, once, keys)
    ensure_checkpoints(quads)
    hubs = F.broadcast(hubs.checkpoint())
    apart = reduce(lambda a, b: a.join(b), [match(held.join(hubs, "s", "left_semi"), s, *cell, g=g, once=once) for cell in cells])
    return _gathered(held.join(hubs, "s", "left_anti"), s, cells, g, once, keys).union(apart)


def _gathered(held: DataFrame, s: Place, cells: tuple, g: Place | None, once: bool, keys: list[str]) -> Solutions:
    collect = F.collect_list if once else F.collect_set
    objects = []
    for k, (p, o) in enumerate(cells):
        fits = F.col("p.lex") == p
        if (constant := _constant(o)) is not None:
            fits = fits & (F.col("o") == constant)
        objects.append(collect(F.when(fits, F.col("o"))).alias(f"cell {k}"))
    rows = held.groupBy(*keys).agg(*objects).where(reduce(lambda a, b: a & b, [F.size(f"cell {k}") > 0 for k in range(len(cells))]))
    columns = {x[1:]: F.col(name) for name, x in (("s", s), ("g", g)) if isinstance(x, str) and x.startswith("?") and (name == "s" or g is not None)}
    if len(columns) < sum(isinstance(x, str) and x.startswith("?") for x in (s, g)):
        rows = rows.where(F.col("s") == F.col("g"))
    for k, (_, o) in enumerate(cells):
        rows = rows.withColumn(f"cell {k}", F.explode(f"cell {k}"))
        if _constant(o) is None:
            if o[1:] in columns:
                rows = rows.where(F.col(f"cell {k}") == columns[o[1:]])
            else:
                columns[o[1:]] = F.col(f"cell {k}")
    return Solutions(rows.select(*(c.alias(v) for v, c in columns.items())) if columns else rows.select(F.lit(True).alias("__found")))


def _variables(pattern: tuple) -> set[str]:
    return {x for x in pattern if isinstance(x, str) and x.startswith("?")}


def bgp(quads: DataFrame, *patterns: tuple, g: Place | None = None, once: bool = False) -> Solutions:
    """Join of patterns. Those of one subject with given predicates are a star; the ones with most constants come first, and each is connected to the ones before where possible."""
    stars: dict[str, list[tuple]] = {}
    parts: list[tuple[int, set[str], Callable[[], Solutions]]] = []
    for x in patterns:
        if isinstance(x[0], str) and isinstance(x[1], str) and not x[1].startswith("?"):
            stars.setdefault(x[0], []).append(x)
        else:
            parts.append((sum(_constant(place) is not None for place in x), _variables(x), lambda x=x: match(quads, *x, g=g, once=once)))
    for s, held in stars.items():
        given = sum(_constant(place) is not None for x in held for place in x)
        names = set().union(*map(_variables, held))
        if len(held) == 1:
            parts.append((given, names, lambda x=held[0]: match(quads, *x, g=g, once=once)))
        else:
            parts.append((given, names, lambda s=s, held=held: star(quads, s, *(x[1:] for x in held), g=g, once=once)))
    rest = sorted(parts, key=lambda x: -x[0])
    out, known = rest[0][2](), set(rest.pop(0)[1])
    while rest:
        at = next((k for k, x in enumerate(rest) if known & x[1]), 0)
        _, names, make = rest.pop(at)
        out, known = out.join(make()), known | names
    return out


def from_graphs(quads: DataFrame, default: list[str] = (), named: list[str] = ()) -> DataFrame:
    """FROM and FROM NAMED: default's graphs lose their name, named ones keep it, others go."""
    g = F.col("g.lex")
    return quads.where(g.isin(*default) if default else F.lit(False)).withColumn("g", F.lit(None).cast(terms.TERM)).union(quads.where(g.isin(*named) if named else F.lit(False)))


def construct(solutions: Solutions, *template: tuple) -> DataFrame:
    """Distinct s, p, o of the template. Rows with an unbound place, a literal subject or a predicate that is no IRI make no triple."""
    out = []
    for s, p, o in template:
        s, p, o = (solutions.df[x[1:]] if isinstance(x, str) and x.startswith("?") else _constant(x) for x in (s, p, o))
        triple = solutions.df.select(s.alias("s"), p.alias("p"), o.alias("o"))
        out.append(triple.where("s is not null and o is not null and s.kind <> 3 and p.kind = 2"))
    return reduce(lambda a, b: a.union(b), out).distinct()


def fresh_blank(row: Column, label: str) -> Column:
    """Blank node of a template: one for each solution and label."""
    return terms.blank(F.concat(F.lit("c"), F.sha1(F.concat_ws("\x1f", row.cast("string"), F.lit(label)))))


def construct_where(quads: DataFrame, *patterns: tuple) -> DataFrame:
    """The short form: the pattern is the template."""
    return construct(bgp(quads, *patterns), *patterns)


def describe(quads: DataFrame, described: DataFrame) -> DataFrame:
    """Distinct triples about the terms in described's column s, and about the blank nodes these lead to, round by round until none is new.

    Rounds after the first look among the triples about blank nodes only, which are
    made distinct and kept once; what is found is one checkpoint every few rounds.
    """
    ensure_checkpoints(quads)
    triples = quads.select("s", "p", "o")
    out = triples.join(described.select("s").distinct(), "s", "left_semi").distinct().checkpoint()
    frontier = out.where("o.kind = 1").select(F.col("o").alias("s")).distinct()
    if frontier.isEmpty():
        return out
    blanks, rounds = triples.where("s.kind = 1").distinct().checkpoint(), 0
    while not frontier.isEmpty():
        more = blanks.join(frontier, "s", "left_semi").join(out, ["s", "p", "o"], "left_anti").checkpoint()
        out, rounds = out.union(more), rounds + 1
        if rounds % MERGED == 0:
            out = out.checkpoint()
        frontier = more.where("o.kind = 1").select(F.col("o").alias("s")).distinct()
    return out


def subclass_pairs(quads: DataFrame) -> DataFrame:
    """(sub, sup) of every subclass triple between IRIs, repetitions kept."""
    return quads.where((F.col("p") == terms.iri(terms.SUBCLASS)) & (F.col("s.kind") == terms.IRI) & (F.col("o.kind") == terms.IRI)).select(F.col("s.lex").alias("sub"), F.col("o.lex").alias("sup"))
