"""Property paths over edge tables.

An edge table is a DataFrame with columns s and o of any one type: terms, or a
mapped table's native keys. Sequences and alternatives keep repetitions; the
closures are sets, as SPARQL has them.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms


#: Rounds after which what they found is merged into one checkpoint.
MERGED = 16
#: Rounds of a closure of all pairs after which it is made from strongly connected components instead.
DEEP = 16


def link(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.where(F.col("p") == terms.iri(predicate)).select("s", "o").distinct()


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), F.col("s").alias("o"))


def sequence(*steps: DataFrame) -> DataFrame:
    out = steps[0]
    for step in steps[1:]:
        out = out.withColumnRenamed("o", "__m").join(step.select(F.col("s").alias("__m"), "o"), "__m").select("s", "o")
    return out


def alternative(*paths: DataFrame) -> DataFrame:
    out = paths[0]
    for path in paths[1:]:
        out = out.union(path)
    return out


def negated(quads: DataFrame, forward: list[str] = (), backward: list[str] = ()) -> DataFrame:
    """Edges of any predicate but forward's; with backward, also reversed edges of any but those."""
    out = quads.where(~F.col("p.lex").isin(*forward)).select("s", "o").distinct() if forward or not backward else None
    if backward:
        turned = inverse(quads.where(~F.col("p.lex").isin(*backward)).select("s", "o").distinct())
        out = turned if out is None else out.union(turned)
    return out


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("s").union(edges.select("o")).distinct()


def zero_or_one(edges: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """every: the nodes (column s) that reach themselves; the edges' own if not given."""
    own = nodes(edges) if every is None else every
    return edges.union(own.select("s", F.col("s").alias("o"))).distinct()


def one_or_more(edges: DataFrame, start: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """Pairs that a path of one edge or more connects, from start's nodes (column s) to end's (column o), where they are given.

    Of all pairs: semi-naive rounds. Only pairs found in the last round grow, those known before
    go, and each round is cut off by a checkpoint. Cycles end because pairs are a set. What is
    not at its end after DEEP rounds is deep, and made anew by _condensed.
    With one end given only what it reaches is looked at; see _reached. Edges with a null end are none.
    """
    ensure_checkpoints(edges)
    edges = edges.where("s IS NOT NULL AND o IS NOT NULL")
    if start is not None:
        found = _reached(edges, start)
        return found if end is None else found.join(end.select("o").distinct(), "o", "left_semi").select("s", "o")
    if end is not None:
        return inverse(_reached(inverse(edges), end.select(F.col("o").alias("s"))))
    edges = edges.distinct().checkpoint()
    new = found = edges
    for _ in range(DEEP):
        new = _then(new, edges).distinct().join(found, ["s", "o"], "left_anti").checkpoint()
        if new.isEmpty():
            return found
        found = found.union(new)  # each round is cut off already
    return _condensed(edges)


def _then(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    return pairs.join(steps.select(F.col("s").alias("__m"), F.col("o").alias("__n")), F.col("o") == F.col("__m")).select("s", F.col("__n").alias("o"))


def _doubled(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the steps of 1, 2, 4, ... edges along nodes with one edge out, and the edges of the other nodes."""
    out = edges.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.first("o").alias("o"))
    single = out.where("n = 1").select("s", "o").checkpoint()
    many = edges.join(out.where("n > 1").select("s"), "s", "left_semi").checkpoint()
    tables, left = [single], single.count()
    while left > 1 and not tables[-1].isEmpty():
        tables.append(_then(tables[-1], tables[-1]).checkpoint())
        left //= 2
    return tables, many


def _reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Pairs (s, o) of start's nodes and what they reach.

    Nodes with one edge out make chains, and cycles, that need no search: tables of
    their steps of 1, 2, 4, ... edges are made once, and a round runs along all chains
    from where it stands by these, doubling what it has covered with each table. Rounds
    are therefore as many as the edges of nodes with several that a path takes, and a
    chain or cycle of n nodes takes log n tables instead of n rounds.
    """
    edges = edges.distinct().checkpoint()
    tables, many = _doubled(edges)
    new = _then(start.select("s", F.col("s").alias("o")).distinct(), edges).distinct().checkpoint()
    found = None
    while not new.isEmpty():
        for k, table in enumerate(tables):
            new = new.union(_then(new, table)).distinct()
            if k % 2 or k == len(tables) - 1:
                new = new.checkpoint()
        if found is not None:
            new = new.join(found, ["s", "o"], "left_anti").checkpoint()
        found = new if found is None else found.union(new).checkpoint()
        new = _then(new, many).distinct().join(found, ["s", "o"], "left_anti").checkpoint()
    return edges.limit(0).select("s", "o") if found is None else found


def _shortcuts(edges: DataFrame) -> DataFrame:
    """Edges, and the steps of 2, 4, 8, ... edges along chains: a chain of n nodes takes log n rounds by them."""
    tables, many = _doubled(edges)
    # distinct, since a checkpoint keeps constraints on columns that it has not, which a bare union trips over
    return reduce(DataFrame.union, (table.distinct() for table in tables), many.distinct()).checkpoint()


def _within(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Edges whose ends are both in part (columns s, c), with the same c."""
    other = part.select(F.col("s").alias("o"), F.col("c").alias("__d"))
    return edges.join(part.select("s", "c"), "s").join(other, "o").where(F.col("c") == F.col("__d")).select("s", "o")


def _dead_ends(edges: DataFrame) -> DataFrame:
    """Nodes (column s) from which single edges lead to a node with none; no cycle holds them."""
    tables, _ = _doubled(edges)
    dead = edges.select(F.col("o").alias("s")).distinct().join(edges.select("s").distinct(), "s", "left_anti")
    for k, table in enumerate(tables):
        dead = dead.union(table.join(dead.select(F.col("s").alias("o")), "o", "left_semi").select("s")).distinct()
        if k % 2 or k == len(tables) - 1:
            dead = dead.checkpoint()
    return dead


def _spread(edges: DataFrame, known: DataFrame) -> DataFrame:
    """known (a row for each node s, with c or null), and each node with the greatest c of those that reach it.

    Only what changed goes on, by one join a round.
    """
    steps = _shortcuts(edges)
    fresh = known.where("c IS NOT NULL").checkpoint()
    while not fresh.isEmpty():
        came = fresh.join(steps, "s").groupBy(F.col("o").alias("s")).agg(F.max("c").alias("__c"))
        more = F.col("__c").isNotNull() & (F.col("c").isNull() | (F.col("__c") > F.col("c")))
        grown = known.join(came, "s", "left").select("s", F.when(more, F.col("__c")).otherwise(F.col("c")).alias("c"), more.alias("__more")).checkpoint()
        known, fresh = grown.select("s", "c"), grown.where("__more").select("s", "c")
    return known


def components(edges: DataFrame) -> DataFrame:
    """(s, c): each node's strongly connected component, named by one of its nodes.

    In each turn a node takes the colour of the last node, in a random order, that reaches
    it. A component never has two colours; the one of the node that gave a colour is what
    reaches that node inside it, and goes on as done. Then only edges inside a colour are left, so all
    colours are worked on at once and their number of nodes falls as in a sort by random pivots.
    Nodes that single edges join to a dead end, in either direction, are done before.
    """
    ensure_checkpoints(edges)
    edges = edges.where("s IS NOT NULL AND o IS NOT NULL")
    every = nodes(edges).checkpoint()
    left = edges.where(F.col("s") != F.col("o")).distinct().checkpoint()
    done, turn = every.limit(0).select("s", F.col("s").alias("c")), 0
    while not left.isEmpty():
        for turned in (False, True):
            dead = _dead_ends(inverse(left) if turned else left)
            left = left.join(dead, "s", "left_anti").join(dead.select(F.col("s").alias("o")), "o", "left_anti").select("s", "o").checkpoint()
        if left.isEmpty():
            break
        rank = F.struct(F.xxhash64("s", F.lit(turn)).alias("h"), F.col("s").alias("node"))
        colour = _spread(left, nodes(left).select("s", rank.alias("c")).checkpoint()).select("s", F.col("c.node").alias("c")).checkpoint()
        inner = _within(left, colour).checkpoint()
        root = colour.select("s", F.when(F.col("s") == F.col("c"), F.col("c")).alias("c")).checkpoint()
        found = _spread(inverse(inner), root).where("c IS NOT NULL").checkpoint()
        left = inner.join(found, "s", "left_anti").join(found.select(F.col("s").alias("o")), "o", "left_anti").select("s", "o").checkpoint()
        done, turn = done.union(found).checkpoint(), turn + 1
    alone = every.join(done.select("s"), "s", "left_anti")
    return done.union(alone.select("s", F.col("s").alias("c"))).checkpoint()


def _condensed(edges: DataFrame) -> DataFrame:
    """All pairs by the closure of the components' graph, which has no cycles; members come in last.

    Pairs inside a component, and between two, are thereby written once and never compared.
    """
    of = components(edges)
    to = of.select(F.col("s").alias("o"), F.col("c").alias("__d"))
    links = edges.join(of, "s").join(to, "o").select(F.col("c").alias("s"), F.col("__d").alias("o")).distinct().checkpoint()
    between = links.where(F.col("s") != F.col("o"))
    steps, found, new, rounds = _shortcuts(between), links, between, 0
    while not new.isEmpty():
        new = _then(new, steps).distinct().join(found, ["s", "o"], "left_anti").checkpoint()
        found, rounds = found.union(new), rounds + 1
        if rounds % MERGED == 0:
            found = found.checkpoint()
    first = of.select(F.col("s").alias("__s"), F.col("c").alias("s"))
    last = of.select(F.col("s").alias("__o"), F.col("c").alias("o"))
    return found.join(first, "s").join(last, "o").select(F.col("__s").alias("s"), F.col("__o").alias("o"))


def zero_or_more(edges: DataFrame, start: DataFrame | None = None, every: DataFrame | None = None, end: DataFrame | None = None) -> DataFrame:
    """As one_or_more, and every node with itself: start's or end's where given, else those of every, or the edges' own."""
    if start is not None and end is not None:
        own = start.select("s").distinct().join(end.select(F.col("o").alias("s")).distinct(), "s", "left_semi")
    elif end is not None:
        own = end.select(F.col("o").alias("s"))
    else:
        own = start if start is not None else nodes(edges) if every is None else every
    return one_or_more(edges, start, end).union(own.select("s", F.col("s").alias("o"))).distinct()


def ensure_checkpoints(df: DataFrame) -> None:
    """Uses the session's checkpoint folder. Where none is set, one of our own in local mode, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
