"""Instances by class without a closure join: a hierarchy's classes numbered so that what lies below one is a few ranges.

A spanning tree gives each class a number and the range of its subtree's numbers; what
other parents add is more ranges, merged where they touch. Whether an instance belongs to a class is then a
test of its own class's number against the ranges. Classes that are subclasses of each other share a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subclass pairs up to which a hierarchy is numbered on the driver; a larger one is paths.zero_or_more's.
MOST = 1 << 21

LABELS = "cls string, number int, cover array<struct<low: int, high: int>>"


def components(below: dict[str, list[str]]) -> list[list[str]]:
    """Classes that are below each other, together; each component after all that are below it."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    out, held, inside = [], [], set()
    for root in below:
        if root in number:
            continue
        walk = [(root, iter(below[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        inside.add(root)
        while walk:
            at, rest = walk[-1]
            step = next((x for x in rest if x not in number or x in inside), None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == number[at]:
                    group = []
                    while not group or group[-1] != at:
                        group.append(held.pop())
                        inside.discard(group[-1])
                    out.append(group)
            elif step in number:
                low[at] = min(low[at], number[step])
            else:
                number[step] = low[step] = len(number)
                held.append(step)
                inside.add(step)
                walk.append((step, iter(below[step])))
    return out


def numbered(pairs: list[tuple[str, str]]) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(class, number, ranges of the numbers below it, its own included) of subclass pairs (sub, sup)."""
    below: dict[str, list[str]] = {}
    for sub, sup in pairs:
        below.setdefault(sup, []).append(sub)
        below.setdefault(sub, [])
    groups = components(below)
    of = {c: k for k, group in enumerate(groups) for c in group}
    inner = [sorted({of[x] for c in group for x in below[c]} - {k}) for k, group in enumerate(groups)]
    tree: dict[int, list[int]] = {}
    has_parent = set()
    for k in range(len(groups) - 1, -1, -1):  # parents come after what is below them
        for child in inner[k]:
            if child not in has_parent:
                has_parent.add(child)
                tree.setdefault(k, []).append(child)
    number, last, count = {}, {}, 0
    for root in (k for k in range(len(groups)) if k not in has_parent):
        walk = [(root, False)]
        while walk:
            at, done = walk.pop()
            if done:
                last[at] = count - 1
                continue
            number[at], count = count, count + 1
            walk.append((at, True))
            walk += [(child, False) for child in tree.get(at, [])]
    cover: list[list[tuple[int, int]]] = []
    for k in range(len(groups)):
        merged: list[tuple[int, int]] = []
        for low, high in sorted([(number[k], last[k]), *(r for child in inner[k] for r in cover[child])]):
            if merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        cover.append(merged)
    return [(c, number[k], cover[k]) for k, group in enumerate(groups) for c in group]


def labels(pairs: DataFrame) -> DataFrame:
    """cls, number and cover of every class in subclass pairs (columns sub, sup)."""
    rows = pairs.where("sub IS NOT NULL AND sup IS NOT NULL").select("sub", "sup").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} subclass pairs; use paths.zero_or_more")
    return pairs.sparkSession.createDataFrame(numbered([(r.sub, r.sup) for r in rows]), LABELS)


def instances(types: DataFrame, known: DataFrame, above: list[str]) -> DataFrame:
    """(s, o): what is an instance (types: s, o) of each class of above, by any number of subclass steps; a row for each statement of a type.

    known: labels(). Types that are in no subclass pair are instances of themselves alone.
    """
    asked = types.sparkSession.createDataFrame([(c,) for c in above], "cls string")
    ranges = asked.join(known, "cls").select(F.col("cls").alias("asked"), F.explode("cover").alias("range")).select("asked", "range.low", "range.high")
    named = types.join(F.broadcast(known.select(F.col("cls").alias("o"), "number")), "o", "left")
    found = named.join(F.broadcast(ranges), F.col("number").between(F.col("low"), F.col("high"))).select("s", F.col("asked").alias("o"))
    return found.unionByName(named.where(F.col("number").isNull() & F.col("o").isin(above)).select("s", "o"))
