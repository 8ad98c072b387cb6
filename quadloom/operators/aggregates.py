"""SPARQL's aggregates. A null in a group is an error, which makes sums and averages unbound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import terms


def count(value: Column | None = None, distinct: bool = False) -> Column:
    """Bound values, or solutions."""
    if value is None:
        return F.count(F.lit(1))
    return F.count_distinct(value) if distinct else F.count(value)


def count_distinct_solutions(*variables: Column) -> Column:
    """COUNT(DISTINCT *): the struct keeps solutions with unbound variables."""
    return F.count_distinct(F.struct(*variables))


def _guarded(value: Column, result: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), result)


def total(value: Column, distinct: bool = False) -> Column:
    """0 for an empty group."""
    return _guarded(value, F.coalesce(F.sum_distinct(value) if distinct else F.sum(value), F.lit(0)))


def average(value: Column, distinct: bool = False) -> Column:
    """0 for an empty group."""
    return _guarded(value, F.coalesce(F.sum_distinct(value) / F.count_distinct(value) if distinct else F.avg(value), F.lit(0)))


def least(value: Column) -> Column:
    """Smallest value of a native column."""
    return _guarded(value, F.min(value))


def greatest(value: Column) -> Column:
    return _guarded(value, F.max(value))


def least_term(term: Column) -> Column:
    """Smallest term in the order of ORDER BY."""
    return _guarded(term, F.min(F.struct(terms.sort_key(term), term.alias("term"))).term)


def greatest_term(term: Column) -> Column:
    return _guarded(term, F.max(F.struct(terms.sort_key(term), term.alias("term"))).term)


def sample(value: Column) -> Column:
    """Any value; the smallest, so that results repeat."""
    return F.min(value)


def group_concat(text: Column, separator: str = " ", distinct: bool = False) -> Column:
    """Texts in ascending order; empty for an empty group."""
    held = F.array_sort(F.collect_set(text) if distinct else F.collect_list(text))
    return _guarded(text, F.array_join(held, separator))
