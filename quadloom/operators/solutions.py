"""Solution sequences: DataFrames whose columns are variables and whose nulls are unbound.

The graph-pattern algebra of SPARQL 1.1 as methods. Catalyst plans everything; what
is decided here is which variables are always bound, because those become equi-join
keys, and where a null means "compatible with anything".

Where no shared variable is surely bound, solutions carry the mask of those that are.
A pair of masks has its own common variables, and rows are copied for the masks of the
other side, so that all pairs of masks are one equi-join in which each compatible pair
of rows meets once. Only masks without a common variable are a product, as they mean.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Solutions:
    """df: a column for each variable. maybe: the variables that can be unbound."""

    def __init__(self, df: DataFrame, maybe: frozenset[str] | set[str] = frozenset()):
        self.df, self.maybe = df, frozenset(maybe) & frozenset(df.columns)

    @property
    def variables(self) -> list[str]:
        return self.df.columns

    def __getitem__(self, variable: str) -> Column:
        return self.df[variable]

    # combining

    def _sides(self, other: Solutions) -> tuple[DataFrame, list[str], list[str], list[str]]:
        """The other side with its shared variables renamed; shared, surely bound shared, and other shared ones."""
        shared = [v for v in self.variables if v in other.variables]
        sure = [v for v in shared if v not in self.maybe and v not in other.maybe]
        return other.df.withColumnsRenamed({v: f"__{v}" for v in shared}), shared, sure, [v for v in shared if v not in sure]

    def _compatible(self, right: DataFrame, sure: list[str], unsure: list[str]) -> Column:
        parts = [self.df[v] == right[f"__{v}"] for v in sure]
        parts += [(self.df[v] == right[f"__{v}"]) | self.df[v].isNull() | right[f"__{v}"].isNull() for v in unsure]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def _merged(self, joined: DataFrame, right: DataFrame, shared: list[str], other: Solutions, optional: bool) -> Solutions:
        columns = [F.coalesce(self.df[v], right[f"__{v}"]).alias(v) if v in shared and v in self.maybe else self.df[v] for v in self.variables]
        more = [v for v in other.variables if v not in shared]
        maybe = {v for v in self.variables if v in self.maybe and (v not in shared or v in other.maybe or optional)}
        return Solutions(joined.select(*columns, *(right[v] for v in more)), maybe | {v for v in more if optional or v in other.maybe})

    def _masks(self, variables: list[str]) -> list[int]:
        """The masks that these variables can have: bit i is set if variable i is bound."""
        return [sum(bit << i for i, bit in enumerate(bits)) for bits in product(*((0, 1) if v in self.maybe else (1,) for v in variables))]

    def _by_mask(self, other: Solutions, keys: list[str], unsure: list[str]) -> DataFrame:
        """Pairs of rows that agree in at least one of the unsure variables, which both bind, and in none differ.

        keys: the columns of this side that are needed; the other side's shared variables
        are renamed. Names with a space are no variables.
        """

        def side(df: DataFrame, names: list[str], own: str, across: str, masks: list[int], tag: str) -> DataFrame:
            bits = [F.when(F.col(v).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(names)]
            df = df.select("*", reduce(lambda x, y: x.bitwiseOR(y), bits).alias(own), F.explode(F.array(*map(F.lit, masks))).alias(across))
            common = F.col(own).bitwiseAND(F.col(across))
            held = [F.when(common.bitwiseAND(F.lit(1 << i)) != 0, F.col(v)).alias(f"{tag} key {i}") for i, v in enumerate(names)]
            return df.where(common != 0).select("*", *held)

        right = other.df.withColumnsRenamed({v: f"__{v}" for v in other.variables if v in self.variables})
        left = side(self.df.select(*keys), unsure, "left mask", "left across", other._masks(unsure), "left")
        right = side(right, [f"__{v}" for v in unsure], "right mask", "right across", self._masks(unsure), "right")
        on = (F.col("left mask") == F.col("right across")) & (F.col("left across") == F.col("right mask"))
        for i in range(len(unsure)):
            on = on & F.col(f"left key {i}").eqNullSafe(F.col(f"right key {i}"))
        return left.join(right, on)

    def _same(self, found: DataFrame, keys: list[str], how: str) -> DataFrame:
        """This side's rows that are (left_semi) or are not (left_anti) in found, or all with what found says of them (left); nulls are equal here."""
        told = found.withColumnsRenamed({k: f"told {i}" for i, k in enumerate(keys)})
        on = reduce(lambda x, y: x & y, [self.df[k].eqNullSafe(told[f"told {i}"]) for i, k in enumerate(keys)])
        joined = self.df.join(told, on, how)
        return joined.drop(*(f"told {i}" for i in range(len(keys)))) if how == "left" else joined

    def join(self, other: Solutions) -> Solutions:
        """Compatible pairs."""
        right, shared, sure, unsure = self._sides(other)
        if not shared:
            return self.product(other)
        if sure or not unsure:
            return self._merged(self.df.join(right, self._compatible(right, sure, unsure)), right, shared, other, False)
        return self._pairs(other, unsure)

    def _pairs(self, other: Solutions, unsure: list[str]) -> Solutions:
        """Compatible pairs where no shared variable is surely bound: those that share a bound one by key, the others as products."""
        joined = self._by_mask(other, self.variables, unsure)
        more = [v for v in other.variables if v not in unsure]
        both = [F.coalesce(F.col(v), F.col(f"__{v}")).alias(v) if v in unsure else F.col(v) for v in self.variables]
        out = Solutions(joined.select(*both, *more), self.maybe | other.maybe)
        bound = lambda one, mask, names: reduce(lambda x, y: x & y, [one.df[v].isNotNull() if mask >> i & 1 else one.df[v].isNull() for i, v in enumerate(names)])
        for mask in self._masks(unsure):
            names = [v for i, v in enumerate(unsure) if mask >> i & 1]
            if any(v not in other.maybe for v in names):
                continue  # the other side always binds one of them
            left = Solutions(self.df.where(bound(self, mask, unsure)).drop(*(v for v in unsure if v not in names)), self.maybe)
            none = reduce(lambda x, y: x & y, [other.df[v].isNull() for v in names], F.lit(True))
            out = out.union(left.product(Solutions(other.df.where(none).drop(*names), other.maybe)))
        return Solutions(out.df, {v for v in out.variables if v in out.maybe and not (v in unsure and (v not in self.maybe or v not in other.maybe))})

    def count_pairs(self, other: Solutions, keys: list[str], variable: str) -> Solutions:
        """Number of compatible pairs for each group of keys: join, then group with a count, without making the pairs.

        Each side is counted by its shared variables and keys first, and the counts of what
        is compatible are multiplied, so that work grows with the sides and not with the pairs.
        """

        def counted(x: Solutions, across: Solutions, name: str) -> Solutions:
            held = [v for v in x.variables if v in across.variables or v in keys]
            return Solutions(x.df.groupBy(*held).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 0), x.maybe)

        met = counted(self, other, "left count").join(counted(other, self, "right count"))
        return met.group(keys, **{variable: F.coalesce(F.sum(F.col("left count") * F.col("right count")), F.lit(0))})

    def product(self, other: Solutions) -> Solutions:
        """All pairs, which is what patterns without a shared variable mean. Spark broadcasts a side that it knows to be small."""
        return Solutions(self.df.join(other.df, F.lit(True)), self.maybe | other.maybe)

    def optional(self, other: Solutions, condition: Column | None = None) -> Solutions:
        """Left join; condition belongs to the optional part and sees both sides."""
        right, shared, sure, unsure = self._sides(other)
        if unsure and not sure:
            if condition is not None:
                return self._optional_if(other, unsure, condition)
            return self._pairs(other, unsure).union(Solutions(self._same(self._meeting(other, unsure), shared, "left_anti"), self.maybe))
        on = self._compatible(right, sure, unsure)
        joined = self.df.join(right, on if condition is None else on & F.coalesce(condition, F.lit(False)), "left")
        return self._merged(joined, right, shared, other, True)

    def _optional_if(self, other: Solutions, unsure: list[str], condition: Column) -> Solutions:
        """Left join without a surely bound variable, under a condition: the pairs that satisfy it, and the rows that are in none of them."""
        own = {v: f"__own_{v}" for v in self.variables}
        kept = Solutions(self.df.select("*", *(F.col(v).alias(n) for v, n in own.items())), self.maybe | {own[v] for v in self.maybe})
        met = kept._pairs(other, unsure).filter(F.coalesce(condition, F.lit(False)))
        rows = met.df.select(*(F.col(n).alias(v) for v, n in own.items())).distinct()
        alone = Solutions(self._same(rows, self.variables, "left_anti"), self.maybe)
        return Solutions(met.df.drop(*own.values()), met.maybe).union(alone)

    def _meeting(self, other: Solutions, unsure: list[str], disjoint: bool = True) -> DataFrame:
        """Distinct values of the unsure variables here that are compatible with some of other's. Without disjoint they must share a bound one."""
        mine, its = (Solutions(x.df.select(*unsure).distinct(), x.maybe) for x in (self, other))
        found = mine._by_mask(its, unsure, unsure).select(*unsure)
        if disjoint:  # values that bind none of what some row of other binds
            present = its.df.select(*(F.col(v).isNotNull().alias(f"__{v}") for v in unsure)).distinct()  # a row for each mask
            apart = reduce(lambda x, y: x & y, [~(F.col(v).isNotNull() & F.col(f"__{v}")) for v in unsure])
            found = found.union(mine.df.join(F.broadcast(present), apart).select(*unsure))
        return found.distinct()

    def minus(self, other: Solutions) -> Solutions:
        """Without the solutions that are compatible with one of other and share a bound variable with it."""
        right, shared, sure, unsure = self._sides(other)
        if not shared:
            return self
        if not sure:
            return Solutions(self._same(self._meeting(other, unsure, disjoint=False), unsure, "left_anti"), self.maybe)
        return Solutions(self.df.join(right, self._compatible(right, sure, unsure), "left_anti"), self.maybe)

    def exists(self, other: Solutions, condition: Column | None = None, negated: bool = False) -> Solutions:
        """Solutions that have (or have not) a compatible one in other."""
        right, _, sure, unsure = self._sides(other)
        how = "left_anti" if negated else "left_semi"
        if unsure and not sure:
            keys = unsure if condition is None else self.variables
            found = self._meeting(other, unsure) if condition is None else self._answered(other, condition)
            return Solutions(self._same(found, keys, how), self.maybe)
        on = self._compatible(right, sure, unsure)
        return Solutions(self.df.join(right, on if condition is None else on & F.coalesce(condition, F.lit(False)), how), self.maybe)

    def not_exists(self, other: Solutions, condition: Column | None = None) -> Solutions:
        return self.exists(other, condition, negated=True)

    def _answered(self, other: Solutions, condition: Column) -> DataFrame:
        """Distinct solutions here that have a compatible one in other under the condition, which sees both sides."""
        own = {v: f"__own_{v}" for v in self.variables}
        kept = Solutions(self.df.distinct().select("*", *(F.col(v).alias(n) for v, n in own.items())), self.maybe | {own[v] for v in self.maybe})
        met = kept.join(other).filter(F.coalesce(condition, F.lit(False)))
        return met.df.select(*(F.col(n).alias(v) for v, n in own.items())).distinct()

    def mark(self, variable: str, other: Solutions, condition: Column | None = None) -> Solutions:
        """Every solution with a boolean variable: whether it has a compatible one in other. EXISTS inside an expression.

        The flag is a left join with the distinct values of the shared variables that are met, so it can stand
        under || and !, and repeats no solution.
        """
        if variable in self.variables:
            raise ValueError(f"{variable} is bound already")
        _, shared, _, unsure = self._sides(other)
        if condition is not None:
            keys, found = self.variables, self._answered(other, condition)
        elif not shared:
            some = other.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(variable))
            return Solutions(self.df.join(F.broadcast(some), F.lit(True)), self.maybe)
        elif not unsure:
            keys, found = shared, other.df.select(*shared).distinct()
        else:
            keys = shared
            mine, its = (Solutions(x.df.select(*shared).distinct(), x.maybe) for x in (self, other))
            found = mine.exists(its).df
        marked = self._same(found.withColumn(variable, F.lit(True)), keys, "left")
        return Solutions(marked.withColumn(variable, F.coalesce(F.col(variable), F.lit(False))), self.maybe)

    def union(self, other: Solutions) -> Solutions:
        """Both with their repetitions; variables of one side are unbound in the other's solutions."""
        only = set(self.variables) ^ set(other.variables)
        return Solutions(self.df.unionByName(other.df, allowMissingColumns=True), self.maybe | other.maybe | only)

    # one side

    def filter(self, condition: Column) -> Solutions:
        """Solutions for which condition is true; an error (null) drops one."""
        return Solutions(self.df.where(condition), self.maybe)

    def bind(self, variable: str, value: Column) -> Solutions:
        if variable in self.variables:
            raise ValueError(f"{variable} is bound already")
        return Solutions(self.df.withColumn(variable, value), self.maybe | {variable})

    def values(self, variables: list[str], rows: list[tuple]) -> Solutions:
        """Join with inline data, None being UNDEF; rows have the variables' own types here."""
        types = dict(zip(self.df.columns, [f.dataType for f in self.df.schema.fields], strict=True))
        data = self.df.sparkSession.createDataFrame(rows, ", ".join(f"`{v}` {types[v].simpleString()}" for v in variables))
        undefined = {v for k, v in enumerate(variables) if any(r[k] is None for r in rows)}
        return self.join(Solutions(F.broadcast(data), undefined))

    def project(self, *variables: str) -> Solutions:
        return Solutions(self.df.select(*variables), self.maybe)

    def distinct(self) -> Solutions:
        return Solutions(self.df.distinct(), self.maybe)

    def reduced(self) -> Solutions:
        """Repetitions may stay; none is removed."""
        return self

    def order(self, *keys: Column) -> Solutions:
        return Solutions(self.df.orderBy(*keys), self.maybe)

    def slice(self, limit: int | None = None, offset: int = 0) -> Solutions:
        df = self.df.offset(offset) if offset else self.df
        return Solutions(df if limit is None else df.limit(limit), self.maybe)

    def group(self, keys: list[str], **aggregates: Column) -> Solutions:
        """Aggregates for each group; without keys, one row even of nothing."""
        columns = [a.alias(n) for n, a in aggregates.items()]
        df = self.df.groupBy(*keys).agg(*columns) if keys else self.df.agg(*columns)
        return Solutions(df, (self.maybe & set(keys)) | set(aggregates))

    # query forms

    def ask(self) -> DataFrame:
        """One row: whether there is a solution. Reads no further than the first one."""
        return self.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
