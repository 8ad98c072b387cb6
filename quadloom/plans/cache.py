"""Results kept by what they were made from: files, plans, and other results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, folder: str) -> str:
    """What a folder's files are like: one listing by Spark, of which a count, the bytes and a hash of names, lengths and times of change come back."""
    files = spark.read.format("binaryFile").load(folder)
    return str(tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()))


def fingerprint(sources: list[DataFrame]) -> str:
    """Hash of the folders that the sources' files lie in, and of their plans."""
    parts, folders = [], {}
    for df in sources:
        for folder in sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()}):
            if folder not in folders:
                folders[folder] = listed(df.sparkSession, folder)
            parts.append(f"{folder} {folders[folder]}")
        parts.append(str(df.semanticHash()))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


@dataclass
class Result:
    """A kept result: what it follows, how it is made, and the fingerprint and data of the last time."""

    sources: list[DataFrame]
    after: list[Result]
    make: Callable[..., DataFrame]
    stamp: str = ""
    df: DataFrame | None = None


class Cache:
    """A result is computed again only when a source of it has changed, or of a result that it follows.

    Results form a graph. Its fingerprints are stored: one is made of a result's own
    sources and of the fingerprints of what it follows, so a change in one file drops
    exactly what was made from it, at any distance.
    """

    def __init__(self) -> None:
        self.held: dict[tuple, Result] = {}

    def get(self, operation: str, arguments: tuple, sources: list[DataFrame], make: Callable[..., DataFrame], after: list[tuple] | None = None) -> DataFrame:
        """The result of make, which gets the results (operation, arguments) that it comes after."""
        follows = [self.held[key] for key in after or []]
        key = (operation, arguments)
        old = self.held.get(key)
        self.held[key] = Result(sources, follows, make, old.stamp if old else "", old.df if old else None)
        if old is not None:  # those that follow the result by its name follow the new one
            for other in self.held.values():
                other.after = [self.held[key] if x is old else x for x in other.after]
        self._refresh(self.held[key], set())
        return self.held[key].df

    def _refresh(self, result: Result, above: set[int]) -> str:
        if id(result) in above:
            raise ValueError("a result that follows itself")
        stamps = [self._refresh(x, above | {id(result)}) for x in result.after]
        now = hashlib.sha256("\n".join([fingerprint(result.sources), *stamps]).encode()).hexdigest()
        if now != result.stamp:
            if result.df is not None:
                result.df.unpersist()
            # a plan of its own, since Spark would take a kept source for the source itself, which then has no files
            result.df, result.stamp = result.make(*(x.df for x in result.after)).where(F.lit(True)).persist(), now
        return now

    def stale(self) -> list[tuple]:
        """Keys of the results that a change has reached; nothing is made."""
        found: dict[int, str] = {}

        def stamp(result: Result) -> str:
            if id(result) not in found:
                found[id(result)] = hashlib.sha256("\n".join([fingerprint(result.sources), *map(stamp, result.after)]).encode()).hexdigest()
            return found[id(result)]

        return [key for key, result in self.held.items() if stamp(result) != result.stamp]

