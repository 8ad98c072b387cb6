"""The same column expressions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.sniff import sniff
from quadloom.sources import rdf_text


def sniffed(stream: DataFrame, content: str = "content") -> DataFrame:
    """A media type for each arriving row; stateless."""
    return stream.withColumn("media_type", sniff(F.col(content).cast("binary")))


def triples(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Distinct quads of arriving N-Triples or N-Quads lines (column value); a repetition within `late` is dropped, and state older than that goes."""
    parsed = rdf_text.lines(stream.select("value"), strict=False)
    if not stream.isStreaming:
        return parsed.distinct()
    quads = rdf_text.lines(stream.select(time, "value"), strict=False, keep=(time,))
    return quads.withWatermark(time, late).dropDuplicatesWithinWatermark(["g", "s", "p", "o"]).select("g", "s", "p", "o")
