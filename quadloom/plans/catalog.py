"""What there is to call, as a DataFrame and as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms
from quadloom.plans import convert
from quadloom.plans.dataset import NS

#: urn, title, arguments, output, media types read and written.
ENDPOINTS = [
    ("urn:query:select", "Solutions of a graph pattern", ["graphs", "as"], "application/sparql-results+json", [], []),
    ("urn:query:ask", "Whether a pattern has a solution", ["graphs", "as"], "application/sparql-results+json", [], []),
    ("urn:query:construct", "Triples of a template", ["graphs", "as"], "text/turtle", [], []),
    ("urn:query:describe", "Triples about terms", ["graphs", "as"], "text/turtle", [], []),
    ("urn:graph:convert", "Graph in another syntax", ["content", "as"], "text/turtle", convert.READS, convert.WRITES),
    ("urn:sniff", "Content-type sniff", ["content"], "text/plain", [], []),
    ("urn:convert:auto", "Conversion by sniffed type", ["content", "as"], None, [], []),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENDPOINTS, "urn string, title string, args array<string>, output string, `from` array<string>, `to` array<string>")


def triples(entries: DataFrame) -> DataFrame:
    """Catalog rows as triples: endpoints, of which those with conversions are converters too."""
    named = lambda n: terms.iri(NS + n)
    base = [(terms.iri(terms.TYPE), F.array(named("Endpoint"))), (named("id"), F.array(terms.literal(F.col("urn"))))]
    kind = F.when(F.size("from") > 0, F.array(named("Converter"))).otherwise(F.array().cast(f"array<{terms.TERM.simpleString()}>"))
    some = [(terms.iri(terms.TYPE), kind), *((named(n), F.transform(F.col(c), lambda x: terms.literal(x))) for n, c in (("convertsFrom", "from"), ("convertsTo", "to")))]

    def paired(p, values):
        return F.transform(values, lambda o: F.struct(p.alias("p"), o.alias("o")))

    pairs = F.concat(*(paired(p, values) for p, values in base + some))
    return entries.select(terms.iri(F.col("urn")).alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o")
