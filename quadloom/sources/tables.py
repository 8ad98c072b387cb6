"""Tables as graphs: the relational mapping, read without making triples where it can be.

A row is a subject: <base/table/key>, or a blank node if the table has no key. A
column is a predicate <base/table#column>; a foreign key has an IRI-valued predicate
<base/table#ref-column> besides; every row has a type triple.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions import terms
from quadloom.operators.solutions import Solutions

BASE = "http://data.example/"
#: Keys and foreign keys of the known tables; lineitem has no key.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": [], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}
REFS = {
    "nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
}


class Table(NamedTuple):
    """One named graph: <base/name>."""

    name: str
    df: DataFrame
    keys: list[str]
    refs: dict[str, str]

    @property
    def graph(self) -> str:
        return BASE + self.name

    def predicate(self, column: str, ref: bool = False) -> str:
        return f"{BASE}{self.name}#{'ref-' if ref else ''}{column}"

    def subject(self) -> Column:
        """IRI of the row from its key; without one a blank node by the row's file and place in it, the same in every scan."""
        if not self.keys:
            return terms.blank(F.concat_ws("-", F.lit(self.name), F.substring(F.md5(F.col("_metadata.file_path")), 1, 16), F.col("_metadata.row_index").cast("string")))
        return terms.iri(F.concat(F.lit(f"{self.graph}/"), F.concat_ws("/", *(F.col(k).cast("string") for k in self.keys))))

    def star(self, **variables: str) -> Solutions:
        """Patterns that share the subject, as one scan: variable=column, in native types.

        The subject itself is its key column; a foreign key joins to it by value, and
        Parquet reads the named columns only. Cells that can be null are not matched:
        a null makes no triple.
        """
        df = self.df.select(*(F.col(c).alias(v) for v, c in variables.items()))
        return Solutions(df.dropna(subset=[v for v, c in variables.items() if self.df.schema[c].nullable]))

    def quads(self) -> DataFrame:
        """Every triple of the table, in one scan; arrays have no counterpart and are left out."""
        cells = [(terms.iri(terms.TYPE), terms.iri(self.graph))]
        for f in self.df.schema.fields:
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                cells.append((terms.iri(self.predicate(f.name)), terms.of_native(F.col(f.name), f.dataType)))
        for column, target in self.refs.items():
            made = terms.iri(F.concat(F.lit(f"{BASE}{target}/"), F.col(column).cast("string")))
            cells.append((terms.iri(self.predicate(column, ref=True)), made))
        rows = self.df.withColumn("__s", self.subject())
        each = rows.select("__s", F.explode(F.array(*(F.struct(p.alias("p"), o.alias("o")) for p, o in cells))).alias("c"))
        return each.select(terms.iri(self.graph).alias("g"), F.col("__s").alias("s"), F.col("c.p").alias("p"), F.col("c.o").alias("o")).where("o is not null")


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS.get(name, []), REFS.get(name, {}))
