"""From raw documents to packed training sequences.

Quality classifier, quality rules, near-duplicate removal, packing. Each stage works
on all that its predecessor kept; run writes each stage's result as Parquet into the
shared folder and reads it back for the next one.

Null and empty texts are rejected by the first stage if their score is below its cutoff, and else by the
second, whose base rule asks for 20 words; near-duplicate removal alone would keep one of them. Rows
that repeat an id are judged by their own texts; of rows that repeat both id and text one stays, and
of a group of near duplicates the one with the smallest id, null ids being last. Packing takes every
row that is left, repeated ids too. Columns of the table keep their names and values, whatever
these are. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import packing, quality_classifier, quality_rules, simhash
from quadloom.llm._shared import work_dir
from quadloom.llm.queries import vocabulary


#: Bits between the fingerprints of most texts that are similar enough; shared rare shingles find the others.
RADIUS = 12


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, accepts."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules accept."""
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of similarity 0.8 or more."""
    return simhash.keep_one(docs, radius=RADIUS, least=0.8, rest=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", weigh), ("simhash_dedup", deduplicate), ("packing", pack)]

#: No stage of fitted scores, hashes or packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
