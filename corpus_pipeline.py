"""The corpus pipeline: toxic texts go, one of each near-duplicate group stays, leaks go, sources are mixed, and shards are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proselake.llm._common import cut
from proselake.llm.decontamination import without_items
from proselake.llm.mixing import mixed
from proselake.llm.ngram_join import one_of_each
from proselake.llm.sharding import shard_documents
from proselake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5.

    Labels are learned from ``labels`` rows that are not held out; without both kinds of them all score 0 and stay. Null, empty
    and wordless texts stay, long ones are scored whole, repeated rows fare alike. All columns are carried, whatever their
    names; an empty table gives an empty one.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 or more connect: the one of the smallest id.

    Rows without an id link as well and go if their group has an id; of a group without any, the smallest text digest stays.
    Texts without words have no group and stay, repeated rows of one id and text become one. All columns are carried; an empty
    table gives an empty one.
    """
    return one_of_each(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: four fifths of its five-word shingles.

    Texts are searched whole, whatever their id; items of fewer than five words are never found. Null and empty texts stay,
    repeated rows fare alike. All columns are carried; an empty table, or an empty benchmark, takes nothing away.
    """
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice.

    Null sources are one source. Texts without words have only their certain copies. Rows that equal each other in id, source
    and text are drawn alike. All columns are carried; reruns and other partitionings agree; an empty table gives an empty one.
    """
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; copies that the mix took share a shard.

    Null texts are a group of size one, null ids are numbered as well, repeated rows have slots of their own. Other columns are
    dropped; an empty table gives an empty one.
    """
    return shard_documents(docs, shards=16)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL cannot train the network nor follow links to components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
