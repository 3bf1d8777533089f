"""Snapshots of tables with receipts: written, verified by digest, restored. Encryption is Parquet's own, by its write and read options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.operations import verify_receipts

RECEIPTS = "_receipts"


def _files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``path, sha256, length, modified`` of a snapshot's data files, paths from its root on."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{path}/{n}" for n in names])
    own = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
    return found.select(own.alias("path"), F.sha2("content", 256).alias("sha256"), "length", F.unix_timestamp("modificationTime").alias("modified"))


def write_snapshot(tables: dict[str, DataFrame], path: str, options: dict[str, str] | None = None) -> DataFrame:
    """Each table as Parquet under ``path``, and the receipts of all files, which it returns; an existing snapshot is an error."""
    for name, df in tables.items():
        df.write.options(**(options or {})).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    _files(spark, path, sorted(tables)).write.json(f"{path}/{RECEIPTS}")
    return read_receipts(spark, path)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, sha256 string, length long, modified long").json(f"{path}/{RECEIPTS}")


def verify_snapshot(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``path, state`` of every receipt: ``ok``, ``missing`` or ``different``."""
    return verify_receipts(_files(spark, path, names), read_receipts(spark, path))


def missing_tables(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    """Of ``required`` the tables that a snapshot has no receipt for."""
    there = read_receipts(spark, path).select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()
    wanted = spark.createDataFrame([(n,) for n in required], "name string")
    return sorted(r.name for r in wanted.join(there, "name", "left_anti").collect())


def restore(spark: SparkSession, path: str, names: list[str], options: dict[str, str] | None = None, required: list[str] = ()) -> dict[str, DataFrame]:
    """The tables of a snapshot whose files all have the digests of their receipts, and that holds all ``required`` tables; else an error that names some."""
    if required and (gone := missing_tables(spark, path, list(required))):
        raise ValueError(f"the snapshot lacks {gone}")
    bad = [tuple(r) for r in verify_snapshot(spark, path, names).where("state <> 'ok'").limit(5).collect()]
    if bad:
        raise ValueError(f"the snapshot does not verify: {bad}")
    return {n: spark.read.options(**(options or {})).parquet(f"{path}/{n}") for n in names}
