"""Scans with explicit schemas, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_dirty_csv(spark: SparkSession, path: str, columns: list[str], numbers: list[str] = ()) -> DataFrame:
    """A CSV of strings with header, its byte order mark dropped; ``numbers`` become double, or null where they are none."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"')
    first = F.regexp_replace(F.col(columns[0]), f"^{BOM}", "")
    df = df.withColumn(columns[0], first)
    return df.withColumns({c: F.expr(f"try_cast(trim(trailing '%' from trim(`{c}`)) as double)") for c in numbers})


def usable_scores(df: DataFrame, column: str = "score") -> DataFrame:
    """Rows whose score is a number from 0 to 100."""
    return df.where(F.col(column).between(0, 100))


def write_csv(df: DataFrame, path: str, order: list[str], files: int | None = 1) -> None:
    """A CSV in a stable order, quotes doubled, behind a byte order mark; ``files`` parts (None: as many as the sort makes), each whole in itself."""
    first, *rest = df.columns
    rows = df.orderBy(*order).withColumnRenamed(first, BOM + first)
    rows = rows if files is None else rows.coalesce(files)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).option("encoding", "UTF-8").csv(path)


def merge_csv(spark: SparkSession, done_path: str, new: DataFrame, keys: list[str], numbers: list[str] = ()) -> DataFrame:
    """What a CSV holds already, and the new rows of other keys; a missing file holds nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return new
    done = read_dirty_csv(spark, done_path, new.columns, numbers).select(*[F.col(f.name).cast(f.dataType) for f in new.schema])
    return done.unionByName(resume(new, done, keys))


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def write_reports(df: DataFrame, path: str) -> None:
    """Each row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def account_export(tables: dict[str, DataFrame], account: str, secrets: set[str] = frozenset()) -> DataFrame:
    """``name, row``: an account's rows of each table as JSON, without secret columns; a row for each, whatever their number."""
    out = None
    for name, df in sorted(tables.items()):
        kept = [c for c in df.columns if c not in secrets]
        own = df.where(F.col("account_id") == account).select(F.lit(name).alias("name"), F.to_json(F.struct(*kept)).alias("row"))
        out = own if out is None else out.unionByName(own)
    return out
