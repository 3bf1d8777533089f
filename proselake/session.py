"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that a caller's hint may broadcast.
BROADCAST_BYTES = 16 << 20


def session(name: str = "proselake", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; master and memory are left to the caller and the cluster."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` hinted for broadcast if it has few enough rows for their width, else as it is; looks at no more rows than that and one."""
    rows = BROADCAST_BYTES // (df._jdf.schema().defaultSize() + 16)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
