"""Parquet table reader that fixes the time types at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoveil.session import prepare


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet`` with zone-less timestamps read as UTC instants.

    The cast is a projection over the scan: column pruning and filters on other columns still reach the files.
    """
    prepare(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    zoneless = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    if not zoneless:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in zoneless else F.col(c) for c in df.columns])
