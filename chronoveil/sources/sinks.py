"""Writers, materialised caches and table identities."""

from __future__ import annotations

import json
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoveil.operators.position import ROW_BOUND, SERIES_COUNT, mark_bound


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "csv") -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy(split).option("header", True).format(fmt).save(path)


def write_per_key(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet",
                  max_records: int = 5_000_000) -> None:
    """One folder per key value. Rows stay in their tasks, so a hot key is written by many tasks, each file bounded."""
    (df.write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", max_records)
     .format(fmt).save(path))


def write_named(df: DataFrame, path: str, name: str, fmt: str = "csv") -> None:
    """One file for each value of ``name``, at that name below ``path`` (it may have folders); the other columns are its rows.

    The rows of a file are written by one task. Files are then moved to their names, one call for each.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged"
    df.repartition(name).write.partitionBy(name).option("header", True).format(fmt).save(staged)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(staged)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for group in files.listStatus(folder):
        head, _, value = group.getPath().getName().partition("=")
        if head != name:
            continue
        parts = [f.getPath() for f in files.listStatus(group.getPath()) if f.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{len(parts)} files for {value}")
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{unquote(value)}")
        files.mkdirs(target.getParent())
        if not files.rename(parts[0], target):
            raise ValueError(f"{target.toString()} cannot be written")
    files.delete(folder, True)


def cache_splits(df: DataFrame, path: str, split: str, identity: str) -> None:
    """Materialise splits with a metadata table holding the source identity and the row count of each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    (written.groupBy(split).agg(F.count(F.lit(1)).alias("rows")).withColumn("identity", F.lit(identity))
     .write.mode("overwrite").parquet(f"{path}/meta"))


def load_cached(spark: SparkSession, path: str, split: str, identity: str) -> DataFrame:
    """Read a cache back; identity and row counts must agree with the metadata."""
    data = spark.read.parquet(f"{path}/data")
    meta = spark.read.parquet(f"{path}/meta")
    counts = data.groupBy(split).agg(F.count(F.lit(1)).alias("_have"))
    wrong = meta.join(counts, split, "full").filter(
        ~F.col("rows").eqNullSafe(F.col("_have")) | (F.col("identity") != identity))
    if not wrong.isEmpty():
        raise ValueError("cache does not belong to this source or is incomplete")
    return data


def cache_series(df: DataFrame, path: str, table: str, keys: Sequence[str], pos: str, buckets: int) -> None:
    """Store a series with positions as a table in buckets of its keys, each one sorted file, and beside it what is known of the series.

    ``pos`` comes from ``with_position``, so its longest series has been measured.
    """
    known = df.schema[pos].metadata
    if ROW_BOUND not in known:
        raise ValueError(f"{pos} has no measured bound; place the rows by with_position")
    spark = df.sparkSession
    (df.repartition(buckets, *keys).sortWithinPartitions(*keys, pos).write.mode("overwrite").format("parquet").option("path", f"{path}/data")
     .bucketBy(buckets, *keys).sortBy(*keys, pos).saveAsTable(table))
    spark.createDataFrame([(table, list(keys), pos, buckets, known[ROW_BOUND], known[SERIES_COUNT], df.schema.json())], _SERIES_META).write.mode(
        "overwrite").parquet(f"{path}/meta")


_SERIES_META = "name string, keys array<string>, pos string, buckets int, longest bigint, series bigint, schema string"


def load_series(spark: SparkSession, path: str) -> DataFrame:
    """A stored series, from any session: windows over its keys in the order of ``pos`` need neither a count nor a shuffle."""
    meta = spark.read.schema(_SERIES_META).parquet(f"{path}/meta").first()
    if not spark.catalog.tableExists(meta.name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(meta["schema"])).fields)
        keys = ", ".join(f"`{k}`" for k in meta["keys"])
        spark.sql(f"CREATE TABLE {meta.name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}, `{meta.pos}`) "
                  f"INTO {meta.buckets} BUCKETS LOCATION '{path}/data'")
    return mark_bound(spark.table(meta.name), meta.pos, meta.longest, meta["keys"], meta.series)


def table_identity(df: DataFrame, pos: str, cols: Sequence[str], fanout: int = 1024, levels: int = 4) -> DataFrame:
    """SHA-256 of an ordered table: names and types of its columns, its number of rows, and a hash tree of its values.

    A value is written with its length and a null as a mark of its own, so no two tables have the same text. The tree has
    rows, then ``fanout`` hashes at a time, then the root: no task ever concatenates more than ``fanout`` hashes, except
    the root, which sees one per ``fanout**levels`` rows.
    """
    def sized(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    text = F.concat(*[sized(F.col(c).cast("string")) for c in cols])
    head = "".join(f"{len(part)}:{part}" for c in cols for part in (c, df.schema[c].dataType.simpleString()))
    node = df.select(F.col(pos).alias("_i"), F.sha2(text, 256).alias("_h"), F.lit(1).cast("bigint").alias("_n"))
    for level in range(levels + 1):
        group = F.floor(F.col("_i") / F.lit(fanout)) if level < levels else F.lit(0)
        ordered = F.array_sort(F.collect_list(F.struct("_i", "_h")))
        node = (node.withColumn("_g", group.cast("bigint")).groupBy("_g")
                .agg(F.sha2(F.array_join(ordered["_h"], ""), 256).alias("_h"), F.sum("_n").alias("_n"))
                .withColumnRenamed("_g", "_i"))
    return node.select(F.sha2(F.concat(F.lit(head), F.col("_n").cast("string"), F.lit(":"), F.col("_h")), 256).alias("identity"))


def derived_identity(identity: Column, signature: str) -> Column:
    """Identity of a subset: the identity of its source and a text that names the subset."""
    return F.sha2(F.concat(identity, F.lit(signature)), 256)


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2(F.col("content"), 256).alias("sha256"))
