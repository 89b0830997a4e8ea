"""Readers for series, labelled streams, file-name metadata and run results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column, name: str, allow_nan: bool = False) -> Column:
    """The value, failing the job on infinity (and on NaN/null unless allowed); costs no extra pass."""
    x = c.cast("double")
    bad = F.abs(x) == F.lit(float("inf"))
    if not allow_nan:
        bad = bad | F.isnan(x) | x.isNull()
    return F.when(bad, F.raise_error(F.lit(f"column {name} has a value that is not a finite number"))).otherwise(x)


def clean_series(df: DataFrame, t: str, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Timestamp-first series: NaN and null become 0, infinity is an error."""
    cols = [F.coalesce(F.nanvl(finite(F.col(c), c, allow_nan=True), F.lit(0.0)), F.lit(0.0)).alias(c)
            for c in features]
    return df.select(t, *ids, *cols)


def read_series(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a series whose first column is its time; the schema is explicit, so nothing is inferred."""
    first = schema.fields[0].name
    if len(schema.fields) < 2 or not first.lower().startswith(("timestamp", "time", "date")):
        raise ValueError("expected a timestamp column followed by numeric features")
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return clean_series(df, first, [f.name for f in schema.fields[1:]])


def pruned(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Only the feature columns, in single precision, every value finite. The selection reaches the file scan."""
    return df.select(*ids, *[finite(F.col(c), c).cast("float").alias(c) for c in features])


def labelled(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    """Integer labels, shifted to start at 0 only when the smallest label is at least 1."""
    exact = F.col(label).cast("double")
    whole = F.when(exact != F.floor(exact), F.raise_error(F.lit("labels must be integers"))).otherwise(
        exact.cast("int"))
    lowest = df.agg(F.min(F.col(label).cast("int"))).scalar()
    rest = [c for c in df.columns if c != label]
    shifted = whole - F.when(lowest >= 1, F.lit(1)).otherwise(F.lit(0))
    return df.select(*rest, shifted.alias(out))


def read_headerless(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Comma-separated rows of floats without a header, columns c0..c{width-1}."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(width)])
    return spark.read.schema(schema).csv(path, header=False)


# Fixed format: {sensor}_{action}_{position}.csv, any case.
SENSOR_FILE = r"(?i)^(acc|Gyroscope)_([a-z]+)_([a-z]+)\.csv$"


def sensor_name(file: Column) -> dict[str, Column]:
    """Sensor, action and position named by a file; null where the name does not match."""
    ok = file.rlike(SENSOR_FILE)
    part = {n: F.regexp_extract(file, SENSOR_FILE, i) for i, n in enumerate(("sensor", "action", "position"), 1)}
    return {"sensor": F.when(ok, part["sensor"]), "action": F.when(ok, F.lower(part["action"])),
            "position": F.when(ok, F.lower(part["position"]))}


def read_sensor_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Read all sensor CSVs in one scan and tag each row from the name of its file; other files are dropped."""
    df = spark.read.schema(schema).option("header", True).csv(list(paths))
    named = df.select("*", F.col("_metadata.file_name").alias("file_name"))
    return named.withColumns(sensor_name(F.col("file_name"))).filter(F.col("sensor").isNotNull())


def activity_of(path: Column) -> Column:
    """Activity number of a file named a{activity}t{trial}."""
    return F.regexp_extract(path, r"a(\d+)t\d+[^/]*$", 1).try_cast("int")


def bounds_from_json(text: Column) -> Column:
    """Array of (sequence_id, start, stop) per split, from a boundaries document of version 1."""
    doc = F.from_json(text, "version INT, splits MAP<STRING, ARRAY<STRUCT<sequence_id: STRING, start: BIGINT, "
                            "stop: BIGINT>>>")
    return F.when(doc["version"] != 1, F.raise_error(F.lit("unknown boundary version"))).otherwise(doc["splits"])


def explode_bounds(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    per_split = df.select(*ids, F.explode(bounds_from_json(F.col(text))).alias("split", "items"))
    return per_split.select(*ids, "split", F.inline("items"))


def read_run_json(spark: SparkSession, root: str, file: str, schema: T.StructType) -> DataFrame:
    """All ``file`` documents of a result tree, keyed by their folder."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", file).json(root)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("run_dir"), "*")


def parse_run_json(configs: DataFrame, metrics: DataFrame, key: str, config_schema: str,
                   metrics_schema: str) -> DataFrame:
    """Join the parsed ``config`` and ``metrics`` documents of the same run."""
    c = configs.select(key, F.from_json("config", config_schema).alias("c")).select(key, "c.*")
    m = metrics.select(key, F.from_json("metrics", metrics_schema).alias("m")).select(key, "m.*")
    return c.join(m, key)
