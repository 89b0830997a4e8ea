"""Readers, writers and identities."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoveil.operators.position import with_position
from chronoveil.sources import series as src
from chronoveil.sources import sinks


def test_series_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,x,y\n2024-01-01 00:00:00,1.5,\n2024-01-01 00:00:10,NaN,2\n")
    schema = T.StructType([T.StructField("date", T.TimestampType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    rows = src.read_series(spark, str(tmp_path / "a.csv"), schema).orderBy("date").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(1.5, 0.0), (0.0, 2.0)]
    (tmp_path / "b.csv").write_text("date,x,y\n2024-01-01 00:00:00,Infinity,1\n")
    with pytest.raises(Exception, match="not a finite number"):
        src.read_series(spark, str(tmp_path / "b.csv"), schema).collect()
    with pytest.raises(ValueError):
        src.read_series(spark, "x", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def test_pruned_rejects_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, x double")
    with pytest.raises(Exception, match="not a finite number"):
        src.pruned(df, ["id"], ["x"]).collect()


def test_labels(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "id int, label int")
    assert sorted(r["label"] for r in src.labelled(df, "label").collect()) == [0, 1]
    assert sorted(r["label"] for r in src.labelled(df.withColumn("label", F.col("label") - 1), "label").collect()) == [0, 1]
    with pytest.raises(Exception, match="must be integers"):
        src.labelled(df.withColumn("label", F.col("label") + 0.5), "label").collect()


def test_sensor_files(spark, tmp_path):
    for name in ("acc_walking_chest.csv", "Gyroscope_walking_chest.csv", "readme_walking.csv"):
        (tmp_path / name).write_text("attr_time,attr_x\n1,0.5\n2,0.7\n")
    schema = T.StructType([T.StructField("attr_time", T.LongType()), T.StructField("attr_x", T.DoubleType())])
    df = src.read_sensor_files(spark, [str(tmp_path)], schema)
    got = {(r["sensor"], r["action"], r["position"], r["n"]) for r in df.groupBy("sensor", "action", "position").agg(F.count("*").alias("n")).collect()}
    assert got == {("acc", "walking", "chest", 2), ("Gyroscope", "walking", "chest", 2)}


def test_run_tree(spark, tmp_path):
    for seed in (42, 43):
        d = tmp_path / f"epsilon_1" / f"seed_{seed}"
        d.mkdir(parents=True)
        (d / "config.json").write_text(json.dumps({"model": "linear", "seed": seed}, indent=1))
        (d / "metrics.json").write_text(json.dumps({"test_accuracy": seed / 100}, indent=1))
    c = src.read_run_json(spark, str(tmp_path), "config.json", T._parse_datatype_string("model STRING, seed INT"))
    m = src.read_run_json(spark, str(tmp_path), "metrics.json", T._parse_datatype_string("test_accuracy DOUBLE"))
    rows = c.join(m, "run_dir").orderBy("seed").collect()
    assert [(r["seed"], r["test_accuracy"]) for r in rows] == [(42, 0.42), (43, 0.43)]


def test_bad_bounds_version(spark):
    df = spark.createDataFrame([(1, '{"version": 2, "splits": {}}')], "id int, doc string")
    with pytest.raises(Exception, match="unknown boundary version"):
        src.explode_bounds(df, "doc", ["id"]).collect()


def test_cache_detects_change(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i < 7 else "test") for i in range(10)], "x int, split string")
    path = str(tmp_path / "c")
    sinks.cache_splits(df, path, "split", "id-1")
    assert sinks.load_cached(spark, path, "split", "id-1").count() == 10
    with pytest.raises(ValueError):
        sinks.load_cached(spark, path, "split", "id-2")
    df.filter("x < 2").write.mode("append").partitionBy("split").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        sinks.load_cached(spark, path, "split", "id-1")


def test_identities(spark, tmp_path):
    df = with_position(spark.range(50).withColumn("g", F.lit(0)).withColumn("y", F.col("id") * 3), ["g"], "id")
    one = sinks.table_identity(df, "pos", ["id", "y"], fanout=4, levels=3).first()[0]
    assert one == sinks.table_identity(df.repartition(7), "pos", ["id", "y"], fanout=4, levels=3).first()[0]
    moved = df.withColumn("y", F.when(F.col("id") == 49, 0).otherwise(F.col("y")))
    assert one != sinks.table_identity(moved, "pos", ["id", "y"], fanout=4, levels=3).first()[0]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert sinks.file_identity(spark, str(tmp_path / "f.bin")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_stored_series_needs_no_shuffle(spark, tmp_path):
    """Frames, statistics and carries over a stored series plan no exchange; another session finds the table by its path."""
    from chronoveil.operators.position import framed, series_stats
    rows = spark.range(600).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("key"), (F.col("id") * 3).alias("t"))
    placed = with_position(rows, ["key"], "t")
    path = f"file://{tmp_path}/series"
    sinks.cache_series(placed, path, "stored_series", ["key"], "pos", 4)

    def build(df):
        out = framed(df, ["key"], "pos", 3, 0, {"s": lambda w: F.sum("t").over(w.rowsBetween(-3, 0))})
        return series_stats(out, ["key"], "pos", {"n": F.count("*")})
    for again in (False, True):
        if again:
            spark.sql("DROP TABLE stored_series")
        found = sinks.load_series(spark, path)
        out = build(found)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.select("key", "pos", "t", "s", "n").exceptAll(build(placed).select("key", "pos", "t", "s", "n")).isEmpty() and out.count() == 600
    with pytest.raises(ValueError):
        sinks.cache_series(rows.withColumn("pos", F.col("t")), path, "stored_again", ["key"], "pos", 4)


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b c.csv"), (2, "a/b c.csv"), (3, "d=1.csv")], "x int, name string")
    sinks.write_named(df, f"file://{tmp_path}/out", "name")
    assert sorted((tmp_path / "out" / "a" / "b c.csv").read_text().split()) == ["1", "2", "x"]
    assert (tmp_path / "out" / "d=1.csv").read_text().split() == ["x", "3"]
