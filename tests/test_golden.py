"""Hand-derived small cases."""

import math

import pytest
from pyspark.sql import functions as F

from chronoveil.functions import vectors as vec
from chronoveil.operators import checks, clean, ledger, mechanisms, metrics, runs, sampling, split, windows
from chronoveil.operators.position import with_position

K = ["series_id"]


def line(spark, values, **more):
    rows = [(0, i, v, *[m[i] for m in more.values()]) for i, v in enumerate(values)]
    kinds = {"int": "bigint", "float": "double", "str": "string", "NoneType": "double"}
    first = next((v for v in values if v is not None), 0.0)
    schema = f"series_id bigint, t bigint, v {kinds[type(first).__name__]}" + "".join(
        f", {n} {kinds[type(m[0]).__name__]}" for n, m in more.items())
    return with_position(spark.createDataFrame(rows, schema), K, "t")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("n,train,val,test", [(90, 62, 10, 18), (10, 7, 1, 2)])
def test_split_sizes(spark, n, train, val, test):
    parts = split.split_ratio(line(spark, [1.0] * n), K, "pos").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": train, "val": val, "test": test}


def test_window_counts(spark):
    s = line(spark, [float(i) for i in range(10)])
    starts = windows.window_rows(s, K, "pos", 4, 3).filter("offset = 0").orderBy("win_id").select("pos").collect()
    assert [r["pos"] for r in starts] == [0, 3, 6]
    assert windows.unit_windows(s, K, "pos", F.col("v"), 4, 2).count() == 5


def test_majority_tie_is_smallest(spark):
    rows = windows.tumbling_rows(line(spark, [3, 1, 3, 1]), K, "pos", 4)
    assert windows.majority_label(rows, ["series_id", "win_id"], "v").first()["label"] == 1


def test_intervals_and_partitions(spark):
    ten = spark.range(10).withColumnRenamed("id", "c").withColumn("n", F.lit(10))
    sizes = sampling.balanced_intervals(ten, 4, "c", "n").groupBy("interval_id").count().orderBy("interval_id").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]
    sized = spark.createDataFrame([(0, 10, 5)], "series_id bigint, candidates bigint, steps bigint")
    for mode, want in (("forecasting", [3, 3, 2, 2]), ("paper", [2, 2, 3, 3])):
        got = sampling.pss_partition(sized, K, 2, 0.5, mode).orderBy("interval_id").collect()
        assert [r["size"] for r in got] == want
        assert {r["activation"] for r in got} == {0.5}
    grid = sampling.lambda_grid(sized, "candidates", 5, 0.25).orderBy("lam").collect()
    assert [r["lam"] for r in grid] == [0.5, 0.75, 1.0]


def test_too_many_intervals_fail(spark):
    sized = spark.createDataFrame([(0, 3, 1)], "series_id bigint, candidates bigint, steps bigint")
    with pytest.raises(Exception, match="more spacing intervals"):
        sampling.interval_layout(sized, K, F.lit(4), F.lit(1.0)).collect()
    assert sampling.interval_layout(sized, K, F.lit(4), F.lit(1.0), empty="skip").count() == 3


def test_geometry(spark):
    g = sampling.geometry(line(spark, [1.0] * 100), K, 10, 5, 0.03).first()
    assert (g["candidates"], g["event_length"], g["affected"]) == (19, 3, 3)


def test_patterns_and_pmf(spark):
    geo = spark.createDataFrame([(4, 2)], "candidates bigint, affected bigint")
    got = {tuple((e["hits"], e["size"]) for e in r["pattern"])
           for r in ledger.affected_patterns(geo, ["candidates", "affected"], "candidates", "affected", F.lit(2)).collect()}
    assert got == {((2, 2),), ((1, 2), (1, 2))}
    pmf = spark.range(1).select(ledger.bernoulli_sum_pmf(F.array(F.lit(0.5), F.lit(0.5))).alias("p")).first()["p"]
    assert pmf == [0.25, 0.5, 0.25]
    eps = spark.range(1).select(ledger.epsilon_at(F.array(F.struct(F.lit(1.0).alias("rdp"), F.lit(2.0).alias("conv"))), F.lit(0)).alias("e"))
    assert eps.first()["e"] == 0.0


def test_fill_and_scale(spark):
    s = line(spark, [None, 1.0, None, 3.0, None])
    assert column(clean.interpolate_index(s, K, "pos", "v"), "v") == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert column(clean.zscore(line(spark, [5.0] * 3), K, ["v"]), "v_z") == [0.0, 0.0, 0.0]
    assert column(clean.minmax(line(spark, [2.0, 4.0, 6.0]), K, ["v"]), "v_mm") == [0.0, 0.5, 1.0]


def test_normalise_by_name(spark):
    s = line(spark, [2.0, 4.0, 6.0])
    assert column(clean.normalise(s, K, ["v"], "minmax"), "v") == [0.0, 0.5, 1.0]
    assert sum(column(clean.normalise(s, K, ["v"], "zscore"), "v")) == pytest.approx(0.0)
    with pytest.raises(ValueError):
        clean.normalise(s, K, ["v"], "none")


def test_constant_trend(spark):
    from chronoveil.operators import forecast
    out = forecast.decompose(line(spark, [7.0] * 40), K, "pos", "v", 25)
    assert {round(r["trend"], 9) for r in out.collect()} == {7.0}
    assert {round(r["seasonal"], 9) for r in out.collect()} == {0.0}


def test_clip(spark):
    df = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    assert mechanisms.clip_l2(df, "v", 1.0).first()["clipped"] == pytest.approx([0.6, 0.8])


def test_ranking(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, y int")
    for parts in (1, 4):
        row = metrics.ranking_metrics(df, [], "score", "y", parts).first()
        assert row["auroc"] == pytest.approx(0.75)
        assert row["ap"] == pytest.approx(0.8333333333)


def test_class_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int")
    row = metrics.class_metrics(metrics.confusion(df, [], "t", "p"), []).first()
    assert row["accuracy"] == pytest.approx(2 / 3) and row["macro_f1"] == pytest.approx(2 / 3)


def test_zero_targets_make_percentages_infinite(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "true double, pred double")
    row = metrics.forecast_metrics(df, [], "true", "pred").first()
    assert math.isinf(row["mape"]) and row["mae"] == 1.0


def test_text_rules(spark):
    df = spark.createDataFrame([("1,3-5",), (" 2 , x, 9-7, 4 -5",)], "s string")
    assert [r[0] for r in df.select(checks.id_ranges(F.col("s"))).collect()] == [[1, 3, 4, 5], [2, 4, 5]]
    units = spark.createDataFrame([(1.7e9,), (1.7e12,), (1.7e15,), (5.0,)], "t double")
    unit, ms = checks.time_unit_ms(F.col("t"), F.col("t"))
    assert [tuple(r) for r in units.select(unit, ms).collect()] == [
        ("s", 1700000000000), ("ms", 1700000000000), ("us", 1700000000000), ("ms", 5)]
    with pytest.raises(Exception, match="unparsable timestamp"):
        spark.createDataFrame([("2024-13-01 00:00:00",)], "s string").select(checks.strict_timestamp(F.col("s"))).collect()
    assert checks.time_column(["a", "ts", "time"]) == "time"
    assert checks.time_column(["a", "MyTime"]) == "MyTime"


def test_early_stop(spark):
    row = runs.early_stop(line(spark, [3.0, 2.0, 2.5, 2.4]), K, "pos", "v", 2).first()
    assert (row["stop_step"] + 1, row["best"], row["stopped"]) == (4, 2.0, True)


def test_strict_summary_refuses_mixed_steps(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7)], "g string, steps int, m double")
    with pytest.raises(Exception, match="steps differs across seeds"):
        runs.summary_strict(df, ["g"], ["m"], ["steps"]).collect()


def test_argmax_prefers_first(spark):
    df = spark.range(1).select(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)).alias("z"))
    assert df.select(vec.argmax(F.col("z"))).first()[0] == 1


def test_upsample_matches_half_pixel_rule(spark):
    from chronoveil.operators import augment
    df = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (0, 10, 20, 30)]).alias("x"))
    out = df.select(augment.upsample_half(F.col("x"), 4, F.lit(1))).first()[0]
    assert out == pytest.approx([10.0, 12.5, 17.5, 20.0])


def test_noise_patterns_over_the_whole_text(spark):
    from chronoveil.operators import textscan
    rows = [("a", 'x' * 5000 + '\n"""Module.\nDP notes: none'), ("b", "noise = torch.randn(3) * sigma"), ("c", "# DP: here"), ("d", "# dp: CLIP_NORM")]
    got = {r["id"]: r for r in textscan.flag_patterns(spark.createDataFrame(rows, "id string, text string"), "text", textscan.NOISE_PATTERNS).collect()}
    assert got["a"]["module_docstring"] and not got["b"]["module_docstring"]
    assert got["b"]["noise_injection"] and got["b"]["torch.randn"]
    assert got["c"]["dp_comment"] and not got["d"]["dp_comment"] and got["d"]["clipping_norm"]


def test_range_counts_follow_the_rows(spark):
    from chronoveil.operators.position import MAX_RANGES, key_ranges, range_count
    assert [range_count(n, 100) for n in (0, 1, 100, 101, 1000, 10 ** 9)] == [1, 1, 1, 2, 10, MAX_RANGES]
    df = spark.range(4000).selectExpr("concat('k', lpad(id, 5, '0')) AS a", "id % 3 AS b")
    block = key_ranges(df, ["a", "b"], 200)
    tagged = df.withColumn("blk", block)
    sizes = [r["count"] for r in tagged.groupBy("blk").count().collect()]
    assert max(sizes) < 1000 and len(sizes) > 8
    edges = tagged.groupBy("blk").agg({"a": "max"}).orderBy("blk").collect()
    assert [r[1] for r in edges] == sorted(r[1] for r in edges)
