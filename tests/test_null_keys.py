"""A null key is a key: every operator gives the rows of a table whose null key is spelled -1 instead."""

import pytest
from pyspark.sql import functions as F

from chronoveil.operators import (anomaly, augment, checks, clean, forecast, ledger, mechanisms, metrics, moments, position as ps, relational, runs,
                                  sampling, split, windows)

K = ["g"]


def table(spark, null):
    i = F.col("id")
    g = F.when(i % 3 > 0, (i % 3).cast("bigint"))
    return spark.range(240).select(
        (g if null else F.coalesce(g, F.lit(-1).cast("bigint"))).alias("g"), i.alias("event_id"), (F.floor(i / 3) * 60).cast("bigint").alias("t"),
        F.pmod(i * 7907, F.lit(101)).cast("double").alias("value"), F.pmod(i * 613, F.lit(53)).cast("double").alias("k"),
        F.when(F.pmod(i * 31, F.lit(7)) > 2, F.pmod(i * 7907, F.lit(101)).cast("double")).alias("gappy"),
        F.pmod(i, F.lit(2)).cast("int").alias("label"), F.floor(i / 60).cast("bigint").alias("seed"))


def series(spark, null, block_rows=None):
    return ps.with_position(table(spark, null), K, "t", ["event_id"], **({"block_rows": block_rows} if block_rows else {}))


def grid(s):
    return s.select("g", "seed").distinct()


GEO = "select g, 400L as candidates, 12L as affected from values (1L), (2L)"

CASES = {
    "forecast_tail": lambda s: split.forecast_tail(s, K, "pos", "t", "value", 4, 2, 60),
    "gather": lambda s: windows.gather(s.filter("pos % 20 = 0").select("g", F.col("pos").alias("start_pos")), s.select("g", "pos", "value"), K, "pos", 3),
    "dense_labels": lambda s: windows.dense_labels(s.select("g", "event_id"), "g").select("g", "event_id", "dense"),
    "dense_labels_ranges": lambda s: windows.dense_labels(s.select("g", "event_id"), "g", parts=3).select("g", "event_id", "dense"),
    "covariance": lambda s: moments.covariance(s.select("g", F.array("value", "k").alias("v")), K, "v"),
    "early_stop": lambda s: runs.early_stop(s, K, "pos", "value", 4),
    "early_stop_by": lambda s: runs.early_stop(s, K, "pos", "value", 4, delta=1.5),
    "early_stop_blocks": lambda s: runs.early_stop(s.withMetadata("pos", {}), K, "pos", "value", 4, True, 16, 1.5),
    "budget_cutoff": lambda s: runs.budget_cutoff(s.select("g", "pos"), K, "pos", F.sqrt(F.col("pos")), 3.0),
    "paired_ratios": lambda s: runs.paired_ratios(s.groupBy("g", "seed", "label").agg(F.avg("value").alias("value")), K, "seed", "label", "value", 0),
    "completion": lambda s: runs.completion(grid(s), grid(s).filter("seed <> 2"), ["g", "seed"], K, "seed"),
    "missing_from_grid": lambda s: relational.missing_from_grid(grid(s), grid(s).filter("seed <> 2").unionByName(grid(s).filter("seed = 1")), ["g", "seed"]),
    "tiling": lambda s: checks.tiling(s.select("g", (F.col("pos") * 2).alias("a"), (F.col("pos") * 2 + 2).alias("b"), "event_id"), K, "a", "b", "event_id",
                                      s.groupBy("g").agg((F.count("*") * 2).alias("n"))),
    "monotonic": lambda s: checks.monotonic(s, K, "pos", "t", 60, 1.0, ["gappy"]),
    "aligned": lambda s: checks.aligned(s, s.filter("pos <> 5"), K, "pos", "t"),
    "unseen_classes": lambda s: relational.unseen_classes(s.filter("g is null or g < 2"), s, "g"),
    "batch_stats": lambda s: sampling.batch_stats(s.select("g", (F.col("pos") % 7).alias("step")), s.groupBy("g").agg(F.lit(8).cast("bigint").alias("steps")), K),
    "select_lambda": lambda s: ledger.select_lambda(s.groupBy("g").agg(F.lit(400).cast("bigint").alias("candidates"), F.lit(12).cast("bigint").alias("affected")),
                                                    K, "candidates", "affected", 8, 4.0, 1e-5, 4.0, 0.25),
    "budget_plan": lambda s: ledger.budget_plan(s.groupBy("g").agg(F.lit(60).cast("bigint").alias("candidates"), F.lit(4).cast("bigint").alias("affected")),
                                                K, 4, 4.0, 1e-5, [2.0], 50, 0.4),
    "memoised": lambda s: ledger.memoised(s.select("g", "event_id"), K, lambda d: d.withColumn("n", F.lit(1))),
    "zscore": lambda s: clean.zscore(s, K, ["value"]) if hasattr(clean, "zscore") else s,
    "naive": lambda s: forecast.naive(s, K, "pos", "value", 2),
    "window_mean": lambda s: forecast.window_mean(s, K, "pos", "value", 5),
    "decompose": lambda s: forecast.decompose(s, K, "pos", "value", 5),
    "linear_forecast": lambda s: forecast.linear_forecast(s, K, "pos", "value", 3, 2, kernel=3),
    "boosted": lambda s: forecast.boosted_forecast(s, K, "pos", "value", 2, 2),
    "keep_complete": lambda s: relational.keep_complete(s, K, "label", [0, 1]),
    "pooled_position": lambda s: split.pooled_position(s.select("g", "pos"), K, "pos"),
    "budget_window_ledger": lambda s: mechanisms.budget_window_ledger(s.withColumn("eps", F.when(F.col("pos") % 9 == 0, 0.25).otherwise(0.0)), K, "pos", "eps", 4.0, 5),
    "seed_aggregate": lambda s: moments.seed_aggregate(s.groupBy("g").agg(F.avg("value").alias("value")), K, ["value"]),
}


def rows(df, null):
    if null and "g" in df.columns:
        df = df.withColumn("g", F.coalesce("g", F.lit(-1).cast("bigint")))
    def plain(v):
        return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v
    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(CASES))
def test_null_is_a_key(name, spark):
    got, want = (rows(CASES[name](series(spark, null)), null) for null in (True, False))
    assert got == want and got
    if name not in ("unseen_classes",):
        assert any(-1 in r for r in got)


@pytest.mark.parametrize("mix", ["mix_pairs", "frequency_mix"])
def test_windows_without_id_are_mixed(mix, spark):
    wins = series(spark, True).groupBy("g", F.floor(F.col("pos") / 8).alias("win")).agg(F.sort_array(F.collect_list("value")).alias("x"))
    out = augment.mix_pairs(wins, ["g", "win"], "x", 3) if mix == "mix_pairs" else augment.frequency_mix(wins, ["g", "win"], "x", 8, 0.5, 3)
    ids = sorted(map(tuple, wins.select("g", "win").collect()), key=repr)
    assert sorted(map(tuple, out.select("g", "win").collect()), key=repr) == ids
    assert sorted(map(tuple, out.select("other_g", "other_win").collect()), key=repr) == ids
