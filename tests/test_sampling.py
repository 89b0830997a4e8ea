"""Distribution and structure of the samplers."""

import math

import pytest
from pyspark.sql import functions as F

from chronoveil.functions.rng import gaussian, laplace, uniform
from chronoveil.operators import sampling as sp
from chronoveil.operators.position import spread_sequence, with_position

K = ["series_id"]


def units(spark, n, p, steps):
    return spark.range(n).select(F.lit(0).alias("g"), F.col("id").alias("unit"), F.lit(float(p)).alias("p"),
                                 F.lit(steps).cast("bigint").alias("steps"))


@pytest.mark.parametrize("p,steps", [(0.001, 5000), (0.03, 1000), (0.3, 200), (0.7, 100), (1.0, 40)])
@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_hits_are_independent_bernoulli(spark, p, steps, method):
    n = 400
    hits = sp.bernoulli_hits(units(spark, n, p, steps), ["g"], "unit", "p", "steps", 7, method).cache()
    assert hits.count() == hits.select("unit", "step").distinct().count()
    assert hits.agg(F.min("step"), F.max("step")).first()[1] < steps
    total, mean, var = hits.count(), n * steps * p, n * steps * p * (1 - p)
    assert abs(total - mean) <= 5 * math.sqrt(var) + 1e-9
    # Hits per step and per unit have binomial variance (no clustering, no repulsion).
    for axis, trials, cells in (("step", n, steps), ("unit", steps, n)):
        sq = hits.groupBy(axis).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        v = sq / cells - (total / cells) ** 2
        expected = trials * p * (1 - p)
        assert v == pytest.approx(expected, abs=6 * expected * math.sqrt(2 / cells) + 0.05)


def test_hits_within_a_chunk_are_uniform_pairs(spark):
    """Each pair of different steps is hit together with probability p^2."""
    n, p, steps = 20000, 0.25, 8
    hits = sp.bernoulli_hits(units(spark, n, p, steps), ["g"], "unit", "p", "steps", 11)
    pairs = hits.alias("a").join(hits.alias("b"), "unit").filter("a.step < b.step").groupBy("a.step", "b.step").count().collect()
    assert len(pairs) == steps * (steps - 1) // 2
    sd = math.sqrt(n * p * p * (1 - p * p))
    assert all(abs(r["count"] - n * p * p) < 5 * sd for r in pairs)


@pytest.fixture(scope="module")
def series(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2600, 0).otherwise(F.col("id") % 3 + 1).alias("series_id"), F.col("id").alias("t"))
    return with_position(df, K, "t").cache()


def test_poisson_mean_batch_size(series):
    draws = sp.poisson(series, K, "pos", 10, 2, 20, 3)
    sized = {r["series_id"]: r for r in sp.candidate_counts(series, K, 10, 2, 20).collect()}
    for r in draws.groupBy("series_id").count().collect():
        steps, cand = sized[r["series_id"]]["steps"], sized[r["series_id"]]["candidates"]
        assert abs(r["count"] - steps * 20) < 5 * math.sqrt(steps * 20)
        assert cand == (sized[r["series_id"]]["n"] - 10) // 2 + 1
    assert draws.filter(F.col("start_pos") != F.col("cand_id") * 2).isEmpty()


@pytest.mark.parametrize("lam,rounding,empty", [(0.4, "ceil", "error"), (0.3, "floor", "skip"), (1.0, "ceil", "error")])
def test_spaced_draws_at_most_one_per_interval(series, lam, rounding, empty):
    draws = sp.spaced(series, K, 10, 2, 20, lam, 3, rounding, empty).cache()
    assert draws.count() == draws.select(*K, "step", "interval_id").distinct().count()
    sized = sp.candidate_counts(series, K, 10, 2, 20)
    lay = sp.interval_layout(sized, K, F.lit(sp.interval_count(20, lam, rounding)), F.lit(lam), empty=empty)
    assert lay.groupBy(*K).agg(F.sum("size").alias("s"), F.max("candidates").alias("c")).filter("s != c").isEmpty()
    inside = draws.join(lay.select(*K, "interval_id", "lo", "size"), [*K, "interval_id"])
    assert inside.filter((F.col("cand_id") < F.col("lo")) | (F.col("cand_id") >= F.col("lo") + F.col("size"))).isEmpty()
    if lam == 1.0:
        per_step = draws.groupBy(*K, "step").count().select("count").distinct().collect()
        assert [r["count"] for r in per_step] == [20]


def test_samplers_by_name(series):
    for method, options in (("poisson", {}), ("pss", {"lam": 0.5}), ("pss", {"lam": 0.5, "mode": "paper"}), ("structured", {})):
        rows = sp.draw(method, series, K, 10, 2, 20, 3, **options)
        assert rows.columns == ["series_id", "step", "cand_id", "start_pos"] and rows.count() > 0
    with pytest.raises(ValueError):
        sp.draw("none", series, K, 10, 2, 20, 3)


def test_series_without_enough_candidates(spark):
    """A series with fewer than K candidates is drawn from where that is possible and an error where it is not."""
    df = spark.range(600).select(F.when(F.col("id") < 560, 0).otherwise(1).alias("series_id"), F.col("id").alias("t"))
    s = with_position(df, K, "t")
    for rows in (sp.poisson(s, K, "pos", 10, 2, 20, 3), sp.structured_wr(s, K, 10, 2, 20, 3)):
        assert {r["series_id"] for r in rows.select("series_id").distinct().collect()} == {0, 1}
    everything = sp.poisson(s, K, "pos", 10, 2, 20, 3).filter("series_id = 1").collect()
    assert sorted(r["cand_id"] for r in everything) == list(range(16))  # probability 1
    for rows in (sp.spaced(s, K, 10, 2, 20, 0.4, 3), sp.draw("pss", s, K, 10, 2, 20, 3, lam=0.4)):
        with pytest.raises(Exception, match="fewer than 20 candidate windows"):
            rows.collect()
    kept = sp.spaced(s, K, 10, 2, 20, 0.4, 3, short="drop")
    assert [r["series_id"] for r in kept.select("series_id").distinct().collect()] == [0]
    with pytest.raises(Exception, match="more spacing intervals"):
        sp.spaced(s, K, 10, 2, 10, 0.1, 3).collect()


def test_structured_draws_every_slot(series):
    draws = sp.structured_wr(series, K, 10, 2, 20, 3)
    assert draws.groupBy(*K, "step").agg(F.count_distinct("slot").alias("n")).filter("n != 20").isEmpty()


def test_balanced_intervals_equal_ntile(spark):
    from pyspark.sql.window import Window
    for n in (10, 11, 12, 23, 7):
        df = spark.range(n).withColumnRenamed("id", "c").withColumn("n", F.lit(n)).withColumn("one", F.lit(1))
        got = sp.balanced_intervals(df, 5, "c", "n").withColumn("w", F.ntile(5).over(Window.partitionBy("one").orderBy("c")) - 1)
        assert got.filter("interval_id != w").isEmpty()


def test_spread_sequence_is_complete(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 10), (4, 25)], "k int, n bigint")
    got = spread_sequence(df, ["k"], "n", "i", chunk=10).groupBy("k").agg(F.count("i").alias("c"), F.max("i").alias("m"),
                                                                         F.count_distinct("i").alias("d")).orderBy("k").collect()
    assert [(r["k"], r["c"], r["m"], r["d"]) for r in got] == [(2, 1, 0, 1), (3, 10, 9, 10), (4, 25, 24, 25)]


def test_noise_moments(spark):
    n = 40000
    df = spark.range(n).select(
        laplace(uniform(1, "l", F.col("id")), 2.0).alias("l"),
        gaussian(uniform(1, "a", F.col("id")), uniform(1, "b", F.col("id"))).alias("g"),
        uniform(1, "u", F.col("id"), method="xxhash64").alias("u"))
    r = df.agg(F.avg("l"), F.var_pop("l"), F.avg("g"), F.var_pop("g"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(r[0]) < 0.08 and r[1] == pytest.approx(8.0, rel=0.08)
    assert abs(r[2]) < 0.03 and r[3] == pytest.approx(1.0, rel=0.04)
    assert r[4] == pytest.approx(0.5, abs=0.01) and r[5] >= 0 and r[6] < 1
