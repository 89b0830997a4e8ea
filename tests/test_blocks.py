"""A series that holds most rows is cut into blocks; results must equal the plain one-window plan."""

import pytest
from pyspark.sql import functions as F

from chronoveil.operators import anomaly, clean, forecast, mechanisms, position as ps, runs, windows

K = ["series_id"]
SMALL = 16  # rows per block in these tests


@pytest.fixture(scope="module")
def raw(spark):
    """One series with 500 of 560 rows, irregular times with ties, gaps in the value."""
    i = F.col("id")
    df = spark.range(560).select(
        F.when(i < 500, 0).otherwise(1 + i % 3).cast("bigint").alias("series_id"), i.alias("event_id"),
        (F.floor(i * i / 40) * 1000 + F.pmod(i * 7919, F.lit(3))).cast("bigint").alias("t"),
        F.when(F.pmod(i * 31, F.lit(7)) > 2, F.pmod(i * 7907, F.lit(101)).cast("double")).alias("gappy"),
        F.pmod(i * 7907, F.lit(101)).cast("double").alias("value"), F.pmod(i * 613, F.lit(53)).cast("double").alias("k"),
        F.pmod(F.floor(i / 5) * 17, F.lit(4)).cast("int").alias("label"))
    return df.repartition(5, "event_id").cache()


@pytest.fixture(scope="module")
def short(raw):
    return ps.with_position(raw, K, "t", ["event_id"])


@pytest.fixture(scope="module")
def long(raw):
    return ps.with_position(raw, K, "t", ["event_id"], block_rows=SMALL)


def same(a, b, sort, rel=1e-9):
    left, right = ([tuple(r) for r in df.select(*a.columns).orderBy(*sort).collect()] for df in (a, b))
    assert len(left) == len(right) > 0
    for x, y in zip(left, right):
        for u, v in zip(x, y):
            assert u == v or u == pytest.approx(v, rel=rel, abs=1e-9), (x, y)


ID = ["series_id", "pos"]


def test_position_equals_plain_row_number(short, long):
    same(short.select(*ID, "event_id"), long.select(*ID, "event_id"), ID)


def test_position_of_equal_times_with_text_ties(spark):
    """No range has more rows than its share where all times are equal, ties are texts and a key is null."""
    i = F.col("id")
    df = spark.range(900).select(F.when(i % 9 > 0, 0).cast("bigint").alias("series_id"), F.lit(5).cast("bigint").alias("t"),
                                 F.format_string("e%04d", (i * 7919) % 1000).alias("name")).repartition(4)
    cut = ps.with_position(df, K, "t", ["name"], block_rows=SMALL)
    same(ps.with_position(df, K, "t", ["name"]).select("name", "pos"), cut.select("name", "pos"), ["name"])
    assert cut.schema["pos"].metadata[ps.ROW_BOUND] == 800


@pytest.mark.parametrize("kind", ["equal", "burst"])
def test_position_of_bursts_and_equal_times(spark, kind):
    """Most rows of the long series share one time, or lie in a sliver of its range."""
    i = F.col("id")
    t = F.when(i < 700, 5000) if kind == "equal" else F.when(i < 700, 5000 + F.pmod(i * 7919, F.lit(601)))
    df = spark.range(1000).select(F.when(i % 50 == 0, 9).otherwise(0).cast("bigint").alias("series_id"), i.alias("event_id"),
                                  t.otherwise(i * 1000).cast("bigint").alias("t")).repartition(4)
    cols = ["series_id", "event_id", "pos"]
    plain = ps.with_position(df, K, "t", ["event_id"])
    cut = ps.with_position(df, K, "t", ["event_id"], block_rows=SMALL)
    same(plain.select(*cols), cut.select(*cols), ["series_id", "event_id"])
    sizes = ps._refine(df.withColumn("_long", F.col("series_id") == 0).withColumn(ps.BLK, F.floor(F.col("t") / 20000)), K, "t",
                       ["event_id"], SMALL).filter("_long").groupBy(ps.BLK, "_sub").count().agg(F.max("count")).first()[0]
    assert sizes <= 4 * SMALL


def test_bound_is_recorded(short, long):
    assert ps.is_short(short, K, "pos", 1000) and ps.is_short(short, [*K, "x"], "pos", 1000)
    assert not ps.is_short(short, [], "pos", 1000)  # measured for single series, not for all rows
    assert ps.group_bound(short, K) == 4 and ps.group_bound(short, ["label"]) is None
    assert not ps.is_short(long, K, "pos", SMALL)
    assert long.schema["pos"].metadata[ps.ROW_BOUND] == 500


def test_long_plan_has_no_whole_series_window(long):
    text = ps.framed(long, K, "pos", 3, 2, {"s": lambda w: F.sum("value").over(w.rowsBetween(-3, 2))}, SMALL
                     )._jdf.queryExecution().optimizedPlan().toString()
    assert "[series_id" in text and "windowspecdefinition(series_id" in text
    assert all("_blk" in part for part in text.split("windowspecdefinition(")[1:] if "sum(value" in part[:200])


def test_framed(short, long):
    ex = {"s": lambda w: F.sum("value").over(w.rowsBetween(-5, 4)), "l": lambda w: F.lag("k", 5).over(w),
          "n": lambda w: F.lead("k", 4).over(w)}
    same(ps.framed(short, K, "pos", 5, 4, ex).select(*ID, "s", "l", "n"),
         ps.framed(long, K, "pos", 5, 4, ex, SMALL).select(*ID, "s", "l", "n"), ID)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carry(short, long, forward, inclusive):
    blk = F.floor(F.col("pos") / SMALL)
    # Knock out whole blocks so that a carry has to cross several of them.
    v = F.when((F.col("pos") < 40) | (F.col("pos") > 200), F.col("gappy"))
    a = ps.carry(short, K, "pos", None, {"c": v}, forward, inclusive)
    b = ps.carry(long, K, "pos", blk, {"c": v}, forward, inclusive)
    same(a.select(*ID, "c"), b.select(*ID, "c"), ID)


def test_running_sum_and_minimum(short, long):
    blk = F.floor(F.col("pos") / SMALL)
    same(ps.running_sum(short, K, ["pos"], None, {"r": F.col("value")}).select(*ID, "r"),
         ps.running_sum(long, K, ["pos"], blk, {"r": F.col("value")}).select(*ID, "r"), ID)
    same(ps.minimum_before(short, K, "pos", None, "value", "m").select(*ID, "m"),
         ps.minimum_before(long, K, "pos", blk, "value", "m").select(*ID, "m"), ID)


def test_fillers(short, long):
    for fn in (clean.interpolate_index, clean.fill_forward_back):
        same(fn(short, K, "pos", "gappy").select(*ID, "gappy"),
             fn(long, K, "pos", "gappy", block_rows=SMALL).select(*ID, "gappy"), ID)


def test_resample(short):
    a = clean.resample_mean(short, K, "t", ["value"], 5000, block_bins=10 ** 6)
    b = clean.resample_mean(short, K, "t", ["value"], 5000, block_bins=7)
    same(a, b, ["series_id", "bin"])


def test_windows_runs_and_scores(short, long):
    same(windows.unit_windows(short, K, "pos", F.col("value"), 6, 3).select("series_id", "start_pos", F.array_join("x", ",").alias("x")),
         windows.unit_windows(long, K, "pos", F.col("value"), 6, 3, block_rows=SMALL).select("series_id", "start_pos", F.array_join("x", ",").alias("x")),
         ["series_id", "start_pos"])
    same(windows.label_runs(short, K, "pos", "label"), windows.label_runs(long, K, "pos", "label", SMALL), ["series_id", "run_start"])
    cols = ["series_id", "pos", "score", "windows"]
    plain = anomaly.window_mean_scores_exploded(short, K, "pos", ["value", "k"], 12).select(*cols)
    same(plain, anomaly.window_mean_scores(short, K, "pos", ["value", "k"], 12).select(*cols), ID)
    same(plain, anomaly.window_mean_scores(long, K, "pos", ["value", "k"], 12, SMALL).select(*cols), ID)


def test_other_frames(short, long):
    same(forecast.moving_trends(short, K, "pos", "value", [5, 25]).select(*ID, "trend_5", "trend_25"),
         forecast.moving_trends(long, K, "pos", "value", [5, 25], SMALL).select(*ID, "trend_5", "trend_25"), ID)
    same(mechanisms.stream_dissimilarity(short, K, "pos", ["value", "k"], 10, 2).select(*ID, "dis", "sq", "proxy"),
         mechanisms.stream_dissimilarity(long, K, "pos", ["value", "k"], 10, 2, SMALL).select(*ID, "dis", "sq", "proxy"), ID)
    spent = lambda df: df.withColumn("eps", F.when(F.col("event_id") % 9 == 0, 0.25).otherwise(0.0))
    for window in (5, 90):
        same(mechanisms.budget_window_ledger(spent(short), K, "pos", "eps", 4.0, window).select(*ID, "eps_remain", "first_sampled"),
             mechanisms.budget_window_ledger(spent(long), K, "pos", "eps", 4.0, window, SMALL).select(*ID, "eps_remain", "first_sampled"), ID)
    for strict in (False, True):
        for delta in (0.0, 3.0):
            same(runs.early_stop(short, K, "pos", "value", 4, strict, delta=delta),
                 runs.early_stop(long, K, "pos", "value", 4, strict, SMALL, delta), K)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_rows", [2, 7, 1 << 20])
def test_early_stop_by_a_minimum_improvement(spark, strict, block_rows):
    """Against a scan of each run, with null losses and a patience beyond the block."""
    i = F.col("id")
    df = spark.range(400).select((i % 5).alias("series_id"), F.floor(i / 5).cast("bigint").alias("pos"), F.when(
        F.pmod(i * 31, F.lit(11)) > 0, 60 - F.floor(i / 20) + F.pmod(i * 7907, F.lit(41)) / 4.0).alias("loss"))
    for patience, delta in ((3, 2.0), (9, 0.5), (200, 1.0)):
        got = {r["series_id"]: tuple(r)[1:] for r in runs.early_stop(df, K, "pos", "loss", patience, strict, block_rows, delta).collect()}
        for key in range(5):
            losses = [r["loss"] for r in df.filter(F.col("series_id") == key).orderBy("pos").collect()]
            best, last, stop = losses[0], 0, None
            for step, loss in enumerate(losses[1:], 1):
                if best is None or (loss is not None and (loss < best - delta if strict else loss <= best - delta)):
                    best, last = loss, step
                elif step - last >= patience:
                    stop = step
                    break
            assert got[key] == (len(losses) - 1 if stop is None else stop, best, last, stop is not None)


def test_long_frames_by_prefix_sums(short, long):
    """Frames beyond the direct limit equal Spark's own sliding frames."""
    from pyspark.sql.window import Window
    w = Window.partitionBy(*K).orderBy("pos")
    rows = 200
    plain = short.withColumn("s", F.sum("value").over(w.rowsBetween(-(rows - 1), 0)))
    for df, size in ((short, 10 ** 6), (long, SMALL)):
        same(plain.select(*ID, "s"), ps.framed(df, K, "pos", rows, 0, ps.trailing_sum("s", F.col("value"), rows), size).select(*ID, "s"), ID)
    eps = short.withColumn("eps", F.when(F.col("event_id") % 9 == 0, 0.25).otherwise(0.0))
    frame = w.rowsBetween(-(rows - 1), -1)
    want = eps.select(*ID, (4.0 - F.coalesce(F.sum("eps").over(frame), F.lit(0.0))).alias("eps_remain"),
                      F.coalesce(F.min(F.when(F.col("eps") > 0, F.col("pos"))).over(frame), "pos").alias("first_sampled"))
    same(want, mechanisms.budget_window_ledger(eps, K, "pos", "eps", 4.0, rows).select(*want.columns), ID)


def test_regrid(short, long):
    def grid(df, **kw):
        ends = df.withColumn("lo", F.lit(0).cast("bigint")).withColumn("hi", F.lit(4_000_000).cast("bigint"))
        return clean.regrid(ends.select("series_id", "pos", "t", "value", "lo", "hi"), K, "pos", "t", ["value"], 7000, "lo", "lo", "hi", **kw
                            ).select("series_id", "grid", "value")
    same(grid(short), grid(long, block_rows=SMALL), ["series_id", "grid"])


def test_parts_grow_with_the_rows(spark):
    """Windows over many short series, and over copies of neighbouring blocks, get parts by rows, not the session's eight."""
    import re

    from chronoveil.operators import position as po
    rows = 800_000
    df = spark.range(rows).select((F.col("id") % 9973).alias("series_id"), F.col("id").alias("t"))
    placed = po.with_position(df, ["series_id"], "t")
    most = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 1.3 * po.TASK_ROWS
    copied = po.framed(placed, ["series_id"], "pos", 64, 0, {"p": lambda w: F.lag("t", 64).over(w)}, 16)
    plan = copied._jdf.queryExecution().sparkPlan().toString()
    assert max(int(n) for n in re.findall(r"_blk#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)) >= rows * 5 // po.TASK_ROWS
