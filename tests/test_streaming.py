"""Streams in several micro-batches equal their batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoveil.operators import mechanisms as me
from chronoveil.operators import windows as wn
from chronoveil.operators.position import with_position
from chronoveil.streaming import streams as st

K = ["series_id"]
ROCKSDB_CONF = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    spark.conf.set(ROCKSDB_CONF, st.ROCKSDB)
    path = str(tmp_path_factory.mktemp("stream"))
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), float(v), int(rng.integers(0, 2))) for i, v in enumerate(np.cumsum(rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "event_id bigint, series_id bigint, value double, label int")
    for a in range(0, 300, 60):  # five files in time order, one per micro-batch
        df.filter((F.col("event_id") >= a) & (F.col("event_id") < a + 60)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def stream(spark, data):
    return st.replay(spark, data[1], data[0].schema, bytes_per_batch=1)


def placed(data):
    return with_position(data[0], K, "event_id")


def test_count_windows(spark, data):
    got = st.run_available(st.count_windows(stream(spark, data), "series_id", "event_id", "value", 7), "cw")
    rows = wn.tumbling_rows(placed(data), K, "pos", 7)
    want = wn.gather_arrays(rows, ["series_id", "win_id"], F.col("value"))
    cols = ["series_id", "win_id", "x"]
    assert want.count() == got.count() > 0
    assert want.select(*cols).exceptAll(got.select(*cols)).isEmpty()


def test_change_runs(spark, data):
    got = st.run_available(st.change_runs(stream(spark, data), "series_id", "event_id", "label"), "cr")
    runs = wn.label_runs(placed(data), K, "pos", "label")
    ends = runs.groupBy("series_id").agg(F.max("run_stop").alias("n"))
    want = runs.join(ends, K).filter("run_stop < n").select("series_id", "label", "run_start", "run_stop")
    assert want.count() == got.count() > 0
    assert want.exceptAll(got.select(*want.columns)).isEmpty()


def test_private_release(spark, data):
    got = st.run_available(st.private_release(stream(spark, data), "series_id", "event_id", "event_id", ["value"], 2.0, 30.0, 10.0, 10), "pr")
    assert got.count() == 300
    pdf = got.toPandas().sort_values(["series_id", "pos"])
    for _, g in pdf.groupby("series_id"):
        assert list(g["pos"]) == list(range(len(g)))
        assert g["eps_used"].rolling(10, min_periods=1).sum().max() <= 1.5 + 1e-9
    # The same rows in one batch give the same release.
    one = st.run_available(st.private_release(st.replay(spark, data[1], data[0].schema), "series_id", "event_id", "event_id", ["value"],
                                              2.0, 30.0, 10.0, 10), "pr1")
    assert one.exceptAll(got).isEmpty()


def test_randomised_labels(spark, data):
    s = stream(spark, data).withColumn("label", F.col("label") + 1)
    got = st.run_available(st.randomised_labels(s, ["event_id"], "label", 1.0, 3, 9), "rl")
    want = me.randomised_response(data[0].withColumn("label", F.col("label") + 1), ["event_id"], "label", 1.0, 3, 9)
    assert want.select("event_id", "noisy_label").exceptAll(got.select("event_id", "noisy_label")).isEmpty()


def test_rows_out_of_order_wait_for_the_watermark(spark, data, tmp_path):
    """Files in shuffled order, and rows that move between files: windows and runs are those of the sorted rows."""
    df = data[0].withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60 + 1_700_000_000))
    path = str(tmp_path / "shuffled")
    for part in ("event_id % 2 = 1 and event_id < 250", "event_id % 2 = 0 and event_id < 250", "event_id >= 250"):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    last = 299 - 260  # rows that a delay of 260 minutes has not passed in the end, the first two files are never late
    seen = df.filter(F.col("event_id") <= last)
    late = st.replay(spark, path, df.schema, bytes_per_batch=1)
    got = st.run_available(st.count_windows(late, "series_id", "event_id", "value", 3, "ts", "260 minutes"), "cwo")
    rows = wn.tumbling_rows(with_position(seen, K, "event_id"), K, "pos", 3)
    want = wn.gather_arrays(rows, ["series_id", "win_id"], F.col("value")).select("series_id", "win_id", "x")
    assert want.count() == got.count() > 0 and want.exceptAll(got.select(*want.columns)).isEmpty()
    runs = st.run_available(st.change_runs(st.replay(spark, path, df.schema, bytes_per_batch=1), "series_id", "event_id", "label", "ts",
                                           "260 minutes"), "cro")
    whole = wn.label_runs(with_position(seen, K, "event_id"), K, "pos", "label")
    ends = whole.groupBy("series_id").agg(F.max("run_stop").alias("n"))
    closed = whole.join(ends, K).filter("run_stop < n").select("series_id", "label", "run_start", "run_stop")
    assert closed.count() == runs.count() > 0 and closed.exceptAll(runs.select(*closed.columns)).isEmpty()


def shuffled(spark, data, path):
    """The rows with a time, in files that are out of order, and the rows that a delay of 260 minutes passes in the end."""
    df = data[0].withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60 + 1_700_000_000))
    for part in ("event_id % 2 = 1 and event_id < 250", "event_id % 2 = 0 and event_id < 250", "event_id >= 250"):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return st.replay(spark, path, df.schema, bytes_per_batch=1), df.filter(F.col("event_id") <= 299 - 260)


def test_private_release_out_of_order(spark, data, tmp_path):
    """Shuffled files give the release of the sorted rows, over several windows and entries of the history."""
    late, seen = shuffled(spark, data, str(tmp_path / "late"))
    args = ("series_id", "event_id", "event_id", ["value"], 2.0, 30.0, 10.0, 5)
    got = st.run_available(st.private_release(late, *args, ts="ts", delay="260 minutes"), "pro")
    path = str(tmp_path / "sorted")
    seen.orderBy("event_id").coalesce(1).write.parquet(path)
    want = st.run_available(st.private_release(st.replay(spark, path, seen.schema), *args), "prs")
    assert got.count() == want.count() == seen.count() and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("window", [3, 40, 150])
def test_publisher_restored_from_rows(window):
    """A publisher put together from scalars and rows in sight goes on as one that never stopped."""
    rng = np.random.default_rng(window)
    whole, rows = me.StreamPublisher(50.0, 20.0, 10.0, window, 2, 2), []
    moved = me.StreamPublisher(50.0, 20.0, 10.0, window, 2, 2)
    for i in range(4 * window + 50):
        x, z, uq, ut = rng.normal(size=2) * 9, rng.laplace(size=2), rng.laplace(), rng.laplace()
        assert whole.publish(x, z, uq, ut) == moved.publish(x, z, uq, ut) and (whole.out == moved.out).all()
        rows.append(moved.last_row())
        if i % 7 == 3:
            scalars = moved.scalars()
            in_sight = scalars["i"] - max(moved.window, moved.history)
            moved = me.StreamPublisher(50.0, 20.0, 10.0, window, 2, 2)
            moved.restore_rows(scalars, [r for r in rows if r[0] >= in_sight])


def test_filled_bins(spark, data, tmp_path):
    """Bins of 5 minutes, most of them empty for some series, equal the batch operator up to the last bin the watermark closed."""
    from chronoveil.operators import clean
    late, seen = shuffled(spark, data, str(tmp_path / "bins"))
    got = st.run_available(st.resample_filled(late, "series_id", "event_id", "ts", "value", 120_000, "260 minutes"), "fb")
    timed = seen.withColumn("ms", F.unix_millis("ts"))
    batch = clean.resample_mean(timed, K, "ms", ["value"], 120_000).select("series_id", "bin", F.col("value").alias("mean"), "filled")
    last = timed.groupBy("series_id").agg(F.max(F.floor(F.col("ms") / 120_000)).alias("last"))
    passed = (1_700_000_000 + 60 * 39) * 1000
    want = batch.join(last, K).filter((F.col("bin") < F.col("last")) | ((F.col("bin") + 1) * 120_000 <= passed)).select(*batch.columns)
    rounded = lambda d: sorted((r.series_id, r.bin, round(r["mean"], 9), r.filled) for r in d.collect())
    assert rounded(got) == rounded(want) and any(r.filled for r in got.collect())


class CountedState:
    """Stands for the state of one series and counts the calls."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getValueState(self, *_):
        return self

    getMapState = getListState = getValueState

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "updateValue"):
                self.value = args[-1]
            return self.value if name.startswith("get") else self.value is not None and name == "exists"
        return call


@pytest.mark.parametrize("make", [lambda: st.CountWindows(7, "event_id", "value", "ts"),
                                  lambda: st.FilledBins("value", 3_600_000, "event_id", "ts")])
def test_a_series_costs_a_few_calls_of_state_for_a_batch(make):
    """Rows of 300 hours in one micro-batch are not a call of the state for each hour."""
    import pandas as pd
    rows = pd.DataFrame({"event_id": range(300), "value": np.arange(300.0), "row_ms": np.arange(300) * 3_600_000})
    rows["at_ms"] = rows["row_ms"]
    processor, state = make(), CountedState()
    processor.init(state)
    timers = type("Timers", (), {"getCurrentWatermarkInMs": lambda self: 400 * 3_600_000})()
    out = list(processor.handleInputRows((1,), iter([rows]), timers))
    assert sum(map(len, out)) == (42 if isinstance(processor, st.CountWindows) else 300) and state.calls <= 8
