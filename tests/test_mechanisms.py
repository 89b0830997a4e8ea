"""Private releases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoveil.operators import mechanisms as me
from chronoveil.operators.position import with_position

K = ["series_id"]
WINDOW, EPS = 20, 1.0


@pytest.fixture(scope="module")
def release(spark):
    rng = np.random.default_rng(0)
    rows = [(s, i, float(v), float(v) / 2) for s, n in ((0, 400), (1, 45), (2, 20))
            for i, v in enumerate(np.cumsum(rng.normal(0, 3, n)))]
    df = with_position(spark.createDataFrame(rows, "series_id bigint, t bigint, value double, k double"), K, "t")
    return df, me.publish_streams(df, K, "pos", ["value", "k"], [EPS, 8.0], [1, 2], 50.0, 20.0, WINDOW).cache()


def test_budget_of_every_window(release):
    pdf = release[1].toPandas()
    assert len(pdf) == 2 * 2 * 465
    for (_, eps, _), g in pdf.sort_values("pos").groupby(["series_id", "epsilon", "seed"]):
        used = g["eps_used"].rolling(WINDOW, min_periods=1).sum()
        assert used.max() <= 0.75 * eps + 1e-9
        assert (g["svt_used"] >= 0).all()
        # A row without budget repeats the row before it.
        v = g[["value", "k"]].to_numpy()
        quiet = (g["eps_used"].to_numpy() == 0)[1:]
        assert np.array_equal(v[1:][quiet], v[:-1][quiet])


def test_release_is_reproducible_and_seeded(release):
    df, first = release
    again = me.publish_streams(df.repartition(3), K, "pos", ["value", "k"], [EPS, 8.0], [1, 2], 50.0, 20.0, WINDOW)
    assert first.exceptAll(again).isEmpty()
    a, b = (first.filter(f"seed = {s} and pos = 0 and epsilon = 1.0 and series_id = 0").first()["value"] for s in (1, 2))
    assert a != b


def test_snapshot_restores_the_publisher():
    rng = np.random.default_rng(1)
    x, z = rng.normal(0, 5, (150, 2)), rng.laplace(size=(150, 2))
    u, t = rng.laplace(size=150), rng.laplace(size=150)
    whole = me.StreamPublisher(2.0, 20.0, 10.0, 10, 2, 2)
    split = me.StreamPublisher(2.0, 20.0, 10.0, 10, 2, 2)
    for i in range(150):
        a = whole.publish(x[i], z[i], u[i], t[i])
        if i % 7 == 0:
            fresh = me.StreamPublisher(2.0, 20.0, 10.0, 10, 2, 2)
            fresh.restore(split.snapshot())
            split = fresh
        assert a == split.publish(x[i], z[i], u[i], t[i])
        assert np.array_equal(whole.out, split.out)


def test_warm_up_budget_for_odd_windows():
    for window in (2, 7, 10, 50, 55):
        p = me.StreamPublisher(1.0, 5.0, 5.0, window, 2, 1)
        total = sum(p.publish(np.array([0.0]), np.array([0.1]), 0.0, 0.0)[0] for _ in range(window))
        assert total == pytest.approx(0.75)


def test_ledger_matches_release(release):
    out = me.budget_window_ledger(release[1].filter("epsilon = 1.0 and seed = 1"), K, "pos", "eps_used", 0.75, WINDOW)
    assert out.agg(F.min("eps_remain")).first()[0] >= -1e-9


def test_randomised_response_rates(spark):
    df = spark.range(30000).select("id", (F.col("id") % 5 + 1).cast("int").alias("label"))
    noisy = me.randomised_response(df, ["id"], "label", 1.0, 5, 3)
    p = math.e / (math.e + 4)
    assert noisy.filter("label = noisy_label").count() / 30000 == pytest.approx(p, abs=0.015)
    assert noisy.filter("noisy_label < 1 or noisy_label > 5").isEmpty()
    est = {r["noisy_label"]: r["estimate"] for r in me.debias_counts(noisy, [], "noisy_label", 1.0, 5).collect()}
    assert all(abs(v - 6000) < 900 for v in est.values())
    kept = me.randomised_response(df, ["id"], "label", 60.0, 5, 3)
    assert kept.filter("label != noisy_label").isEmpty()


def test_noise_spends_what_is_booked():
    """The budget is recovered from the noise of every release; no window spends more than the total."""
    rng = np.random.default_rng(3)
    for eps, window, span in ((1.0, 20, 50.0), (40.0, 100, 500.0), (200.0, 100, 500.0), (1000.0, 100, 500.0)):
        p = me.StreamPublisher(eps, span, span, window, 2, 1)
        spends, targets, level = [], set(), 0.0
        for _ in range(6 * window):
            level += rng.normal(0, span / 40)
            before = p.out
            booked, tested = p.publish(np.array([level]), np.array([1.0]), rng.laplace(), rng.laplace())
            targets.add(p.c)
            released = before is None or p.out[0] != before[0]
            actual = span / (p.out[0] - level) if released and booked > 0 else 0.0
            assert abs(actual - booked) < 1e-6 * eps or abs(actual - booked - tested) < 1e-6 * eps
            spends.append((actual, tested))
        for a in range(len(spends) - window + 1):
            part = spends[a:a + window]
            assert sum(x for x, _ in part) <= eps * (1 + 1e-9)
            assert sum(x for x, _ in part) <= 0.75 * eps + 0.125 * eps + 1e-6
        if eps >= 200:
            assert max(targets) > 1


def test_time_per_row_does_not_grow_with_the_window():
    import time
    cost = []
    for window in (200, 8000):
        p, rng = me.StreamPublisher(50.0, 100.0, 100.0, window, 2, 2), np.random.default_rng(1)
        rows = rng.normal(0, 30, (20_000, 2))
        start = time.process_time()
        for r in rows:
            p.publish(r, np.ones(2), 0.1, 0.1)
        cost.append(time.process_time() - start)
    assert cost[1] < 3 * cost[0]
