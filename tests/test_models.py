"""Fitted and spectral operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoveil.operators import anomaly, augment, forecast, mechanisms as me, moments
from chronoveil.operators.position import with_position

K = ["series_id"]


@pytest.fixture(scope="module")
def population(spark):
    x = np.random.default_rng(2).normal(size=(90, 6)) @ np.random.default_rng(3).normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in row]) for i, row in enumerate(x)], "i bigint, part int, v array<double>")
    return x, df


def test_covariance_and_spectrum(population):
    x, df = population
    for keys in ([], ["part"]):
        cov = moments.covariance(df, keys, "v", held_keys=1).collect()
        for part in ([None] if not keys else [0, 1]):
            m = np.cov(x if part is None else x[part::2], rowvar=False, bias=True)
            rows = [r for r in cov if part is None or r["part"] == part]
            assert len(rows) == 21
            for r in rows:
                assert r["cov"] == pytest.approx(m[r["i"], r["j"]], abs=1e-9)
    spec = {r["part"]: r for r in moments.spectrum(moments.covariance(df, ["part"], "v"), ["part"]).collect()}
    for part in (0, 1):
        ev = np.linalg.eigvalsh(np.cov(x[part::2], rowvar=False, bias=True))
        assert spec[part]["spectral"] == pytest.approx(ev[-1]) and spec[part]["minimum_eigenvalue"] == pytest.approx(ev[0])
        assert spec[part]["effective_rank"] == pytest.approx(ev.sum() ** 2 / (ev ** 2).sum())
    with pytest.raises(Exception, match="not finite"):
        moments.covariance(df.withColumn("v", F.array(F.lit(float("nan")), F.lit(1.0))), [], "v").collect()


def test_rank_reconstruction(population):
    x, df = population
    got = [r["score"] for r in anomaly.rank_scores(df, "v", 2).orderBy("i").collect()]
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = ((c - c @ vt[:2].T @ vt[:2]) ** 2).mean(1)
    assert got == pytest.approx(list(want), abs=1e-8)


def test_simulated_trace_approaches_the_exact_one(population):
    x, df = population
    pop = df.withColumn("n", F.lit(90))
    exact = {r["method"]: r["trace"] for r in moments.analytic_traces(pop, "i", "n", "v", 10, 0.5, 20).collect()}
    q = 10 / 90
    assert exact["baseline"] == pytest.approx(q * (1 - q) * (x ** 2).sum() / 100)
    for method in ("baseline", "poisson"):
        draws = moments.trial_draws(pop, "i", "n", method, 10, 4000, 5, 0.5, 20)
        trace = moments.estimator_trace(moments.estimators(df, draws, "i", "v", 10), 4000).first()[0]
        assert trace == pytest.approx(exact[method], rel=0.12)


def test_bootstrap_traces_are_centred_on_the_population(population):
    x, df = population
    t = moments.bootstrap_traces(df.withColumn("n", F.lit(90)), "i", "n", "v", 200, 4)
    mean = t.agg(F.avg("trace")).first()[0]
    assert mean == pytest.approx(np.trace(np.cov(x, rowvar=False, bias=True)) * 89 / 90, rel=0.05)
    ci = moments.interval_95(t, []).first()
    v = np.array([r["trace"] for r in t.collect()])
    assert (ci["low"], ci["high"]) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))


def test_bootstrap_counts_are_multinomial():
    """Every range of a tree has the draws of its parts, members are drawn alike, and a block drawn alone has the draws it has in the whole."""
    n, total = 2500, np.zeros(2500)
    for rep in range(200):
        whole = dict(moments._ranges(f"s|{rep}", n, 0, 12, n, 0))
        assert sorted(whole) == list(range(n)) and sum(whole.values()) == n
        total += [whole[i] for i in range(n)]
        if rep < 3:
            for at, t in moments._ranges(f"s|{rep}", n, 0, 12, n, 10):
                assert dict(moments._ranges(f"s|{rep}", n, at, 10, t, 0)) == {i: whole[i] for i in range(at, min(at + 1024, n))}
    assert total.mean() == pytest.approx(200) and total.var() == pytest.approx(200, rel=0.1)


def test_bootstrap_over_blocks_and_groups(spark):
    """Groups of several blocks, one without a key, against counts drawn one by one."""
    rng = np.random.default_rng(12)
    x = {None: rng.normal(size=(1500, 3)), 4: rng.normal(size=(2100, 3))}
    rows = [(g, i, len(v), [float(a) for a in v[i]]) for g, v in x.items() for i in range(len(v))]
    df = spark.createDataFrame(rows, "g bigint, i bigint, n bigint, v array<double>").repartition(7)
    for r in moments.bootstrap_traces(df, "i", "n", "v", 5, 9, keys=["g"]).collect():
        v = x[r["g"]]
        counts = dict(moments._ranges(f"9|boot|{r['g']}|{r['rep']}", len(v), 0, 12 if len(v) > 2048 else 11, len(v), 0))
        c = np.array([counts[i] for i in range(len(v))])
        mean = (c[:, None] * v).sum(axis=0) / len(v)
        assert r["trace"] == pytest.approx(((c[:, None] * v * v).sum(axis=0) / len(v) - mean ** 2).sum(), rel=1e-9)


@pytest.fixture(scope="module")
def walk(spark):
    v = np.cumsum(np.random.default_rng(8).normal(size=200))
    df = spark.createDataFrame([(i // 100, i, float(x)) for i, x in enumerate(v)], "series_id bigint, t bigint, v double")
    return v, with_position(df, K, "t")


def test_linear_forecast_is_least_squares(walk):
    v, df = walk
    out = forecast.linear_forecast(df, K, "pos", "v", 3, 2).orderBy(*K, "pos").collect()
    rows = [(s * 100 + p, s) for s in (0, 1) for p in range(2, 98)]
    x = np.array([[1, v[i - 2], v[i - 1], v[i]] for i, _ in rows])
    for h in (1, 2):
        beta = np.linalg.lstsq(x, np.array([v[i + h] for i, _ in rows]), rcond=None)[0]
        assert [r[f"f{h}"] for r in out] == pytest.approx(list(x @ beta), abs=1e-6)


@pytest.mark.parametrize("block_rows", [None, 16])
def test_decomposed_forecast_is_the_smallest_fit(spark, walk, block_rows):
    v, df = walk
    lags, horizon, kernel = 5, 3, 3
    extra = {} if block_rows is None else {"block_rows": block_rows}
    if block_rows:
        df = df.withMetadata("pos", {})
    short = spark.createDataFrame([(7, i, float(i * i), i) for i in range(lags + horizon - 1)], "series_id bigint, t bigint, v double, pos bigint")
    out = forecast.linear_forecast(df.unionByName(short), K, "pos", "v", lags, horizon, kernel=kernel, **extra).orderBy(*K, "pos").collect()
    rows = [s * 100 + p for s in (0, 1) for p in range(lags - 1, 100 - horizon)]
    x = np.array([v[i - lags + 1:i + 1] for i in rows])
    padded = np.pad(x, ((0, 0), (1, 1)), mode="edge")
    trend = (padded[:, :-2] + padded[:, 1:-1] + padded[:, 2:]) / kernel
    both = np.hstack([x - trend, trend])
    assert len(out) == len(rows) and [list(r.x) for r in out] == [pytest.approx(list(a)) for a in x]
    for h in (1, 2, 3):
        y = np.array([v[i + h] for i in rows])
        w = np.linalg.lstsq(both - both.mean(axis=0), y - y.mean(), rcond=1e-9)[0]
        parts = (both[:, :lags] - both[:, :lags].mean(axis=0)) @ w[:lags], (both[:, lags:] - both[:, lags:].mean(axis=0)) @ w[lags:] + y.mean()
        assert [r[f"seasonal{h}"] for r in out] == pytest.approx(list(parts[0]), abs=1e-6)
        assert [r[f"trend{h}"] for r in out] == pytest.approx(list(parts[1]), abs=1e-6)
        assert [r[f"f{h}"] for r in out] == pytest.approx(list(parts[0] + parts[1]), abs=1e-6)


def test_linear_forecast_chooses_windows_and_refuses_nulls(spark, walk):
    v, df = walk
    out = forecast.linear_forecast(df, K, "pos", "v", 2, 1, F.col("x")[1] > 0).collect()
    x = np.array([[1, *r.x] for r in out])
    y = np.array([r.y[0] for r in out])
    beta = np.linalg.lstsq(x[x[:, 2] > 0], y[x[:, 2] > 0], rcond=None)[0]
    assert [r.f1 for r in out] == pytest.approx(list(x @ beta), abs=1e-6)
    with pytest.raises(ValueError):
        forecast.linear_forecast(df.withColumn("v", F.when(F.col("pos") != 3, F.col("v"))), K, "pos", "v", 2, 1)


def test_frequency_mask_zeroes_bins(spark):
    x = np.random.default_rng(6).normal(size=(5, 16))
    df = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id int, x array<double>")
    out = np.array([r["x"] for r in augment.frequency_mask(df, ["id"], "x", 16, 0.5, 3).orderBy("id").collect()])
    before, after = np.fft.rfft(x, axis=1), np.fft.rfft(out, axis=1)
    zero = np.abs(after) < 1e-9
    assert 0 < zero.sum() < zero.size
    assert np.allclose(after[~zero], before[~zero])
    whole = np.array([r["x"] for r in augment.frequency_mask(df, ["id"], "x", 16, 0.0, 3).orderBy("id").collect()])
    assert np.allclose(whole, x)


def test_partners_are_a_permutation(spark):
    df = spark.range(500)
    for parts in (1, 16):
        p = augment.shuffled_partner(df, ["id"], 3, parts)
        assert p.count() == 500 == p.select("id").distinct().count() == p.select("other_id").distinct().count()


def publish_whole(x, z, uq, ut, eps, s_p, s_s, window, back):
    """The release computed with whole arrays, rescanning the history at every row."""
    n, dim = x.shape
    eps_p, eps_q = 0.75 * eps, 0.125 * eps
    out, spent, tested = np.zeros_like(x), np.zeros(n), np.zeros(n)
    interval = min(20, window)
    warm = eps_p / int(np.ceil(window / interval))
    c, rho = 1, 0.0
    for i in range(n):
        if i < window:
            if i % interval == 0:
                out[i], spent[i] = x[i] + z[i] * s_p / warm, warm
            else:
                out[i] = out[i - 1]
        else:
            if i == window:
                rho = ut[i] * s_s / (0.125 * eps)
            lo = i - window + 1
            remain, share = eps_p - spent[lo:i].sum(), eps_p / c
            used = np.flatnonzero(spent[lo:i])
            first = lo + used[0] if len(used) else i
            left = window - (i - first)
            drift = np.abs(x[i] - x[i - 1]).sum() / dim + uq[i] * s_s * 2 * c / eps_q
            if left <= int(remain / share + 1e-9):
                rest = max(0.0, eps_q - tested[first:i].sum()) / c
                spent[i], tested[i] = remain / left, rest
                out[i] = x[i] + z[i] * s_p / (remain / left + rest)
            elif drift > c * s_p / eps_p + rho and remain >= share * (1 - 1e-9):
                tested[i] = eps_q / c
                spent[i] = min(share, remain)
                out[i] = x[i] + z[i] * s_p / spent[i]
            else:
                out[i] = out[i - 1]
        if i + 1 >= window:
            length = i + 1
            pairs = window * back - 1 if length >= window * back + 1 else length - 2
            d = np.diff(out[length - 1 - pairs:length], axis=0)
            sq, ab = (d ** 2).sum(1) / dim, np.abs(d).sum(1) / dim
            moved = sq > 0
            proxy = sq[moved].mean() - ab[moved].mean() ** 2 if moved.any() else 0.0
            c = max(int(np.sqrt(max(0.75 * proxy * eps_p ** 2 / s_p ** 2, 0.0)) / 3), 1)
    return out, spent, tested


@pytest.mark.parametrize("window,back,eps,scale", [(20, 2, 1.0, 3.0), (20, 2, 40.0, 30.0), (12, 3, 200.0, 80.0)])
def test_publisher_against_whole_array_version(window, back, eps, scale):
    rng = np.random.default_rng(window)
    x = np.cumsum(rng.normal(0, scale, (300, 2)), axis=0) * (rng.random((300, 1)) < 0.5)
    z, uq, ut = rng.laplace(size=(300, 2)), rng.laplace(size=300), rng.laplace(size=300)
    want = publish_whole(x, z, uq, ut, eps, 50.0, 20.0, window, back)
    p = me.StreamPublisher(eps, 50.0, 20.0, window, back, 2)
    got = []
    for i in range(300):
        used = p.publish(x[i], z[i], uq[i], ut[i])
        got.append((*p.out, *used))
    assert np.allclose(np.array(got), np.column_stack([want[0], want[1], want[2]]), rtol=1e-7, atol=1e-7)
    assert (want[1] > 0).sum() > 5
