"""Ledgers against direct numpy evaluation of the published bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoveil.operators import ledger as lg

GEO = ["candidates", "affected"]
DELTA = 1e-5


@pytest.fixture(scope="module")
def geo(spark):
    return spark.createDataFrame([(100, 9), (61, 13), (40, 4)], "candidates bigint, affected bigint")


def lse(xs):
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def test_poisson_moment(geo):
    rows = lg.rdp_poisson(geo.withColumn("q", F.lit(5.0) / F.col("candidates")), "q", "affected", 4.0, 2, 20).collect()
    for r in rows:
        q, m, a = 5 / r["candidates"], r["affected"], r["alpha"]
        want = lse([math.log(math.comb(m, k)) + (m - k) * math.log(1 - q) + k * math.log(q) + a * (a - 1) * k * k / 32
                    for k in range(m + 1)]) / (a - 1)
        assert r["rdp"] == pytest.approx(want, rel=1e-9)


def test_certain_sampling(spark):
    g = spark.createDataFrame([(3, 1.0)], "affected bigint, q double")
    r = lg.rdp_poisson(g, "q", "affected", 4.0, 2, 2).first()
    assert r["rdp"] == pytest.approx(2 * 9 / 32)


def brute_patterns(sizes, m):
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = set()
    for s in range(len(owner) - m + 1):
        ids, hits = np.unique(owner[s:s + m], return_counts=True)
        out.add(tuple(sorted((int(h), int(sizes[i])) for i, h in zip(ids, hits))))
    return out


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("count", [1, 3, 7, 13, 40])
def test_patterns_against_brute_force(geo, count, last):
    got = {}
    for r in lg.affected_patterns(geo, GEO, "candidates", "affected", F.lit(count), larger_last=last).collect():
        got.setdefault((r["candidates"], r["affected"]), set()).add(tuple((e["hits"], e["size"]) for e in r["pattern"]))
    for n, m in ((100, 9), (61, 13), (40, 4)):
        base, rem = divmod(n, count)
        sizes = [base + (i >= count - rem if last else i < rem) for i in range(count)]
        assert got[(n, m)] == brute_patterns(sizes, m)


def spaced_bound(n, w, batch, lam, sigma, a):
    """Log moment by listing the hit counts of the two partly covered intervals and the m full ones."""
    count = max(1, math.floor(batch / lam))
    z, xi, c = max(n // count, 1), batch / count, a * (a - 1) / (2 * sigma ** 2)
    if z > w:
        b0 = 0.5
    else:
        rho = math.ceil(w / 2) / z - math.ceil((w - z) / 2) / z - 0.5
        e5, e8, e9 = (math.exp(-k * c) for k in (5, 8, 9))
        roots = np.array([e9 - 3 * e8 + 3 * e5 - 1, (2 * rho - 1) * (e9 - 2 * e8 + e5),
                          e9 * (rho - 0.5) ** 2 - (2 * rho ** 2 + 0.5) * e8 + (rho + 0.5) ** 2 * e5])
        disc = roots[1] ** 2 - 4 * roots[0] * roots[2]
        b0 = max(0.0, (-roots[1] - math.sqrt(disc)) / (2 * roots[0])) if disc >= 0 else 0.0
    m = max(math.floor((w - (2 * math.ceil(b0 * z) - 1)) / z), 0)
    ends = [math.floor((w - m * z) / 2) / z, math.ceil((w - m * z) / 2) / z]
    terms = []
    for r in range(m + 1):
        inner = 1.0 if xi == 1 else math.comb(m, r) * (1 - xi) ** (m - r) * xi ** r
        for h0 in (0, 1):
            for h1 in (0, 1):
                p = inner
                for h, e in ((h0, ends[0]), (h1, ends[1])):
                    p *= xi * e if h else 1 - xi * e
                if p > 0:
                    terms.append(math.log(p) + c * (r + h0 + h1) ** 2)
    return lse(terms) / (a - 1)


def test_spaced_poisson_by_enumeration(geo):
    """Also in orders so large that one term dominates by more than a double can hold."""
    rows = lg.rdp_spaced_poisson(geo.withColumn("lam", F.explode(F.array(F.lit(0.5), F.lit(0.8), F.lit(1.0)))), "candidates",
                                 "affected", 5, "lam", 2.0, 2, 64).collect()
    assert len(rows) == 3 * 3 * 63
    for r in rows:
        want = spaced_bound(r["candidates"], r["affected"], 5, r["lam"], 2.0, r["alpha"])
        assert r["rdp"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_steps_are_the_largest_within_budget(geo):
    rdp = lg.rdp_poisson(geo.withColumn("q", F.lit(5.0) / F.col("candidates")), "q", "affected", 4.0)
    packed = lg.collapse(rdp, GEO, DELTA).withColumn("target", F.explode(F.array(*[F.lit(t) for t in (0.1, 1.0, 4.0, 16.0)])))
    out = lg.max_steps(packed, "orders", F.col("target"), 500)
    for r in out.collect():
        assert r["epsilon"] <= r["target"]
        if r["steps"] < 500:
            assert r["next_epsilon"] > r["target"] and r["exhausted"]
    monotone = out.groupBy(*GEO).agg(F.corr("target", "steps").alias("c"))
    assert monotone.filter("c < 0").isEmpty()


def test_more_noise_allows_more_steps(geo):
    def total(sigma):
        rdp = lg.rdp_poisson(geo.withColumn("q", F.lit(5.0) / F.col("candidates")), "q", "affected", sigma)
        return lg.max_steps(lg.collapse(rdp, GEO, DELTA), "orders", F.lit(4.0), 10 ** 6).agg(F.sum("steps")).first()[0]
    assert total(2.0) < total(4.0) < total(8.0)


def test_search_is_never_worse_than_any_rate(geo):
    best = {tuple(r[c] for c in GEO): r for r in lg.select_lambda(geo, GEO, *GEO, 5, 4.0, DELTA, 4.0).collect()}
    grid = lg.search_grid(geo, "candidates", 5)
    rdp = lg.rdp_spaced_poisson(grid, *GEO, 5, "lam", 4.0, 2, 64)
    steps = lg.max_steps(lg.collapse(rdp, [*GEO, "base_spacing", "lam"], DELTA), "orders", F.lit(4.0), F.col("base_spacing") * 100)
    tops = {(r["candidates"], r["affected"]): r["m"] for r in steps.groupBy(*GEO).agg(F.max("steps").alias("m")).collect()}
    assert tops
    for key, top in tops.items():
        assert best[key]["max_steps"] == top
    small = next(r for k, r in best.items() if k not in tops or tops[k] == 0) if len(tops) < len(best) else None
    assert small is None or not small["feasible"]


def test_binomial_weights_sum_to_one(geo):
    w = lg.binomial_weights(geo, F.col("affected") / F.col("candidates"), 7).groupBy(*GEO).agg(F.sum("weight").alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in w.collect())
