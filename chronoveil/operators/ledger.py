"""Privacy-budget ledgers as table jobs.

Input is one row per tenant with its sampling geometry. Rates depend on the geometry only, so every ledger is first
computed for the distinct geometries (usually few) and joined back. A ledger in long form has one row per
(geometry, order); ``collapse`` packs the at most 63 orders of a geometry into an array for the budget functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.position import join_null_safe


def log_sum_exp_over(last: Column, term: Callable[[Column, Column], Column], m: Column) -> Column:
    """log(sum_{k=0..last} exp(term(k, ln C(m, k)))) in one pass with a running maximum; null terms are left out."""
    start = F.struct(F.lit(0.0).alias("lnc"), F.lit(-1e308).alias("top"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        x = term(k, acc["lnc"])
        grown = F.struct(
            (acc["lnc"] + F.coalesce(F.ln((m - k) / (k + 1.0)), F.lit(0.0))).alias("lnc"),
            F.greatest(acc["top"], x).alias("top"),
            F.when(x.isNull(), acc["sum"]).when(x > acc["top"], acc["sum"] * F.exp(acc["top"] - x) + 1.0)
            .otherwise(acc["sum"] + F.exp(x - acc["top"])).alias("sum"))
        return grown

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), start, step,
                       lambda acc: acc["top"] + F.ln(acc["sum"]))


def conversion(alpha: Column, delta: float) -> Column:
    """Renyi to (epsilon, delta) conversion term of an order."""
    a = alpha.cast("double")
    return (F.lit(math.log(1.0 / delta)) + (a - 1.0) * F.ln(1.0 - 1.0 / a) - F.ln(a)) / (a - 1.0)


def with_orders(df: DataFrame, low: int, high: int) -> DataFrame:
    """One row per order low..high (inclusive)."""
    return df.withColumn("alpha", F.explode(F.sequence(F.lit(low), F.lit(high))))


def rdp_poisson(geo: DataFrame, rate: str, affected: str, sigma: float, low: int = 2, high: int = 63,
                distance: int = 1) -> DataFrame:
    """Renyi divergence per step of Poisson sampling with ``affected`` windows at risk.

    ``distance=1`` uses the exponent a(a-1)k^2/(2 sigma^2); ``distance=2`` the one of a replacement at distance 2,
    2a(a-1)k^2/sigma^2.
    """
    q, m, a = F.col(rate), F.col(affected), F.col("alpha").cast("double")
    c = a * (a - 1.0) * F.lit((distance * distance) / (2.0 * sigma * sigma))

    def term(k: Column, lnc: Column) -> Column:
        return lnc + (m - k) * F.ln(1.0 - q) + k * F.ln(q) + c * k * k

    sure = c * m * m
    log_moment = F.when(q >= 1.0, sure).otherwise(log_sum_exp_over(m, term, m))
    return with_orders(geo, low, high).withColumn("rdp", F.greatest(F.lit(0.0), log_moment / (a - 1.0)))


def moment_rdp(pmf: Column, alpha: Column, sigma: float, distance: int = 2) -> Column:
    """Renyi divergence of a shifted Gaussian whose integer shift has the given pmf (an array from 0)."""
    a = alpha.cast("double")
    c = a * (a - 1.0) * F.lit((distance * distance) / (2.0 * sigma * sigma))
    logs = F.transform(pmf, lambda p, j: F.when(p > 0, F.ln(p) + c * j * j))
    top = F.array_max(logs)
    total = F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.exp(x - top), F.lit(0.0)))
    return F.greatest(F.lit(0.0), (top + F.ln(total)) / (a - 1.0))


def bernoulli_sum_pmf(probabilities: Column) -> Column:
    """Pmf of a sum of independent Bernoulli variables, by convolution over an array."""
    def convolve(acc: Column, p: Column) -> Column:
        miss = F.concat(F.transform(acc, lambda x: x * (1.0 - p)), F.array(F.lit(0.0)))
        hit = F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda x: x * p))
        return F.zip_with(miss, hit, lambda x, y: x + y)

    return F.aggregate(probabilities, F.array(F.lit(1.0)), convolve)


def affected_patterns(geo: DataFrame, keys: Sequence[str], candidates: str, affected: str, count: Column,
                      larger_last: bool = False) -> DataFrame:
    """Distinct multisets of (hits, interval size) over all positions of a block of ``affected`` candidates.

    Intervals come in two lengths, those of one length side by side. Inside such a region a block that is moved by one interval
    has the same pattern, and so has one that is moved inside its interval: the blocks that end with the first interval or leave it
    stand for the region. Add the blocks that cross the border of the two regions, and there are at most three for each affected
    candidate, however many candidates there are. Interval bounds are arithmetic in the interval index, so no range join is
    needed.
    """
    base_df = (geo.withColumn("_k", count.cast("bigint"))
               .withColumn("_base", F.floor(F.col(candidates) / F.col("_k")).cast("bigint"))
               .withColumn("_rem", F.col(candidates) - F.col("_base") * F.col("_k")))
    k, base, rem, s, m, n = (F.col(c) for c in ("_k", "_base", "_rem", "_s", affected, candidates))

    def between(low: Column, high: Column) -> Column:
        low, high = low.cast("bigint"), high.cast("bigint")
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))

    def region(begin: Column, size: Column, length: Column) -> Column:
        return between(begin + F.greatest(F.lit(0), size - m), begin + F.least(size - 1, length - m))

    border = (k - rem) * base if larger_last else rem * (base + 1)
    sizes = (base, base + 1) if larger_last else (base + 1, base)
    chosen = F.array_distinct(F.concat(
        region(F.lit(0), sizes[0], border), region(border, sizes[1], n - border),
        between(F.greatest(F.lit(0), border - m + 1), F.least(border - 1, n - m))))
    starts = base_df.withColumn("_s", F.explode(chosen))

    def bound(i: Column) -> Column:
        longer = F.greatest(F.lit(0), i - (k - rem)) if larger_last else F.least(i, rem)
        return i * base + longer

    def index(x: Column) -> Column:
        if larger_last:
            plain = (k - rem) * base
            return F.when(x < plain, F.floor(x / base)).otherwise(k - rem + F.floor((x - plain) / (base + 1)))
        head = rem * (base + 1)
        return F.when(x < head, F.floor(x / (base + 1))).otherwise(rem + F.floor((x - head) / base))

    touched = F.sequence(index(s).cast("bigint"), index(s + m - 1).cast("bigint"))
    entries = F.transform(touched, lambda i: F.struct(
        (F.least(bound(i + 1), s + m) - F.greatest(bound(i), s)).alias("hits"), (bound(i + 1) - bound(i)).alias("size")))
    return starts.select(*keys, F.array_sort(entries).alias("pattern")).distinct()


def rdp_pss(patterns: DataFrame, keys: Sequence[str], activation: Column, sigma: float, low: int = 2,
            high: int = 64) -> DataFrame:
    """Largest moment bound over all block positions, per order."""
    p = F.transform("pattern", lambda e: activation * e["hits"] / e["size"])
    with_pmf = patterns.withColumn("_pmf", bernoulli_sum_pmf(p))
    rows = with_orders(with_pmf, low, high).withColumn("_r", moment_rdp(F.col("_pmf"), F.col("alpha"), sigma))
    return rows.groupBy(*keys, "alpha").agg(F.max("_r").alias("rdp"))


def _b0(rho: Column, c: Column) -> Column:
    """Offset at which the worst block position changes: smaller root of a quadratic whose coefficients are scaled
    by exp(-9c); 0 where there is no valid root."""
    e5, e8, e9 = (F.exp(F.lit(-k) * c) for k in (5.0, 8.0, 9.0))
    qa = e9 - 3.0 * e8 + 3.0 * e5 - 1.0
    slope = 2.0 * rho - 1.0
    qb = slope * (e9 - 2.0 * e8 + e5)
    qc = e9 * (rho - 0.5) * (rho - 0.5) - (2.0 * rho * rho + 0.5) * e8 + (rho + 0.5) * (rho + 0.5) * e5
    disc = qb * qb - 4.0 * qa * qc
    root = (-qb - F.sqrt(F.greatest(disc, F.lit(0.0)))) / F.nullif(2.0 * qa, F.lit(0.0))
    return F.when((disc < 0) | root.isNull() | F.isnan(root) | (root < 0), F.lit(0.0)).otherwise(root)


def full_blocks(w: Column, spacing: Column, c: Column) -> Column:
    """Number of intervals an affected block of w candidates covers completely in the worst position."""
    half = F.ceil(w / 2.0) / spacing - F.ceil((w - spacing) / 2.0) / spacing - 0.5
    b0 = F.when(spacing > w, F.lit(0.5)).otherwise(_b0(half, c))
    edge = 2 * F.ceil(b0 * spacing) - 1
    return F.greatest(F.floor((w - edge) / spacing), F.lit(0)).cast("bigint")


def rdp_spaced_fixed(geo: DataFrame, spacing: str, affected: str, sigma: float, low: int = 2, high: int = 63) -> DataFrame:
    """Three-term bound of the fixed-size spaced sampler; ``spacing`` is the interval length floor(n/K)."""
    t, w, a = F.col(spacing).cast("double"), F.col(affected).cast("double"), F.col("alpha").cast("double")
    c = a * (a - 1.0) / F.lit(2.0 * sigma * sigma)
    rows = with_orders(geo, low, high).withColumn("_m", full_blocks(w, t, c).cast("double"))
    m = F.col("_m")
    free, used = (m + 2.0) * t - w, w - m * t
    weights = [free * free / (4.0 * t * t), free * used / (2.0 * t * t), used * used / (4.0 * t * t)]
    args = [c * m * m, c * (m + 1.0) * (m + 1.0), c * (m + 2.0) * (m + 2.0)]
    top = F.greatest(*args)
    inner = weights[0] * F.exp(args[0] - top) + weights[1] * F.exp(args[1] - top) + weights[2] * F.exp(args[2] - top)
    return rows.withColumn("rdp", F.when(inner > 0, (top + F.ln(inner)) / (a - 1.0))
                           .otherwise(F.lit(float("inf")))).drop("_m")


def rdp_spaced_poisson(geo: DataFrame, candidates: str, affected: str, batch: int, lam: str, sigma: float,
                       low: int = 2, high: int = 63) -> DataFrame:
    """Bound of the Poisson-spaced sampler per (row, lambda, order).

    floor(K/lambda) intervals of ``zeta`` candidates, each active with probability ``xi``; the block covers ``m``
    intervals completely and two partly, whose hit counts 0/1/2 have weights w0, w1, w2.
    """
    lam_c, w = F.col(lam), F.col(affected).cast("double")
    count = F.greatest(F.lit(1), F.floor(F.lit(float(batch)) / lam_c)).cast("double")
    prepared = geo.withColumn("intervals", count.cast("bigint")).withColumn(
        "zeta", F.greatest(F.floor(F.col(candidates) / count), F.lit(1)).cast("double")).withColumn(
        "xi", F.lit(float(batch)) / count)
    a = F.col("alpha").cast("double")
    c = a * (a - 1.0) / F.lit(2.0 * sigma * sigma)
    z, xi = F.col("zeta"), F.col("xi")
    rows = with_orders(prepared, low, high).withColumn("_m", full_blocks(w, z, c)).withColumn("_c", c)
    m = F.col("_m")
    rest = w - m * z
    small, large = F.floor(rest / 2.0) / z, F.ceil(rest / 2.0) / z
    miss_s, miss_l = 1.0 - small, 1.0 - large
    off = 1.0 - xi
    w0 = off * off + off * xi * (miss_s + miss_l) + xi * xi * (miss_s * miss_l)
    w1 = off * xi * (small + large) + xi * xi * (miss_s * large + miss_l * small)
    w2 = xi * xi * (small * large)
    cc = F.col("_c")

    def log_or_null(x: Column) -> Column:
        return F.when(x > 0, F.ln(x))

    rows = rows.withColumns({"_l0": log_or_null(w0), "_l1": log_or_null(w1), "_l2": log_or_null(w2)})

    def three(k: Column) -> Column:
        # Missing terms (zero weight) are null and skipped; the maximum is taken over the present ones only.
        xs = [F.col(f"_l{i}") + cc * (k + float(i)) * (k + float(i)) for i in range(3)]
        top = F.greatest(*xs)
        return top + F.ln(sum((F.coalesce(F.exp(x - top), F.lit(0.0)) for x in xs[1:]),
                              F.coalesce(F.exp(xs[0] - top), F.lit(0.0))))

    def term(k: Column, lnc: Column) -> Column:
        # With every interval active the published bound adds the terms without binomial weights.
        mixed = lnc + (m - k) * F.ln(1.0 - xi) + k * F.ln(xi)
        return three(k) + F.when(xi == 1.0, F.lit(0.0)).otherwise(mixed)

    log_base = log_sum_exp_over(m, term, m)
    return (rows.withColumn("log_base", log_base).withColumn("rdp", F.col("log_base") / (a - 1.0))
            .drop("_m", "_c", "_l0", "_l1", "_l2"))


def collapse(rdp: DataFrame, keys: Sequence[str], delta: float) -> DataFrame:
    """Pack the orders of each key: ``orders`` = array of (rdp, conversion). At most 63 entries per key."""
    return rdp.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("rdp"), conversion(F.col("alpha"), delta).alias("conv"))).alias("orders"))


def epsilon_at(orders: Column, steps: Column) -> Column:
    """Epsilon after a number of steps; 0 for no step."""
    values = F.transform(orders, lambda o: steps * o["rdp"] + o["conv"])
    return F.when(steps == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.array_min(values)))


def max_steps(df: DataFrame, orders: str, target: Column, cap: Column | int) -> DataFrame:
    """Largest number of steps within ``target``: closed form, then one step of correction for rounding.

    Adds ``steps``, ``epsilon``, ``next_epsilon`` and ``exhausted`` (the next step would exceed the target).
    """
    cap_c = (cap if isinstance(cap, Column) else F.lit(cap)).cast("bigint")
    free = F.array_max(F.transform(orders, lambda o: F.when(
        o["rdp"] > 0, (target - o["conv"]) / o["rdp"]).when(target >= o["conv"], F.lit(9e15)).otherwise(F.lit(0.0))))
    guess = F.least(cap_c, F.floor(F.greatest(F.lit(0.0), F.least(free, F.lit(9e15)))).cast("bigint"))
    o = F.col(orders)
    probe = df.withColumn("_t", guess)
    t = F.col("_t")
    exact = (F.when((t < cap_c) & (epsilon_at(o, t + 1) <= target), t + 1)
             .when(epsilon_at(o, t) <= target, t).otherwise(t - 1))
    out = probe.withColumn("steps", F.greatest(F.lit(0), exact).cast("bigint")).drop("_t")
    s = F.col("steps")
    out = out.withColumn("epsilon", epsilon_at(o, s)).withColumn("next_epsilon", epsilon_at(o, s + 1))
    return out.withColumn("exhausted", F.col("next_epsilon") > target)


def search_grid(geo: DataFrame, candidates: str, batch: int, step: float = 0.01, min_zeta: int = 7) -> DataFrame:
    """Rates tried by the lambda search: 1/t, +step, … below 1, with enough candidates and long enough intervals."""
    t = F.floor(F.col(candidates) / F.lit(batch))
    lower = F.lit(1.0) / t
    count = F.ceil((F.lit(1.0) - lower) / F.lit(step)).cast("int")
    grid = (geo.filter(t >= 2).withColumn("base_spacing", t.cast("bigint"))
            .withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
            .withColumn("lam", lower + F.col("_i") * F.lit(step)).drop("_i"))
    per = F.greatest(F.lit(1), F.floor(F.lit(float(batch)) / F.col("lam"))).cast("bigint")
    return grid.withColumn("intervals", per).filter(
        (F.col("intervals") <= F.col(candidates)) & (F.floor(F.col(candidates) / F.col("intervals")) >= min_zeta))


def merge_equal_rates(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates with the same number of intervals have the same bound: keep the largest and count them."""
    rest = [c for c in grid.columns if c not in (*keys, "intervals", "lam")]
    return grid.groupBy(*keys, "intervals").agg(
        F.max("lam").alias("lam"), F.count(F.lit(1)).alias("rates"), *[F.first(c).alias(c) for c in rest])


def select_lambda(geo: DataFrame, keys: Sequence[str], candidates: str, affected: str, batch: int, sigma: float,
                  delta: float, epsilon: float, step: float = 0.01, epochs: int = 100, min_zeta: int = 7) -> DataFrame:
    """Rate that allows most steps within ``epsilon`` (at most ``epochs`` epochs); the larger rate wins ties.

    Without a feasible rate the result is 1/t with 0 steps."""
    grid = merge_equal_rates(search_grid(geo, candidates, batch, step, min_zeta), keys)
    rdp = rdp_spaced_poisson(grid, candidates, affected, batch, "lam", sigma, 2, 64)
    packed = collapse(rdp, [*keys, "base_spacing", "lam", "rates"], delta)
    scored = max_steps(packed, "orders", F.lit(float(epsilon)), F.col("base_spacing") * epochs)
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("lam", "steps"), F.struct("steps", "lam")).alias("_b"),
                                     F.sum("rates").alias("evaluated"))
    lower = F.lit(1.0) / F.floor(F.col(candidates) / F.lit(batch))
    feasible = F.coalesce(F.col("_b.steps"), F.lit(0)) > 0
    return join_null_safe(geo, best, keys, "left").select(
        *geo.columns, F.when(feasible, F.col("_b.lam")).otherwise(lower).alias("lam"),
        F.coalesce(F.col("_b.steps"), F.lit(0)).cast("bigint").alias("max_steps"),
        F.coalesce("evaluated", F.lit(0)).cast("bigint").alias("evaluated"), feasible.alias("feasible"))


def select_lambda_fixed_steps(geo: DataFrame, keys: Sequence[str], candidates: str, affected: str, batch: int,
                              sigma: float, delta: float, steps: int, step: float = 0.01, min_zeta: int = 7) -> DataFrame:
    """Rate with the least epsilon at a fixed number of steps; the larger rate wins ties."""
    grid = merge_equal_rates(search_grid(geo, candidates, batch, step, min_zeta), keys)
    rdp = rdp_spaced_poisson(grid, candidates, affected, batch, "lam", sigma, 2, 63)
    loss = rdp.groupBy(*keys, "lam").agg(F.min(F.lit(float(steps)) * F.col("rdp") + conversion(F.col("alpha"), delta))
                                         .alias("loss"))
    return loss.groupBy(*keys).agg(F.min_by("lam", F.struct(F.col("loss"), -F.col("lam"))).alias("lam"),
                                   F.min("loss").alias("epsilon"))


def budget_plan(geo: DataFrame, keys: Sequence[str], batch: int, sigma: float, delta: float,
                targets: Sequence[float], cap: int, lam_step: float, mode: str = "forecasting") -> DataFrame:
    """Steps within each target budget for Poisson and Poisson-spaced sampling, one row per (key, method, target).

    ``geo`` has ``candidates`` and ``affected``. The spaced sampler takes, per target, the rate with most steps (the
    larger rate on ties). A plan that reaches the cap before its budget has ``exhausted = false``; callers refuse it.
    """
    budget = F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    cand, aff = F.col("candidates"), F.col("affected")
    poisson_in = geo.withColumn("_q", F.lit(float(batch)) / cand)
    poisson = collapse(rdp_poisson(poisson_in, "_q", "affected", sigma, 2, 64, distance=2), keys, delta)
    poisson = max_steps(poisson.withColumn("target", budget), "orders", F.col("target"), cap).select(
        *keys, F.lit("poisson").alias("method"), "target", F.lit(None).cast("double").alias("lam"), "steps", "epsilon",
        "next_epsilon", "exhausted")

    lower = F.lit(1.0) / F.floor(cand / F.lit(batch))
    n_grid = F.floor((F.lit(1.0) - lower) / F.lit(lam_step)).cast("int")
    rates = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), n_grid), lambda i: F.least(
        F.lit(1.0), lower + i * F.lit(lam_step))), F.array(F.lit(1.0))))
    ratio = F.lit(float(batch)) / F.col("lam")
    count = (F.ceil(ratio) if mode == "forecasting" else F.floor(ratio)).cast("bigint")
    activation = F.col("lam") if mode == "forecasting" else F.lit(float(batch)) / F.col("_count")
    tried = (geo.withColumn("lam", F.explode(rates)).withColumn("_count", count)
             .filter((F.col("_count") >= batch) & (F.col("_count") <= cand)))
    # Patterns depend on the interval count only: merge the rates that share one.
    shapes = tried.select(*keys, "candidates", "affected", "_count").distinct()
    patterns = affected_patterns(shapes, [*keys, "_count"], "candidates", "affected", F.col("_count"),
                                 larger_last=(mode == "paper"))
    rated = join_null_safe(patterns, tried.select(*keys, "_count", "lam"), [*keys, "_count"])
    spaced_rdp = rdp_pss(rated, [*keys, "lam"], activation, sigma, 2, 64)
    spaced = collapse(spaced_rdp, [*keys, "lam"], delta)
    scored = max_steps(spaced.withColumn("target", budget), "orders", F.col("target"), cap)
    best = scored.groupBy(*keys, "target").agg(F.max_by(
        F.struct("lam", "steps", "epsilon", "next_epsilon", "exhausted"), F.struct("steps", "lam")).alias("b"))
    spaced_plan = best.select(*keys, F.lit("pss").alias("method"), "target", "b.*")
    return poisson.unionByName(spaced_plan)


def binomial_weights(df: DataFrame, hit: Column, trials: int) -> DataFrame:
    """Binomial(K, r) weight of each number of affected draws j = 0..K, with the two means -2j and 2j."""
    log_c = F.array(*[F.lit(math.lgamma(trials + 1) - math.lgamma(j + 1) - math.lgamma(trials - j + 1))
                      for j in range(trials + 1)])
    rows = df.withColumn("hit_probability", hit).select("*", F.posexplode(log_c).alias("hits", "_lc"))
    r, j = F.col("hit_probability"), F.col("hits")
    weight = F.when(r >= 1.0, (j == trials).cast("double")).otherwise(
        F.exp(F.col("_lc") + j * F.ln(r) + (trials - j) * F.ln(1.0 - r)))
    return (rows.withColumn("weight", weight).withColumn("mean_p", (-2 * j).cast("double"))
            .withColumn("mean_q", (2 * j).cast("double")).drop("_lc"))


def memoised(tenants: DataFrame, geometry: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a ledger once per distinct geometry and give every tenant its rows."""
    return join_null_safe(tenants, compute(tenants.select(*geometry).distinct()), geometry)


