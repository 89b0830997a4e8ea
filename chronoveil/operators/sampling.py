"""Batch selection under the privacy-amplifying samplers.

All steps (and seeds) of an epoch are drawn as one table. An epoch has n/K steps over n candidates, so testing every
(step, candidate) pair costs n*n/K; an epoch only has about n hits. ``bernoulli_hits`` draws the same distribution
with work proportional to the hits: steps are cut into chunks of about 1/p, the number of hits in a chunk is one
binomial draw by inverse CDF, and that many distinct steps are then chosen inside the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.functions.rng import pick, uniform
from chronoveil.operators.position import explode_range, join_null_safe, series_stats, spread_sequence

# A chunk has at most one expected hit; more than this many has probability below the resolution of a double.
MAX_HITS = 24


def batch_steps(candidates: Column, batch: int) -> Column:
    """Steps of one epoch."""
    return F.greatest(F.lit(1), F.ceil(candidates / F.lit(batch))).cast("bigint")


def binomial_count(u: Column, trials: Column, p: Column) -> Column:
    """Inverse-CDF binomial draw for trials*p <= 1.

    The uniform and the odds travel in the accumulator, so that they are computed once and not per term."""
    start = F.struct(F.pow(1.0 - p, trials.cast("double")).alias("pmf"), F.lit(0.0).alias("cdf"), F.lit(0).alias("hits"),
                     u.alias("u"), F.try_divide(p, 1.0 - p).alias("odds"))

    def step(acc: Column, k: Column) -> Column:
        cdf = acc["cdf"] + acc["pmf"]
        nxt = acc["pmf"] * (trials - k) / (k + 1) * acc["odds"]
        return F.struct(nxt.alias("pmf"), cdf.alias("cdf"), (acc["hits"] + (acc["u"] >= cdf).cast("int")).alias("hits"),
                        acc["u"].alias("u"), acc["odds"].alias("odds"))

    ks = F.sequence(F.lit(0), (F.least(trials, F.lit(MAX_HITS)) - 1).cast("int"))
    drawn = F.aggregate(ks, start, step, lambda acc: acc["hits"])
    return F.when(p >= 1.0, trials.cast("int")).otherwise(drawn)


def distinct_picks(hits: Column, size: Column, draw) -> Column:
    """``hits`` distinct integers in 1..size (Floyd's method); ``draw(j)`` is a uniform for index j."""
    def step(acc: Column, j: Column) -> Column:
        t = (F.floor(draw(j) * j) + 1).cast("bigint")
        return F.concat(acc, F.array(F.when(F.array_contains(acc, t), j).otherwise(t)))

    single = F.array((F.floor(draw(size) * size) + 1).cast("bigint"))  # the loop's result for one hit
    return F.when(hits == 0, F.array().cast("array<bigint>")).when(hits == 1, single).otherwise(F.aggregate(
        F.sequence((size - hits + 1).cast("bigint"), size.cast("bigint")), F.array().cast("array<bigint>"), step))


def bernoulli_hits(units: DataFrame, keys: Sequence[str], unit: str, p: str, steps: str, seed: int,
                   method: str = "md5", spread: bool = True) -> DataFrame:
    """Independent Bernoulli(p) selection of every unit at every step 0..steps-1; one row per hit, with ``step``.

    ``spread=False`` leaves the units in their tasks: right when a unit is hit a few times at most.
    """
    prob = F.col(p)
    chunk = F.when(prob >= 1.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(1.0 / prob))).cast("bigint")
    live = units.filter((prob > 0) & (F.col(steps) > 0)).withColumn("_size", chunk).withColumn(
        "_chunks", F.ceil(F.col(steps) / F.col("_size")).cast("bigint"))
    if spread:
        parts = spread_sequence(live, [*keys, unit], "_chunks", "_i")
    else:
        parts = explode_range(live, F.lit(0), F.col("_chunks") - 1, "_i")
    ids = [F.col(k) for k in [*keys, unit, "_i"]]
    size = F.least(F.col("_size"), F.col(steps) - F.col("_i") * F.col("_size"))
    counted = parts.withColumn("_c", size).withColumn(
        "_hits", binomial_count(uniform(seed, "count", *ids, method=method), F.col("_c"), prob))
    picks = distinct_picks(F.col("_hits"), F.col("_c"), lambda j: uniform(seed, "step", *ids, j, method=method))
    # No filter on the count: it would be pushed below and compute the draw twice. Empty arrays give no rows.
    return (counted.withColumn("_pick", F.explode(picks))
            .withColumn("step", (F.col("_i") * F.col("_size") + F.col("_pick") - 1).cast("bigint"))
            .drop("_size", "_chunks", "_i", "_c", "_hits", "_pick"))


def candidate_counts(df: DataFrame, keys: Sequence[str], length: int, stride: int, batch: int,
                     short: str = "error") -> DataFrame:
    """Per series: rows ``n``, candidates (n-L)//stride + 1 and steps per epoch; ``short`` as in ``count_candidates``."""
    return count_candidates(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), length, stride, batch, short)


def count_candidates(sized: DataFrame, length: int, stride: int, batch: int, short: str = "error") -> DataFrame:
    """Candidates and steps from ``n``. A series with fewer than K candidates is an error for samplers that need K
    different ones (``error``), drawn from all the same (``keep``; no window, no draw), or left out on purpose (``drop``)."""
    count = F.greatest(F.lit(0), F.floor((F.col("n") - length) / F.lit(stride)) + 1).cast("bigint")
    if short == "error":
        count = F.when(count < batch, F.raise_error(F.lit(f"a series has fewer than {batch} candidate windows"))).otherwise(count)
    elif short not in ("keep", "drop"):
        raise ValueError(f"unknown treatment of short series {short!r}")
    least = {"error": 0, "keep": 1, "drop": batch}[short]
    return (sized.withColumn("candidates", count).filter(F.col("candidates") >= least)
            .withColumn("steps", batch_steps(F.col("candidates"), batch)))


def candidates(df: DataFrame, keys: Sequence[str], pos: str, length: int, stride: int, batch: int,
               short: str = "error") -> DataFrame:
    """Window starts 0, stride, 2*stride, …, as a filter of the series rows (no sequence is generated)."""
    sized = series_stats(df.select(*keys, pos), keys, pos, {"n": F.count(F.lit(1))})
    starts = sized.filter(F.col(pos) % stride == 0).select(
        *keys, (F.col(pos) / stride).cast("bigint").alias("cand_id"), F.col(pos).alias("start_pos"), "n")
    return count_candidates(starts, length, stride, batch, short).filter(F.col("cand_id") < F.col("candidates"))


def poisson(df: DataFrame, keys: Sequence[str], pos: str, length: int, stride: int, batch: int, seed: int,
            method: str = "md5", short: str = "keep") -> DataFrame:
    """Each candidate enters each batch with probability min(1, K/candidates). Empty batches have no rows.

    A candidate is hit about once per epoch, so its hits are generated next to it and nothing is shuffled."""
    cand = candidates(df, keys, pos, length, stride, batch, short).withColumn(
        "_p", F.least(F.lit(1.0), F.lit(float(batch)) / F.col("candidates")))
    return bernoulli_hits(cand, keys, "cand_id", "_p", "steps", seed, method, spread=False).select(
        *keys, "step", "cand_id", "start_pos")


def interval_layout(sized: DataFrame, keys: Sequence[str], count: Column, activation: Column,
                    larger_last: bool = False, empty: str = "error") -> DataFrame:
    """Spacing intervals of the candidate range: (interval_id, lo, size, activation).

    The first (or last) ``candidates mod count`` intervals are one longer. ``empty`` says what happens when there are
    more intervals than candidates: ``error`` or ``skip``.
    """
    n = F.col("candidates")
    k = count.cast("bigint")
    if empty == "error":
        k = F.when(k > n, F.raise_error(F.lit("more spacing intervals than candidate windows"))).otherwise(k)
    spread = spread_sequence(sized.withColumn("intervals", k), keys, "intervals", "interval_id")
    i, base = F.col("interval_id"), F.floor(n / F.col("intervals"))
    rem = n - base * F.col("intervals")
    if larger_last:
        longer = F.greatest(F.lit(0), i - (F.col("intervals") - rem))
        size = base + (i >= F.col("intervals") - rem).cast("int")
    else:
        longer = F.least(i, rem)
        size = base + (i < rem).cast("int")
    laid = (spread.withColumn("lo", (i * base + longer).cast("bigint")).withColumn("size", size.cast("bigint"))
            .withColumn("activation", activation.cast("double")))
    return laid.filter(F.col("size") > 0)


def interval_count(batch: int, lam: float, rounding: str) -> int:
    ratio = batch / lam
    return math.ceil(ratio) if rounding == "ceil" else math.floor(ratio)


def spaced(df: DataFrame, keys: Sequence[str], length: int, stride: int, batch: int, lam: float, seed: int,
           rounding: str = "ceil", empty: str = "error", method: str = "md5", short: str = "error") -> DataFrame:
    """Poisson-spaced batches: each interval is active with probability lambda and gives one uniform member.

    ``lam=1`` is the fixed-size spaced sampler: every interval gives exactly one window at every step.
    """
    sized = candidate_counts(df, keys, length, stride, batch, short)
    layout = interval_layout(sized, keys, F.lit(interval_count(batch, lam, rounding)), F.lit(min(1.0, lam)), empty=empty)
    return draw_members(layout, keys, stride, seed, method)


def draw_members(layout: DataFrame, keys: Sequence[str], stride: int, seed: int, method: str = "md5") -> DataFrame:
    hits = bernoulli_hits(layout, keys, "interval_id", "activation", "steps", seed, method)
    u = uniform(seed, "member", *[F.col(k) for k in keys], F.col("interval_id"), F.col("step"), method=method)
    return (hits.withColumn("cand_id", pick(u, F.col("lo"), F.col("size")))
            .select(*keys, "step", "interval_id", "cand_id", (F.col("cand_id") * stride).alias("start_pos")))


def pss_partition(sized: DataFrame, keys: Sequence[str], batch: int, lam: float, mode: str = "forecasting") -> DataFrame:
    """Spacing partition with its activation. ``forecasting``: ceil(K/lambda) intervals, activation lambda, larger
    intervals first. ``paper``: floor(K/lambda) intervals, activation K/count, larger intervals last."""
    if mode == "forecasting":
        count, activation, last = interval_count(batch, lam, "ceil"), lam, False
    elif mode == "paper":
        count = interval_count(batch, lam, "floor")
        activation, last = batch / count, True
    else:
        raise ValueError(f"unknown partition mode {mode!r}")
    if count < batch:
        raise ValueError("a partition needs at least K intervals")
    return interval_layout(sized, keys, F.lit(count), F.lit(activation), larger_last=last)


def structured_wr(df: DataFrame, keys: Sequence[str], length: int, stride: int, batch: int, seed: int,
                  steps: Column | None = None, method: str = "md5") -> DataFrame:
    """K uniform candidates with replacement at every step, from any series with a window; long epochs are generated by
    many tasks."""
    sized = candidate_counts(df, keys, length, stride, batch, "keep")
    total = (steps if steps is not None else F.col("steps")) * batch
    slots = spread_sequence(sized.withColumn("_draws", total), keys, "_draws", "_d")
    step = F.floor(F.col("_d") / F.lit(batch)).cast("bigint")
    u = uniform(seed, "slot", *[F.col(k) for k in keys], F.col("_d"), method=method)
    return (slots.withColumn("cand_id", pick(u, F.lit(0), F.col("candidates")))
            .select(*keys, step.alias("step"), (F.col("_d") % batch).alias("slot"), "cand_id",
                    (F.col("cand_id") * stride).alias("start_pos")))


def balanced_intervals(cand: DataFrame, intervals: int, index: str, total: str) -> DataFrame:
    """Interval of each candidate in a split into ``intervals`` parts whose first parts are one longer.

    Computed from the index, so nothing is ranked or sorted."""
    n, i = F.col(total), F.col(index)
    base = F.floor(n / intervals)
    rem = n - base * intervals
    head = rem * (base + 1)
    inside = F.when(i < head, F.floor(i / (base + 1))).otherwise(rem + F.floor(F.try_divide(i - head, base)))
    return cand.withColumn("interval_id", inside.cast("bigint"))


def lambda_grid(df: DataFrame, candidates_col: str, batch: int, step: float) -> DataFrame:
    """Rates 1/(M//K), +step, … up to 1 (always included), per row."""
    lower = F.lit(1.0) / F.floor(F.col(candidates_col) / F.lit(batch))
    count = F.floor((F.lit(1.0) - lower) / F.lit(step)).cast("int")
    values = F.transform(F.sequence(F.lit(0), count), lambda i: F.least(F.lit(1.0), lower + i * F.lit(step)))
    return df.withColumn("lam", F.explode(F.array_distinct(F.concat(values, F.array(F.lit(1.0))))))


def geometry(df: DataFrame, keys: Sequence[str], length: int, stride: int, fraction: float,
             event_rounding: str = "ceil", horizon: int = 0, short: str = "keep", batch: int = 1) -> DataFrame:
    """Per series: candidates, event length and windows an event can touch. A series with fewer than ``batch`` candidates is kept, or
    left out on purpose (``short="drop"``): the samplers draw nothing from it, so it has no ledger."""
    if short not in ("keep", "drop"):
        raise ValueError(f"unknown treatment of short series {short!r}")
    scaled = F.lit(float(fraction)) * F.col("n")
    event = F.greatest(F.lit(1), F.ceil(scaled)) if event_rounding == "ceil" else F.floor(scaled)
    span = length + horizon
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("candidates", F.greatest(
                F.lit(0), F.floor((F.col("n") - span) / F.lit(stride)) + 1).cast("bigint"))
            .filter(F.col("candidates") >= (batch if short == "drop" else 0))
            .withColumn("event_length", event.cast("bigint"))
            .withColumn("affected", F.least(
                F.col("candidates"),
                F.floor((F.col("event_length") + span - 2) / F.lit(stride)) + 1).cast("bigint")))


def pooled_geometry(geo: DataFrame, length: int, stride: int, fraction: float) -> DataFrame:
    """Geometry of all sequences pooled: candidates add up, an event touches one sequence only."""
    pooled = geo.agg(F.sum("n").alias("n"), F.sum("candidates").alias("candidates"), F.max("candidates").alias("_most"))
    event = F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * F.col("n"))).cast("bigint")
    return (pooled.withColumn("event_length", event)
            .withColumn("affected", F.least(
                F.col("_most"), F.floor((F.col("event_length") + length - 2) / F.lit(stride)) + 1).cast("bigint"))
            .drop("_most"))


# Samplers by method name; each maps (series, keys, length, stride, batch, seed) to rows (keys, step, cand_id, start_pos).
SAMPLERS = {
    "poisson": lambda df, keys, length, stride, batch, seed, **kw: poisson(df, keys, kw.get("pos", "pos"), length, stride, batch, seed),
    "pss": lambda df, keys, length, stride, batch, seed, **kw: draw_members(
        pss_partition(candidate_counts(df, keys, length, stride, batch), keys, batch, kw["lam"], kw.get("mode", "forecasting")),
        keys, stride, seed),
    "structured": lambda df, keys, length, stride, batch, seed, **kw: structured_wr(df, keys, length, stride, batch, seed),
}


def draw(method: str, df: DataFrame, keys: Sequence[str], length: int, stride: int, batch: int, seed: int, **options) -> DataFrame:
    """Batches of one epoch by the named sampler."""
    if method not in SAMPLERS:
        raise ValueError(f"unknown sampling method {method!r}; use one of {sorted(SAMPLERS)}")
    rows = SAMPLERS[method](df, keys, length, stride, batch, seed, **options)
    return rows.select(*keys, "step", "cand_id", "start_pos")


def batch_stats(draws: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum batch size; batches without rows count as size 0.

    Empty batches are accounted for from the number of steps instead of joining a table of all steps."""
    sizes = draws.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("_c"))
    agg = sizes.groupBy(*keys).agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"),
                                   F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.count(F.lit(1)).alias("_k"))
    out = join_null_safe(steps, agg, keys, "left")
    s = F.col("steps")
    total, squares = F.coalesce("_s", F.lit(0)), F.coalesce("_q", F.lit(0))
    mean = total / s
    return out.select(
        *steps.columns, mean.alias("size_mean"),
        F.sqrt(F.greatest(F.lit(0.0), squares / s - mean * mean)).alias("size_std"),
        F.when(F.coalesce("_k", F.lit(0)) < s, F.lit(0)).otherwise(F.col("_lo")).cast("bigint").alias("size_min"),
        F.coalesce("_hi", F.lit(0)).cast("bigint").alias("size_max"))
