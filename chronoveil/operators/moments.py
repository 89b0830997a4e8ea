"""Vector populations: sketches, covariances and sampler variance studies."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.functions import vectors as vec
from chronoveil.functions.rng import pick, uniform
from chronoveil.operators.mechanisms import clip_factor
from chronoveil.operators.clean import group_stats
from chronoveil.operators.position import join_null_safe, join_sized, spread_sequence
from chronoveil.operators.quantile import exact_quantiles
from chronoveil.operators.sampling import balanced_intervals, bernoulli_hits


def exploded(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("d", "x"))


def sketch_map(d: Column, name: Column, seed: Column | int, buckets: int) -> tuple[Column, Column]:
    """Bucket and sign of a coordinate, hashed from (seed, parameter name, coordinate)."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    bucket = F.floor(uniform("sketch", "bucket", s, name, d) * F.lit(buckets)).cast("int")
    sign = F.when(uniform("sketch", "sign", s, name, d) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    return bucket, sign


def count_sketch(df: DataFrame, keys: Sequence[str], col: str, dims: int, buckets: int, seeds: Sequence[int],
                 name: str = "v") -> DataFrame:
    """Signed count sketch of each vector per projection seed: rows (keys, seed, bucket, x).

    Bucket and sign depend on the coordinate only, so they are hashed once for ``dims`` coordinates and looked up in
    a table of dims*seeds rows (both fixed parameters) instead of once per vector.
    """
    spark = df.sparkSession
    coords = (spark.range(dims).select(F.col("id").cast("int").alias("d"))
              .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))))
    bucket, sign = sketch_map(F.col("d"), F.lit(name), F.col("seed"), buckets)
    table = coords.select("d", "seed", bucket.alias("bucket"), sign.alias("_sign"))
    rows = join_sized(exploded(df, keys, col), table, ["d"], dims * len(seeds))
    return rows.groupBy(*keys, "seed", "bucket").agg(F.sum(F.col("x") * F.col("_sign")).alias("x"))


def norm_summary(df: DataFrame, keys: Sequence[str], col: str, loss: str, bound: float) -> DataFrame:
    """Mean and population deviation of raw norms, clipped norms and losses."""
    n = vec.l2_norm(F.col(col))
    rows = df.select(*keys, n.alias("_n"), (n * clip_factor(n, bound)).alias("_c"), F.col(loss).alias("_l"))
    aggs = []
    for short, c in (("raw_norm", "_n"), ("clipped_norm", "_c"), ("loss", "_l")):
        aggs += [F.avg(c).alias(f"{short}_mean"), F.stddev_pop(c).alias(f"{short}_std")]
    return rows.groupBy(*keys).agg(*aggs)


def covariance(df: DataFrame, keys: Sequence[str], col: str, held_keys: int = 64) -> DataFrame:
    """Population covariance in long form (i <= j).

    Vectors are centred first (products of raw values would cancel). Each task then turns its Arrow batches into one
    d*d partial product per key, so the shuffle carries d(d+1)/2 rows per key and task however many vectors there
    are. Vectors with a value that is not finite fail the job.
    """
    checked = df.select(*keys, F.col(col).alias("_v"))
    means = exploded(checked, keys, "_v").groupBy(*keys, "d").agg(F.avg("x").alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("d", "m")))  # d entries
    if keys:
        with_mean = join_null_safe(checked, means.groupBy(*keys).agg(packed.alias("_ms")), keys)
    else:
        with_mean = checked.withColumn("_ms", means.agg(packed).scalar())
    centred = with_mean.select(
        *keys, F.zip_with("_v", F.transform("_ms", lambda s: s["m"]), lambda x, m: x - m).alias("c"))
    fields = {f.name: f.dataType.simpleString() for f in centred.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "i int", "j int", "s double", "n bigint"])

    def emit(grams: dict, kinds: list) -> Iterator[pa.RecordBatch]:
        for key, (gram, n) in grams.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(i), t) for k, t in zip(key, kinds)] + [
                    pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j]), pa.array(np.full(len(i), n))],
                [*keys, "i", "j", "s", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            places: dict = {}
            for at, key in enumerate(zip(*[batch[k].to_pylist() for k in keys]) if keys else [()] * batch.num_rows):
                places.setdefault(key, []).append(at)
            for key, rows in places.items():
                x = np.array(batch["c"].take(pa.array(rows)).to_pylist(), dtype=float)
                if not np.isfinite(x).all():
                    raise ValueError("vector with a value that is not finite")
                old, n = grams.get(key, (0.0, 0))
                grams[key] = (old + x.T @ x, n + len(x))
            if len(grams) > held_keys:
                yield from emit(grams, kinds)
                grams = {}
        yield from emit(grams, kinds)

    sums = centred.mapInArrow(partial, schema)
    return sums.groupBy(*keys, "i", "j").agg((F.sum("s") / F.sum("n")).alias("cov"))


def trace_frobenius(cov: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trace and Frobenius norm from the upper triangle."""
    weight = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return cov.groupBy(*keys).agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))).alias("trace"),
        F.sqrt(F.sum(weight * F.col("cov") * F.col("cov"))).alias("frobenius"))


def spectrum(cov: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest and smallest eigenvalue and effective rank per group. A group is one d*d matrix (d is at most a few
    hundred), whatever the number of vectors was."""
    fields = {f.name: f.dataType.simpleString() for f in cov.schema.fields}
    head = [f"{k} {fields[k]}" for k in keys]
    schema = ", ".join([*head, "trace double", "frobenius double", "spectral double", "minimum_eigenvalue double",
                        "effective_rank double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["j"].max()) + 1
        m = np.zeros((d, d))
        m[pdf["i"], pdf["j"]] = pdf["cov"]
        m[pdf["j"], pdf["i"]] = pdf["cov"]
        ev = np.linalg.eigvalsh(m)
        pos = np.clip(ev, 0.0, None)
        energy = float((pos ** 2).sum())
        trace = float(np.trace(m))
        row = [pdf[k].iloc[0] for k in keys]
        row += [trace, float(np.sqrt((ev ** 2).sum())), float(ev[-1]), float(ev[0]),
                trace * trace / energy if energy > 0 else 0.0]
        return pd.DataFrame([row], columns=[*keys, "trace", "frobenius", "spectral", "minimum_eigenvalue",
                                            "effective_rank"])

    return cov.groupBy(*keys).applyInPandas(solve, schema)


def trial_draws(vectors: DataFrame, index: str, total: str, method: str, batch: int, trials: int, seed: int,
                lam: float = 0.5, intervals: int | None = None) -> DataFrame:
    """Vectors selected in each trial: rows (trial, index).

    ``baseline`` keeps each vector with probability K/n; ``poisson`` takes one uniform member of each active spacing
    interval. Both use the hit generator, so the work is the number of selected vectors, not trials*n.
    """
    if method == "baseline":
        units = vectors.select(F.lit(0).alias("g"), F.col(index).alias("unit"),
                               F.least(F.lit(1.0), F.lit(float(batch)) / F.col(total)).alias("p"),
                               F.lit(trials).cast("bigint").alias("steps"))
        hits = bernoulli_hits(units, ["g"], "unit", "p", "steps", seed)
        return hits.select(F.col("step").alias("trial"), F.col("unit").alias(index))
    if method != "poisson":
        raise ValueError(f"unknown method {method!r}")
    spans = (balanced_intervals(vectors, intervals, index, total).groupBy("interval_id")
             .agg(F.min(index).alias("lo"), F.count(F.lit(1)).alias("size")))
    units = spans.select(F.lit(0).alias("g"), F.col("interval_id").alias("unit"), "lo", "size",
                         F.lit(float(lam)).alias("p"), F.lit(trials).cast("bigint").alias("steps"))
    hits = bernoulli_hits(units, ["g"], "unit", "p", "steps", seed)
    u = uniform(seed, "trial_member", F.col("unit"), F.col("step"))
    return hits.select(F.col("step").alias("trial"), pick(u, F.col("lo"), F.col("size")).alias(index))


def estimators(vectors: DataFrame, draws: DataFrame, index: str, col: str, batch: int) -> DataFrame:
    """Sum of the selected vectors / K per (trial, dimension). Trials without a selection have no rows: their
    estimator is 0 in every dimension."""
    rows = draws.join(vectors.select(index, col), index)
    return exploded(rows, ["trial"], col).groupBy("trial", "d").agg((F.sum("x") / F.lit(float(batch))).alias("x"))


def estimator_trace(est: DataFrame, trials: int) -> DataFrame:
    """Trace of the population covariance over all trials, empty trials included: E|x|^2 - |E x|^2."""
    per_dim = est.groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    t = F.lit(float(trials))
    return per_dim.agg(F.greatest(F.lit(0.0), F.sum(F.col("q") / t - (F.col("s") / t) * (F.col("s") / t))).alias("trace"))


def analytic_traces(vectors: DataFrame, index: str, total: str, col: str, batch: int, lam: float,
                    intervals: int) -> DataFrame:
    """Exact estimator traces of the baseline and the Poisson-spaced sampler, from group aggregates."""
    tagged = balanced_intervals(vectors, intervals, index, total).withColumn("_sq", vec.squared_norm(F.col(col)))
    base = tagged.agg(F.sum("_sq").alias("s"), F.max(total).alias("n"))
    q = F.lit(float(batch)) / F.col("n")
    baseline = base.select(F.lit("baseline").alias("method"),
                           (q * (1.0 - q) * F.col("s") / F.lit(float(batch * batch))).alias("trace"))
    sq = tagged.groupBy("interval_id").agg(F.avg("_sq").alias("msq"))
    mean_sq = (exploded(tagged, ["interval_id"], col).groupBy("interval_id", "d").agg(F.avg("x").alias("m"))
               .groupBy("interval_id").agg(F.sum(F.col("m") * F.col("m")).alias("mm")))
    per = sq.join(mean_sq, "interval_id")
    xi = F.lit(float(lam))
    poisson = per.agg(F.greatest(F.lit(0.0), F.sum(xi * F.col("msq") - xi * xi * F.col("mm"))
                                 / F.lit(float(batch * batch))).alias("trace"))
    return baseline.unionByName(poisson.select(F.lit("poisson").alias("method"), "trace"))


#: Levels of the tree of draws that lie inside a block of vectors: 2^10 of them.
_BLOCK_LEVELS = 10


@lru_cache(4096)
def _binomial_cdf(trials: int, left: int, size: int) -> tuple[int, np.ndarray]:
    """First value in sight and the distribution function of Binomial(trials, left / size) from there: twelve deviations around the mean."""
    p = left / size
    mean, spread = trials * p, 12 * math.sqrt(trials * p * (1 - p)) + 12
    k = np.arange(max(0, math.floor(mean - spread)), min(trials, math.ceil(mean + spread)) + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log((trials - k[:-1]) / k[1:]) + math.log(left / (size - left)))))
    weights = np.exp(logs - logs.max())
    return int(k[0]), np.cumsum(weights / weights.sum())[:-1]


def _split(draws: int, left: int, size: int, text: str) -> int:
    """How many of ``draws`` members of a range fall into its first ``left`` ones: one binomial draw from the hash of ``text``."""
    if not draws or left == size:
        return draws
    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0 ** 52
    first, cdf = _binomial_cdf(draws, left, size)
    return first + int(np.searchsorted(cdf, u, side="right"))


def _ranges(name: str, total: int, at: int, level: int, draws: int, stop: int) -> Iterator[tuple[int, int]]:
    """(beginning, draws) of every range of 2^stop members below the range of 2^level members at ``at``."""
    ranges = [(at, level, draws)]
    while ranges:
        at, level, draws = ranges.pop()
        if level <= stop:
            yield at, draws
            continue
        half = 1 << (level - 1)
        left = _split(draws, min(half, total - at), min(2 * half, total - at), f"{name}|{at}|{level}")
        ranges.append((at, level - 1, left))
        if at + half < total:
            ranges.append((at + half, level - 1, draws - left))


def bootstrap_traces(vectors: DataFrame, index: str, total: str, col: str, repetitions: int, seed: int,
                     role: str = "boot", keys: Sequence[str] = ()) -> DataFrame:
    """Covariance trace of each bootstrap resample: rows (keys, rep, trace).

    A resample draws n of n members with replacement: the counts are multinomial. They are drawn down a tree of index ranges,
    where each range splits its draws between its halves by one binomial draw. A repetition is split down to blocks of 1024 members in
    one task (n / 1024 numbers); the rest of the tree is drawn next to the vectors of a block, whose products with the counts of all
    repetitions are summed in the task. Neither picks nor vectors are shuffled by repetition.
    """
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    head = "".join(f"{k} {fields[k]}, " for k in keys)
    sizes = vectors.groupBy(*keys).agg(F.max(total).cast("bigint").alias("_n"))
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).repartition(*keys, "rep")

    def name(key: tuple, rep: int) -> str:
        return "|".join(map(str, (seed, role, *key, rep)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, n, rep = tuple(batch[k][i].as_py() for k in keys), batch["_n"][i].as_py(), batch["rep"][i].as_py()
                found = list(_ranges(name(key, rep), n, 0, max(int(n - 1).bit_length(), _BLOCK_LEVELS), n, _BLOCK_LEVELS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(found), batch.schema.field(k).type) for k, v in zip(keys, key)] + [
                        pa.array([n] * len(found), pa.int64()), pa.array([rep] * len(found), pa.int32()),
                        pa.array([a >> _BLOCK_LEVELS for a, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())],
                    [*keys, "_n", "rep", "_block", "_t"])

    drawn = reps.mapInArrow(draw, f"{head}_n bigint, rep int, _block bigint, _t bigint")
    drawn = drawn.groupBy(*keys, "_n", "_block").agg(F.sort_array(F.collect_list(F.struct("rep", "_t"))).alias("_draws"))
    block = F.shiftright(F.col(index).cast("bigint"), _BLOCK_LEVELS).alias("_block")
    member = F.struct(F.col(index).cast("bigint").alias("at"), F.col(col).cast("array<double>").alias("x"))
    blocks = vectors.groupBy(*keys, block).agg(F.collect_list(member).alias("_members"))
    met = join_null_safe(blocks, drawn, [*keys, "_block"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for i in range(batch.num_rows):
                key, n, at = tuple(batch[k][i].as_py() for k in keys), batch["_n"][i].as_py(), batch["_block"][i].as_py() << _BLOCK_LEVELS
                members, ways = batch["_members"][i].as_py(), batch["_draws"][i].as_py()
                x = np.array([m["x"] for m in members])
                place = np.array([m["at"] - at for m in members])
                counts = np.zeros((len(ways), 1 << _BLOCK_LEVELS))
                for row, way in enumerate(ways):
                    for a, t in _ranges(name(key, way["rep"]), n, at, _BLOCK_LEVELS, way["_t"], 0):
                        counts[row, a - at] = t
                picked = counts[:, place]
                for way, s, q in zip(ways, picked @ x, picked @ (x * x)):
                    old = found.get((key, n, way["rep"]))
                    found[key, n, way["rep"]] = (s, q) if old is None else (old[0] + s, old[1] + q)
        for (key, n, rep), (s, q) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * len(s), t) for v, t in zip(key, kinds)] + [
                    pa.array([rep] * len(s), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(np.arange(len(s), dtype=np.int32)),
                    pa.array(s), pa.array(q)], [*keys, "rep", "_n", "d", "s", "q"])

    partial = met.mapInArrow(sums, f"{head}rep int, _n bigint, d int, s double, q double")
    per_dim = partial.groupBy(*keys, "rep", "_n", "d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = F.col("_n")
    return per_dim.groupBy(*keys, "rep").agg(F.greatest(F.lit(0.0), F.sum(
        F.col("q") / n - (F.col("s") / n) * (F.col("s") / n))).alias("trace"))


def interval_95(traces: DataFrame, keys: Sequence[str], value: str = "trace") -> DataFrame:
    """2.5 % and 97.5 % quantiles with linear interpolation."""
    return exact_quantiles(traces, keys, value, {"low": 0.025, "high": 0.975}, parts=1)


def compare_traces(baseline: DataFrame, method: DataFrame) -> DataFrame:
    """Confidence intervals of difference and ratio of paired bootstrap traces; ratios skip a zero baseline."""
    pairs = baseline.withColumnRenamed("trace", "b").join(method.withColumnRenamed("trace", "m"), "rep").select(
        (F.col("m") - F.col("b")).alias("difference"), F.when(F.col("b") > 0, F.col("m") / F.col("b")).alias("ratio"))
    low, high = (F.lit(0.025), F.lit(0.975))
    # One row per repetition, a fixed parameter of at most a few thousand.
    return pairs.agg(F.percentile("difference", low).alias("difference_low"),
                     F.percentile("difference", high).alias("difference_high"),
                     F.percentile("ratio", low).alias("ratio_low"), F.percentile("ratio", high).alias("ratio_high"),
                     F.avg((F.col("difference") < 0).cast("double")).alias("p_below"))


def against_baseline(df: DataFrame, keys: Sequence[str], method: str, value: str, baseline: str) -> DataFrame:
    """Ratio and reduction of each method against the baseline row of the same key (null for a zero baseline)."""
    joined = group_stats(df, keys, {"_b": F.max(F.when(F.col(method) == baseline, F.col(value)))})
    ratio = F.col(value) / F.when(F.col("_b") != 0, F.col("_b"))
    return joined.withColumn("ratio", ratio).withColumn("reduction", 1.0 - F.col("ratio")).drop("_b")


def seed_aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum over seeds; null when a seed has no value."""
    long = df.unpivot(list(keys), list(values), "metric", "value")
    ok = F.every(F.col("value").isNotNull())
    stats = {"mean": F.avg("value"), "std": F.stddev_pop("value"), "min": F.min("value"), "max": F.max("value")}
    return long.groupBy(*keys, "metric").agg(*[F.when(ok, e).alias(n) for n, e in stats.items()])


def seed_comparison(df: DataFrame, keys: Sequence[str], baseline: str, other: str, raw_reduction: Column) -> DataFrame:
    """How often the baseline is worse over seeds, and how projected reductions differ from the unprojected one."""
    worse = F.col(baseline) > F.col(other)
    bias = (1.0 - F.col(other) / F.col(baseline)) - raw_reduction
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if(worse).alias("worse"),
        F.avg(worse.cast("double")).alias("worse_fraction"), F.every(worse).alias("worse_always"),
        F.avg(bias).alias("bias_mean"), F.stddev_pop(bias).alias("bias_std"), F.count_if(bias > 0).alias("favourable"))
