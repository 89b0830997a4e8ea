"""Pointwise and windowed anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.clean import group_stats
from chronoveil.operators.position import (BLOCK_ROWS, framed, group_bound, join_sized, merge_stages, previous,
                                           series_stats, trailing_sum)
from chronoveil.operators.windows import window_rows


def _mean(cols: Sequence[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def _squared(c: Column) -> Column:
    return c * c


def _fit_on(train: Column | None, value: Column | str) -> Column:
    """The values that a fit may see: those of the training rows, or all."""
    c = F.col(value) if isinstance(value, str) else value
    return c if train is None else F.when(train, c)


def mean_scores(df: DataFrame, keys: Sequence[str], cols: Sequence[str], train: Column | None = None) -> DataFrame:
    """Squared distance to the per-channel mean of each key, averaged over channels. The mean is that of the rows where
    ``train`` holds, and all rows are scored."""
    fitted = group_stats(df, keys, {f"_m_{c}": F.avg(_fit_on(train, c)) for c in cols})
    score = _mean([_squared(F.col(c) - F.col(f"_m_{c}")) for c in cols])
    return fitted.withColumn("score", score).drop(*[f"_m_{c}" for c in cols])


def ar1_scores(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
               block_rows: int = BLOCK_ROWS, train: Column | None = None) -> DataFrame:
    """Squared error of x_t = slope*x_{t-1} + intercept, with one slope and intercept for all channels of a key.

    The first row of a series has previous value 0. The fit is one pass of sums (``regr_*``) over the rows where ``train``
    holds (all by default)."""
    lagged = previous(df, keys, pos, {f"_p_{c}": c for c in cols}, block_rows=block_rows)
    ready = lagged.withColumns({f"_p_{c}": F.coalesce(f"_p_{c}", F.lit(0.0)) for c in cols})
    both = F.array(*[F.struct(F.col(f"_p_{c}").alias("x"), F.col(c).alias("y")) for c in cols])
    seen = ready if train is None else ready.filter(train)
    fit = (seen.select(*keys, F.inline(both)).groupBy(*keys)
           .agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")))
    scored = join_sized(ready, fit, keys, group_bound(df, keys))
    err = _mean([_squared(F.col(c) - F.col("slope") * F.col(f"_p_{c}") - F.col("intercept")) for c in cols])
    return scored.withColumn("score", err).drop(*[f"_p_{c}" for c in cols])


def rank_scores(df: DataFrame, col: str, rank: int, train: Column | None = None) -> DataFrame:
    """Squared error of the best rank-r linear reconstruction (principal components of the rows where ``train`` holds,
    fitted distributed); all rows are scored."""
    vectors = df.withColumn("_x", array_to_vector(F.col(col)))
    seen = df if train is None else df.filter(train)
    means = seen.select(F.posexplode(col).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    centre = means.agg(F.array_sort(F.collect_list(F.struct("d", "m")))).scalar()  # d entries
    model = PCA(k=rank, inputCol="_x", outputCol="_z").fit(vectors if train is None else vectors.filter(train))
    basis = model.pc.toArray()  # d x r
    centred = vectors.withColumn("_ms", centre).withColumn(
        "_c", F.zip_with(F.col(col), F.transform("_ms", lambda s: s["m"]), lambda x, m: x - m))
    axes = [F.array(*[F.lit(float(v)) for v in basis[:, r]]) for r in range(rank)]

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)

    energy = dot(F.col("_c"), F.col("_c"))
    kept = None
    for axis in axes:
        part = _squared(dot(F.col("_c"), axis))
        kept = part if kept is None else kept + part
    # Orthonormal axes: residual energy is total minus projected energy.
    return centred.withColumn("score", (energy - kept) / F.size(col)).drop("_x", "_ms", "_c")


def windowed_scores(rows: DataFrame, keys: Sequence[str], pos: str, error: str) -> DataFrame:
    """Row score = mean over the windows that cover the row, from one error per (window, row)."""
    return rows.groupBy(*keys, pos).agg(F.avg(error).alias("score"), F.count(F.lit(1)).alias("windows"))


def window_mean_scores_exploded(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                                length: int) -> DataFrame:
    """Windowed scores of a model that reconstructs a window by its own channel means; L copies of every row."""
    rows = window_rows(df.select(*keys, pos, *cols), keys, pos, length, 1)
    fitted = group_stats(rows, [*keys, "win_id"], {f"_m_{c}": F.avg(c) for c in cols})
    err = _mean([_squared(F.col(c) - F.col(f"_m_{c}")) for c in cols])
    return windowed_scores(fitted.withColumn("_e", err), keys, pos, "_e")


def window_mean_scores(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], length: int,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same scores without copying rows: the mean of (x - m_w)^2 over covering windows is
    (x - E[m_w])^2 + Var[m_w].

    Window means and both moments are trailing sums of centred values, so the cost per row does not depend on the window
    length, one shuffle serves all stages, and a value only reaches the windows that hold it.
    """
    stats = {"_n": F.count(F.lit(1)), **{f"_mu_{c}": F.avg(c) for c in cols}}
    sized = series_stats(df.select(*keys, pos, *cols), keys, pos, stats, block_rows).filter(F.col("_n") >= length)
    centred = sized.withColumns({f"_x_{c}": F.col(c) - F.col(f"_mu_{c}") for c in cols})
    zero = F.lit(0.0)
    full = F.col(pos) + length <= F.col("_n")

    def mean_of(c: str):
        return lambda w: F.when(full, F.lead(f"_s_{c}", length - 1).over(w) / float(length))

    means = merge_stages(*[trailing_sum(f"_s_{c}", F.col(f"_x_{c}"), length, pos) for c in cols]) + [
        {f"_w_{c}": mean_of(c) for c in cols}]
    moments = merge_stages(
        trailing_sum("_k", full.cast("double"), length, pos),
        *[trailing_sum(f"_a_{c}", F.col(f"_w_{c}"), length, pos) for c in cols],
        *[trailing_sum(f"_b_{c}", _squared(F.col(f"_w_{c}")), length, pos) for c in cols])
    out = framed(centred, keys, pos, length, length - 1, [*means, *moments], block_rows)

    def score(c: str) -> Column:
        mean = F.col(f"_a_{c}") / F.col("_k")
        return _squared(F.col(f"_x_{c}") - mean) + F.greatest(zero, F.col(f"_b_{c}") / F.col("_k") - _squared(mean))

    return out.select(*keys, pos, _mean([score(c) for c in cols]).alias("score"), F.col("_k").cast("bigint").alias("windows"))
