"""Window augmentations. A window is one array holding context and target."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoveil.functions.rng import uniform
from chronoveil.operators.position import join_null_safe, range_count, running_sum


def vertical_flip(x: Column) -> Column:
    return F.transform(x, lambda v: -v)


def horizontal_flip(x: Column) -> Column:
    return F.reverse(x)


def jitter(x: Column, ids: Sequence[Column], seed: int, upto: int | None = None, width: float = 0.1) -> Column:
    """Add (u - 0.5) * width to every value, or to the first ``upto`` values (the context) only."""
    def one(v: Column, i: Column) -> Column:
        noisy = v + (uniform(seed, "jitter", *ids, i) - 0.5) * width
        return noisy if upto is None else F.when(i < upto, noisy).otherwise(v)

    return F.transform(x, one)


def shuffled_partner(windows: DataFrame, ids: Sequence[str], seed: int, parts: int | None = None) -> DataFrame:
    """A random permutation of the windows: (ids, partner ids).

    Windows are ranked by a random key in ranges of the unit interval (a two-level prefix sum, no global sort); the
    window of rank r is paired with the window of rank r in a second random order. The ranges follow the number of windows.
    """
    parts = parts or range_count(windows.count())
    def ranked(role: str, prefix: str) -> DataFrame:
        tagged = windows.select(*[F.col(c).alias(f"{prefix}{c}") for c in ids],
                                uniform(seed, role, *[F.col(c) for c in ids]).alias("_u"))
        names = [f"{prefix}{c}" for c in ids]
        block = F.floor(F.col("_u") * parts).cast("bigint") if parts > 1 else None
        return running_sum(tagged, [], ["_u", *names], block, {"_rank": F.lit(1)}).drop("_u")

    return ranked("first", "").join(ranked("second", "other_"), "_rank").drop("_rank")


def mix_pairs(windows: DataFrame, ids: Sequence[str], x: str, seed: int, parts: int | None = None) -> DataFrame:
    """Average of each window and its random partner."""
    partner = shuffled_partner(windows, ids, seed, parts)
    other = windows.select(*[F.col(c).alias(f"other_{c}") for c in ids], F.col(x).alias("_o"))
    both = join_null_safe(join_null_safe(windows, partner, ids), other, [f"other_{c}" for c in ids])
    return both.withColumn(x, F.zip_with(x, "_o", lambda a, b: (a + b) / 2.0)).drop("_o")


def upsample_half(x: Column, length: int, start: Column) -> Column:
    """Linear doubling of the half segment from ``start`` (half-pixel centres, clamped at the edges)."""
    half = length // 2

    def one(i: Column) -> Column:
        at = F.greatest(F.lit(0.0), (i + 0.5) / 2.0 - 0.5)
        lo = F.floor(at).cast("int")
        hi = F.least(lo + 1, F.lit(half - 1))
        w = at - lo
        a, b = F.element_at(x, (start + lo + 1).cast("int")), F.element_at(x, (start + hi + 1).cast("int"))
        return a * (1.0 - w) + b * w

    return F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), one)


def random_start(ids: Sequence[Column], length: int, seed: int) -> Column:
    return F.floor(uniform(seed, "segment", *ids) * F.lit(length // 2)).cast("int")


def _bin_draws(ids: Sequence[Column], length: int, seed: int) -> Column:
    """One uniform per frequency bin, drawn in the plan so that a re-run task masks the same bins."""
    return F.transform(F.sequence(F.lit(0), F.lit(length // 2)), lambda i: uniform(seed, "bin", *ids, i))


def frequency_mask(windows: DataFrame, ids: Sequence[str], x: str, length: int, rate: float, seed: int) -> DataFrame:
    """Zero each rfft bin with probability ``rate`` and transform back."""
    drawn = windows.withColumn("_u", _bin_draws([F.col(c) for c in ids], length, seed))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def mask(xs: pd.Series, us: pd.Series) -> pd.Series:
        spectrum = np.fft.rfft(np.stack(xs.to_list()), axis=1)
        spectrum[np.stack(us.to_list()) < rate] = 0.0
        return pd.Series(list(np.fft.irfft(spectrum, n=length, axis=1)))

    return drawn.withColumn(x, mask(F.col(x), F.col("_u"))).drop("_u")


def frequency_mix(windows: DataFrame, ids: Sequence[str], x: str, length: int, rate: float, seed: int) -> DataFrame:
    """Replace random rfft bins by those of a random partner; bins whose entry in the descending amplitude order is
    at most 2 are never replaced."""
    partner = shuffled_partner(windows, ids, seed)
    other = windows.select(*[F.col(c).alias(f"other_{c}") for c in ids], F.col(x).alias("_o"))
    both = join_null_safe(join_null_safe(windows, partner, ids), other, [f"other_{c}" for c in ids])
    drawn = both.withColumn("_u", _bin_draws([F.col(c) for c in ids], length, seed))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def mix(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, os, us in batches:
            a = np.fft.rfft(np.stack(xs.to_list()), axis=1)
            b = np.fft.rfft(np.stack(os.to_list()), axis=1)
            order = np.argsort(-np.abs(a), axis=1, kind="stable")
            swap = (np.stack(us.to_list()) < rate) & (order > 2)
            yield pd.Series(list(np.fft.irfft(np.where(swap, b, a), n=length, axis=1)))

    return drawn.withColumn(x, mix(F.col(x), F.col("_o"), F.col("_u"))).drop("_u", "_o")
