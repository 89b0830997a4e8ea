"""Exact grouped quantiles without collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.position import join_null_safe, range_count, running_sum, split_index, value_splits


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    parts: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    ``percentile`` keeps every distinct value of a group in one buffer. Here equal values are counted map-side first,
    ranks come from a two-level prefix sum over value ranges (as many as the rows need), and only the two rows around each
    rank are kept.
    """
    parts = parts or range_count(df.count())
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    block = None
    if parts > 1:
        splits = value_splits(df.select(F.col(value).cast("double").alias(value)), value, parts)
        block = split_index(F.col("_v").cast("double"), splits)
    ranked = running_sum(counts, keys, ["_v"], block, {"_hi": F.col("_c")})
    if keys:
        joined = join_null_safe(ranked, counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys)
    else:
        joined = ranked.withColumn("_n", counts.agg(F.sum("_c")).scalar())
    aggs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        below = (F.col("_hi") > lo) & (F.col("_hi") - F.col("_c") <= lo)
        above = (F.col("_hi") > hi) & (F.col("_hi") - F.col("_c") <= hi)
        v_lo, v_hi = F.max(F.when(below, F.col("_v"))), F.max(F.when(above, F.col("_v")))
        frac = F.max(h - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).cast("double").alias(name))
    return joined.groupBy(*keys).agg(*aggs)
