"""Filling, resampling and normalising series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.position import BLOCK_ROWS, block_of, carry, explode_range, framed, group_bound, join_sized


def interpolate_index(df: DataFrame, keys: Sequence[str], pos: str, col: str, out: str | None = None,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation by row position; gaps at either end take the nearest value."""
    out = out or col
    known = F.when(F.col(col).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(col).alias("v")))
    blk = block_of(df, keys, pos, block_rows)
    both = carry(df, keys, pos, blk, {"_prev": known})
    both = carry(both, keys, pos, blk, {"_next": known}, forward=False)
    lo, hi, p = F.col("_prev"), F.col("_next"), F.col(pos)
    line = lo["v"] + (hi["v"] - lo["v"]) * (p - lo["p"]) / (hi["p"] - lo["p"])
    filled = (F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"])
              .when(hi["p"] == lo["p"], lo["v"]).otherwise(line))
    return both.withColumn(out, filled).drop("_prev", "_next")


def fill_forward_back(df: DataFrame, keys: Sequence[str], pos: str, col: str, out: str | None = None,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill, then backward fill of what is left at the start."""
    out = out or col
    blk = block_of(df, keys, pos, block_rows)
    both = carry(df, keys, pos, blk, {"_prev": F.col(col)})
    both = carry(both, keys, pos, blk, {"_next": F.col(col)}, forward=False)
    return both.withColumn(out, F.coalesce("_prev", "_next")).drop("_prev", "_next")


def resample_mean(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], step: int,
                  block_bins: int = BLOCK_ROWS) -> DataFrame:
    """Mean per bin of width ``step`` on a dense grid; an empty bin repeats the bin before it.

    Bins are pre-aggregated map-side. Instead of joining to a generated grid, every bin emits itself and the empty
    bins up to the next one, so no grid wider than a gap exists anywhere. The time range bounds the bins of a key: up
    to ``block_bins`` a plain window is used, beyond it blocks of that many bins.
    """
    low, high = df.agg(F.min(t), F.max(t)).first()
    few = low is None or (high - low) // step + 1 <= block_bins
    bins = (df.withColumn("bin", F.floor(F.col(t) / F.lit(step)).cast("bigint"))
            .groupBy(*keys, "bin").agg(*[F.avg(c).alias(c) for c in cols]))
    blk = None if few else F.floor(F.col("bin") / F.lit(block_bins)).cast("bigint")
    nxt = carry(bins, keys, "bin", blk, {"_next": F.col("bin")}, forward=False, inclusive=False)
    # A column that is null in a bin (all inputs missing) is filled like an empty bin.
    nxt = carry(nxt, keys, "bin", blk, {f"_f_{c}": F.col(c) for c in cols})
    end = F.coalesce(F.col("_next") - 1, F.col("bin"))
    return (explode_range(nxt, F.col("bin"), end, "_b")
            .select(*keys, F.col("_b").alias("bin"), (F.col("_b") * step).alias(t),
                    (F.col("_b") != F.col("bin")).alias("filled"),
                    *[F.col(f"_f_{c}").alias(c) for c in cols]))


def group_stats(df: DataFrame, keys: Sequence[str], exprs: dict[str, Column], groups: int | None = None) -> DataFrame:
    """Aggregate per key and attach the result to the rows, so that a hot key is combined map-side and never sorted.

    Without keys the aggregate is one row and becomes a scalar subquery instead of a join. ``groups`` is a known bound
    on the number of groups (by default the one measured with the positions); only then the statistics are broadcast.
    """
    if not keys:
        one = df.agg(F.struct(*[e.alias(n) for n, e in exprs.items()])).scalar()
        return df.withColumn("_stats", one).select(*df.columns, *[F.col("_stats")[n].alias(n) for n in exprs])
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in exprs.items()])
    return join_sized(df, stats, keys, group_bound(df, keys) if groups is None else groups)


def zscore(df: DataFrame, keys: Sequence[str], cols: Sequence[str], population: bool = True,
           zero_scale: float | None = None, missing: float | None = 0.0) -> DataFrame:
    """Add ``<col>_z``. ``zero_scale=None`` maps a constant column to 0; a number replaces its zero deviation."""
    sd = F.stddev_pop if population else F.stddev_samp
    exprs: dict[str, Column] = {}
    for c in cols:
        exprs[f"_m_{c}"] = F.avg(c)
        exprs[f"_s_{c}"] = sd(c)
    out = group_stats(df, keys, exprs)
    for c in cols:
        s = F.col(f"_s_{c}")
        centred = F.col(c) - F.col(f"_m_{c}")
        if zero_scale is None:
            z = F.when(s == 0, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise(centred / F.when(s != 0, s))
        else:
            z = centred / F.when(s == 0, F.lit(zero_scale)).otherwise(s)
        out = out.withColumn(f"{c}_z", z if missing is None else F.coalesce(z, F.lit(missing)))
    return out.drop(*exprs)


def minmax(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_mm`` in [0, 1]; constant columns and missing values give 0."""
    exprs: dict[str, Column] = {}
    for c in cols:
        exprs[f"_lo_{c}"] = F.min(c)
        exprs[f"_hi_{c}"] = F.max(c)
    out = group_stats(df, keys, exprs)
    for c in cols:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"{c}_mm", F.coalesce(
            (F.col(c) - F.col(f"_lo_{c}")) / F.when(span != 0, span), F.lit(0.0)))
    return out.drop(*exprs)


# Normalisations by name: suffix of the added columns and the operator.
NORMALISERS = {"zscore": ("_z", zscore), "minmax": ("_mm", minmax)}


def normalise(df: DataFrame, keys: Sequence[str], cols: Sequence[str], method: str) -> DataFrame:
    """Replace the columns by their normalised values, per key."""
    if method not in NORMALISERS:
        raise ValueError(f"unknown normalisation {method!r}; use one of {sorted(NORMALISERS)}")
    suffix, fn = NORMALISERS[method]
    out = fn(df, keys, cols)
    return out.select(*[F.col(f"{c}{suffix}").alias(c) if c in cols else F.col(c) for c in df.columns])


def long_channels(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide to long: one row per channel."""
    return df.unpivot(list(ids), list(cols), "channel", "value")


def norm_params(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum per key and channel."""
    return (long_channels(df, keys, cols).groupBy(*keys, "channel")
            .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                 F.min("value").alias("min"), F.max("value").alias("max")))


def fit_scale(df: DataFrame, keys: Sequence[str], cols: Sequence[str], train: Column) -> DataFrame:
    """Mean and population deviation (1 where it is zero) of the training rows, per key."""
    aggs = []
    for c in cols:
        kept = F.when(train, F.col(c))
        sd = F.stddev_pop(kept)
        aggs += [F.avg(kept).alias(f"mu_{c}"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"sd_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def apply_scale(df: DataFrame, params: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    out = join_sized(df, params, keys, group_bound(df, keys))
    return out.withColumns({f"{c}_s": (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}") for c in cols})


def invert_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Undo ``apply_scale``; adds ``<col>_back``."""
    return df.withColumns({f"{c}_back": F.col(f"{c}_s") * F.col(f"sd_{c}") + F.col(f"mu_{c}") for c in cols})


def gaussian_norm(df: DataFrame, keys: Sequence[str], col: str, eps: float = 1e-5) -> DataFrame:
    """Encode with (x - mean) / (sample deviation + eps) per key; adds ``enc`` and its inverse ``dec``."""
    out = group_stats(df, keys, {"_m": F.avg(col), "_s": F.stddev_samp(col)})
    scale = F.col("_s") + F.lit(eps)
    enc = (F.col(col) - F.col("_m")) / scale
    return out.withColumn("enc", enc).withColumn("dec", F.col("enc") * scale + F.col("_m")).drop("_m", "_s")


def range_norm(df: DataFrame, keys: Sequence[str], col: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Linear map of [min, max] to [low, high] per key; constant groups have no map (null)."""
    out = group_stats(df, keys, {"_lo": F.min(col), "_hi": F.max(col)})
    a = F.lit(high - low) / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return (out.withColumn("_a", a).withColumn("_b", F.lit(high) - F.col("_a") * F.col("_hi"))
            .withColumn("enc", F.col("_a") * F.col(col) + F.col("_b"))
            .withColumn("dec", (F.col("enc") - F.col("_b")) / F.col("_a"))
            .drop("_lo", "_hi", "_a", "_b"))


def instance_norm(df: DataFrame, window_keys: Sequence[str], pos: str, col: str, subtract_last: bool = False,
                  eps: float = 1e-5) -> DataFrame:
    """Reversible normalisation inside each window: centre by the mean or the last value, divide by
    sqrt(population variance + eps). Adds ``norm`` and ``denorm``."""
    centre = F.max_by(col, pos) if subtract_last else F.avg(col)
    out = group_stats(df, window_keys, {"_c": centre, "_sd": F.sqrt(F.var_pop(col) + F.lit(eps))})
    return (out.withColumn("norm", (F.col(col) - F.col("_c")) / F.col("_sd"))
            .withColumn("denorm", F.col("norm") * F.col("_sd") + F.col("_c")).drop("_c", "_sd"))


def regrid(df: DataFrame, keys: Sequence[str], pos: str, t: str, cols: Sequence[str], step: int, origin: str,
           low: str, high: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation in time on the grid ``origin + i*step`` inside [low, high].

    ``origin``/``low``/``high`` are columns of ``df``. Each pair of neighbouring samples emits the grid points that
    lie between them, which is the as-of join of grid and samples without building the grid or a union.
    """
    sample = F.struct(F.col(t).alias("t"), *[F.col(c).alias(c) for c in cols])
    nxt = framed(df.withColumn("_s", sample), keys, pos, 0, 1, {"_n": lambda w: F.lead("_s", 1).over(w)}, block_rows)
    o, s = F.col(origin), F.lit(step)
    first = F.ceil((F.greatest(F.col(t), F.col(low)) - o) / s)
    upto = F.least(F.coalesce(F.col("_n")["t"] - 1, F.col(t)), F.col(high))
    last = F.floor((upto - o) / s)
    pts = explode_range(nxt, first, last, "_i")
    g = o + F.col("_i") * s
    w = (g - F.col(t)) / (F.col("_n")["t"] - F.col(t))
    return pts.select(*[k for k in df.columns if k not in (pos, t, *cols)], g.alias("grid"), F.col(t).alias("t_prev"),
                      F.col("_n")["t"].alias("t_next"),
                      *[F.when(F.col("_n").isNull() | (g == F.col(t)), F.col(c))
                        .otherwise(F.col(c) + (F.col("_n")[c] - F.col(c)) * w).alias(c) for c in cols])
