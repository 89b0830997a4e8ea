"""Cutting series into windows.

Two plan shapes are used. At unit stride a rows frame collects each window next to its first row (one shuffle, one
array per row). At larger strides each row is exploded only into the windows that contain it (L/stride copies) and
regrouped by (series, window), so nothing is collected for starts that the stride would drop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoveil.operators.clean import group_stats
from chronoveil.operators.position import (BLOCK_ROWS, block_of, carry, framed, join_null_safe, running_sum, series_stats,
                                            range_count, split_index, spread_sequence, value_splits)


def unit_windows(df: DataFrame, keys: Sequence[str], pos: str, value: Column, context: int, horizon: int,
                 overlap: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All (x, y) pairs: x = [s, s+L), y = [s+L-overlap, s+L+P), one row per start."""
    total = context + horizon
    base = df.select(*keys, pos, value.alias("_v"))
    win = framed(base, keys, pos, 0, total - 1, {
        "_w": lambda w: F.collect_list("_v").over(w.rowsBetween(0, total - 1))}, block_rows)
    return (win.filter(F.size("_w") == total)
            .select(*keys, F.col(pos).alias("start_pos"), F.slice("_w", 1, context).alias("x"),
                    F.slice("_w", context - overlap + 1, horizon + overlap).alias("y")))


def window_rows(df: DataFrame, keys: Sequence[str], pos: str, length: int, stride: int) -> DataFrame:
    """One row per (window, member row): adds ``win_id`` (start = win_id*stride) and ``offset``.

    Windows that run past the end of the series are not emitted.
    """
    sized = series_stats(df, keys, pos, {"_n": F.count(F.lit(1))})
    p = F.col(pos)
    last_win = F.floor((F.col("_n") - length) / F.lit(stride))
    first = F.greatest(F.lit(0), F.ceil((p - (length - 1)) / F.lit(stride)))
    last = F.least(F.floor(p / F.lit(stride)), last_win)
    return (sized.withColumn("_f", first.cast("bigint")).withColumn("_t", last.cast("bigint"))
            .filter((F.col("_n") >= length) & (F.col("_f") <= F.col("_t")))
            .withColumn("win_id", F.explode(F.sequence("_f", "_t")))
            .withColumn("offset", (p - F.col("win_id") * stride).cast("int"))
            .drop("_n", "_f", "_t"))


def tumbling_rows(df: DataFrame, keys: Sequence[str], pos: str, length: int) -> DataFrame:
    """Non-overlapping windows without the incomplete tail; no row is copied."""
    sized = series_stats(df, keys, pos, {"_n": F.count(F.lit(1))})
    return (sized.withColumn("win_id", F.floor(F.col(pos) / F.lit(length)).cast("bigint"))
            .filter((F.col("win_id") + 1) * length <= F.col("_n"))
            .withColumn("offset", (F.col(pos) % length).cast("int")).drop("_n"))


def gather_arrays(rows: DataFrame, win_keys: Sequence[str], value: Column, out: str = "x") -> DataFrame:
    """Collect exploded window rows into one ordered array per window (bounded by the window length)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("offset"), value.alias("v"))))
    return rows.groupBy(*win_keys).agg(ordered["v"].alias(out))


def zero_padded_windows(df: DataFrame, keys: Sequence[str], pos: str, value: Column, context: int, horizon: int,
                        stride: int, channels: Sequence[str] = ()) -> DataFrame:
    """(x, y) pairs over a series with ``context`` zero rows in front; candidates = (n-P)//stride + 1.

    Start s covers original rows [s-L, s+P); rows before the series are zeros. Only existing rows are exploded; the
    padding is added as constants to the few windows that need it.
    """
    sized = series_stats(df.select(*keys, pos, value.alias("_v")), keys, pos, {"_n": F.count(F.lit(1))})
    p = F.col(pos)
    last_win = F.floor((F.col("_n") - horizon) / F.lit(stride))
    first = F.greatest(F.lit(0), F.ceil((p - (horizon - 1)) / F.lit(stride)))
    last = F.least(F.floor((p + context) / F.lit(stride)), last_win)
    rows = (sized.withColumn("_f", first.cast("bigint")).withColumn("_t", last.cast("bigint"))
            .filter((F.col("_n") >= horizon) & (F.col("_f") <= F.col("_t")))
            .withColumn("win_id", F.explode(F.sequence("_f", "_t")))
            .withColumn("offset", (p - F.col("win_id") * stride + context).cast("int")))
    arrays = gather_arrays(rows, [*keys, "win_id"], F.col("_v"), "_w")
    missing = F.lit(context + horizon) - F.size("_w")
    full = F.concat(F.array_repeat(F.lit(0.0), missing), F.col("_w"))
    return (arrays.withColumn("_full", full)
            .select(*keys, "win_id", (F.col("win_id") * stride).alias("start_pos"), missing.alias("padded"),
                    F.slice("_full", 1, context).alias("x"), F.slice("_full", context + 1, horizon).alias("y")))


def starts_in_intervals(bounds: DataFrame, start: str, stop: str, length: int, stride: int) -> DataFrame:
    """Window starts wholly inside each half-open interval; raises when an interval is shorter than a window."""
    short = F.col(stop) - F.col(start) < length
    count = F.when(short, F.raise_error(F.lit("an interval is shorter than one window"))).otherwise(
        F.floor((F.col(stop) - F.col(start) - length) / F.lit(stride)) + 1)
    spread = spread_sequence(bounds.withColumn("_count", count.cast("bigint")), [start], "_count", "_i")
    return spread.withColumn("start_pos", (F.col(start) + F.col("_i") * stride).cast("bigint")).drop("_count", "_i")


def label_runs(df: DataFrame, keys: Sequence[str], pos: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Maximal runs of equal labels: (keys, run_start, run_stop, label), half-open, from two boundary carries."""
    sized = series_stats(df.select(*keys, pos, label), keys, pos, {"_last": F.max(pos)}, block_rows)
    lagged = framed(sized, keys, pos, 1, 0, {"_prev": lambda w: F.lag(label).over(w)}, block_rows)
    heads = lagged.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(label))).drop("_prev")
    # Heads keep sparse positions, so the next head is a carry and not a fixed-distance frame.
    nxt = carry(heads, keys, pos, block_of(df, keys, pos, block_rows), {"_next": F.col(pos)}, forward=False, inclusive=False)
    return nxt.select(*keys, F.col(pos).alias("run_start"), F.coalesce(F.col("_next"), F.col("_last") + 1).alias("run_stop"),
                      label)


def windows_in_runs(runs: DataFrame, length: int) -> DataFrame:
    """Non-overlapping windows wholly inside same-label runs; the tail of a run is dropped."""
    counted = runs.withColumn("_count", F.floor((F.col("run_stop") - F.col("run_start")) / F.lit(length)))
    spread = spread_sequence(counted, ["run_start"], "_count", "_i")
    return spread.withColumn("start_pos", F.col("run_start") + F.col("_i") * length).drop("_count", "_i")


def gather(draws: DataFrame, df: DataFrame, keys: Sequence[str], pos: str, length: int) -> DataFrame:
    """Rows of chosen windows: each draw is exploded to its positions and equi-joined with the series."""
    need = draws.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(
        pos, (F.col("start_pos") + F.col("offset")).cast("bigint"))
    return join_null_safe(need, df, [*keys, pos])


def patches(x: Column, length: int, patch: int, step: int, repeat_last: bool = False) -> Column:
    """Array of patches of a window; ``repeat_last`` appends the last value ``step`` times first."""
    full = F.concat(x, F.array_repeat(F.element_at(x, -1), step)) if repeat_last else x
    total = length + (step if repeat_last else 0)
    return F.transform(F.sequence(F.lit(0), F.lit((total - patch) // step)),
                       lambda i: F.slice(full, i * step + 1, F.lit(patch)))


def strided_candidates(df: DataFrame, win: str, every: int, keys: Sequence[str]) -> DataFrame:
    """Every ``every``-th window as a candidate; series with fewer than two candidates are an error."""
    kept = df.filter(F.col(win) % every == 0)
    counted = group_stats(kept, keys, {"_c": F.count(F.lit(1))})
    ok = F.when(F.col("_c") < 2, F.raise_error(F.lit("need at least two candidate windows"))).otherwise(F.col("_c"))
    return counted.withColumn("candidates", ok).drop("_c")


def majority_label(rows: DataFrame, win_keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label of each window, the smallest on ties.

    Counted per (window, label) first; the winner is an aggregate, so no window is sorted.
    """
    counts = rows.groupBy(*win_keys, label).agg(F.count(F.lit(1)).alias("_c"))
    best = F.max_by(F.col(label), F.struct(F.col("_c"), -F.col(label)))
    return counts.groupBy(*win_keys).agg(best.alias("label"), F.max("_c").alias("votes"))


def dense_labels(df: DataFrame, label: str, out: str = "dense", parts: int | None = None) -> DataFrame:
    """Remap labels to 0..k-1 in sorted order, null first if there is one: rank of each distinct value by a prefix sum over as many value ranges as
    there are distinct values for."""
    distinct = df.select(label).distinct()
    parts = parts or range_count(distinct.count())
    block = split_index(F.col(label), value_splits(distinct, label, parts)) if parts > 1 else None
    ranked = running_sum(distinct, [], [label], block, {"_rank": F.lit(1)})
    return join_null_safe(df, ranked.select(label, (F.col("_rank") - 1).cast("int").alias(out)), [label])


def window_moments(rows: DataFrame, win_keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, population deviation and mean absolute first difference per window and channel.

    ``rows`` come from ``window_rows``/``tumbling_rows``; a window is at most L rows, so its sort stays small.
    """
    spec = Window.partitionBy(*win_keys).orderBy("offset")
    stepped = rows.select(*win_keys, *cols, *[
        F.abs(F.col(c) - F.lag(c).over(spec)).alias(f"_d_{c}") for c in cols])
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.avg(f"_d_{c}").alias(f"{c}_var1")]
    return stepped.groupBy(*win_keys).agg(*aggs)
