"""Decomposition and simple forecasters."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoveil.operators.checks import is_bad_number
from chronoveil.operators.position import BLOCK_ROWS, block_of, framed, running_sum, series_stats


def moving_trends(df: DataFrame, keys: Sequence[str], pos: str, col: str, kernels: Sequence[int],
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred moving averages with both ends padded by repeating the edge value; one ``trend_<k>`` per kernel.

    The padding is arithmetic (missing rows times the edge value), so no padded rows are made.
    """
    ends = series_stats(df, keys, pos, {"_n": F.count(F.lit(1)), "_a": F.min_by(col, pos), "_z": F.max_by(col, pos)}, block_rows)
    half = max(kernels) // 2
    exprs = {f"_s{k}": (lambda w, h=k // 2: F.sum(col).over(w.rowsBetween(-h, h))) for k in kernels}
    out = framed(ends, keys, pos, half, half, exprs, block_rows)
    p = F.col(pos)
    for k in kernels:
        h = k // 2
        left = F.greatest(F.lit(0), F.lit(h) - p)
        right = F.greatest(F.lit(0), p + h - (F.col("_n") - 1))
        out = out.withColumn(f"trend_{k}", (F.col(f"_s{k}") + left * F.col("_a") + right * F.col("_z")) / F.lit(float(k)))
    return out.drop("_n", "_a", "_z", *[f"_s{k}" for k in kernels])


def decompose(df: DataFrame, keys: Sequence[str], pos: str, col: str, kernel: int = 25,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trend and seasonal residual."""
    out = moving_trends(df, keys, pos, col, [kernel], block_rows)
    return (out.withColumn("seasonal", F.col(col) - F.col(f"trend_{kernel}"))
            .withColumnRenamed(f"trend_{kernel}", "trend"))


def naive(df: DataFrame, keys: Sequence[str], pos: str, col: str, horizon: int) -> DataFrame:
    """Last value of each series repeated ``horizon`` times."""
    last = df.groupBy(*keys).agg(F.max(pos).alias("_p"), F.max_by(col, pos).alias("forecast"))
    return (last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .select(*keys, (F.col("_p") + F.col("h")).alias("pos"), "h", "forecast"))


def window_mean(df: DataFrame, keys: Sequence[str], pos: str, col: str, length: int,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One-step forecast of every row as the mean of the ``length`` rows before it (uniform linear weights)."""
    out = framed(df, keys, pos, length, 0, {
        "forecast": lambda w: F.avg(col).over(w.rowsBetween(-length, -1)),
        "_c": lambda w: F.count(col).over(w.rowsBetween(-length, -1))}, block_rows)
    return out.filter(F.col("_c") == length).drop("_c")


def pairs(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], context: int, horizon: int,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(target, naive prediction) of every unit-stride window in long form: rows (keys, start, h, channel)."""
    exprs = {f"_{c}_{h}": (lambda w, c=c, h=h: F.lead(c, h).over(w)) for c in cols for h in range(1, horizon + 1)}
    wide = framed(df.select(*keys, pos, *cols), keys, pos, 0, horizon, exprs, block_rows)
    full = wide.filter((F.col(pos) >= context - 1) & F.col(f"_{cols[0]}_{horizon}").isNotNull())
    items = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(c).alias("channel"), F.col(f"_{c}_{h}").alias("true"),
                               F.col(c).alias("pred")) for c in cols for h in range(1, horizon + 1)])
    return full.select(*keys, (F.col(pos) - (context - 1)).alias("start_pos"), F.inline(items))


def lag_table(df: DataFrame, keys: Sequence[str], pos: str, col: str, lags: int, horizon: int,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every window of a series: the ``lags`` values up to ``pos`` (``x``, oldest first) and the ``horizon`` behind it (``y``).

    Windows that are cut off by an end of the series, or have a null, are left out.
    """
    values = {"_w": lambda w: F.collect_list(col).over(w.rowsBetween(1 - lags, horizon))}
    out = framed(df.select(*keys, pos, F.col(col).cast("double").alias(col)), keys, pos, lags - 1, horizon, values, block_rows)
    return out.filter(F.size("_w") == lags + horizon).select(
        *keys, pos, F.slice("_w", 1, lags).alias("x"), F.slice("_w", lags + 1, horizon).alias("y"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of at most ``width`` numbers as rows, filled up with zeros, and their lengths."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out, sizes


def _moments(rows: DataFrame, partial, width: int) -> dict[str, np.ndarray]:
    """Sums over all tasks of the matrices (kind, i, values) that ``partial`` makes of each task's batches."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for kind, part in partial(batch).items():
                total[kind] = total[kind] + part if kind in total else part
        for kind, part in total.items():
            part = np.atleast_2d(part)
            yield pa.RecordBatch.from_arrays([
                pa.array([kind] * len(part)), pa.array(np.arange(len(part), dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))],
                ["kind", "i", "v"])

    sums = rows.mapInArrow(run, "kind string, i int, v array<double>").select("kind", "i", F.posexplode("v").alias("d", "v"))
    out = {}
    for r in sums.groupBy("kind", "i", "d").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.kind, np.zeros((2 * width + 1, width)))[r.i, r.d] = r.v
    return out


def _window_moments(df: DataFrame, keys: Sequence[str], pos: str, col: str, width: int, centre: float,
                    block_rows: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, sums and products of all windows of ``width`` values: (n, sum of value a, sum of values a and b).

    Windows overlap, so the product of two places depends on their distance but for the ends of a series: it is the sum over the
    whole series of products at that distance, less those that begin before place a or end behind place b. A row costs ``width``
    products instead of their square.
    """
    later = {"_w": lambda w: F.collect_list(F.col(col) - F.lit(centre)).over(w.rowsBetween(0, width - 1))}
    rows = framed(df.select(*keys, pos, F.col(col).cast("double").alias(col)), keys, pos, 0, width - 1, later, block_rows)

    def partial(batch):
        at = batch["at"].to_numpy()
        w, sizes = _matrix(batch["w"], width)
        whole = (sizes == width) | (at + sizes >= width)  # rows of series that have a window
        at, w, sizes = at[whole], w[whole], sizes[whole]
        products = w * w[:, :1]
        head, tail, ends = np.zeros((width, width)), np.zeros((width, width)), np.zeros((3, width))
        early = at < width
        np.add.at(head, at[early], products[early])
        np.add.at(ends[1], at[early], w[early, 0])
        for size in range(1, width):  # rows with ``size`` values left: the pair at distance d ends size - 1 - d before the end
            last = sizes == size
            if last.any():
                tail[size - 1 - np.arange(size), np.arange(size)] += products[last, :size].sum(axis=0)
                ends[2, size - 1] += w[last, 0].sum()
        ends[0, 0] = w[:, 0].sum()
        return {"all": products.sum(axis=0), "head": head, "tail": tail, "ends": ends, "n": np.full((1, width), float((sizes == width).sum()))}

    found = _moments(rows.select(F.col(pos).cast("bigint").alias("at"), F.col("_w").alias("w")), partial, width)
    if "n" not in found or not found["n"][0, 0]:
        raise ValueError("no series has as many rows as the lags and the horizon")
    zeros = np.zeros((1, width))
    before = np.vstack([zeros, np.cumsum(found["head"][:width], axis=0)])
    behind = np.vstack([zeros, np.cumsum(found["tail"][:width], axis=0)])
    products = np.zeros((width, width))
    for a in range(width):
        for b in range(a, width):
            products[a, b] = products[b, a] = found["all"][0, b - a] - before[a, b - a] - behind[width - 1 - b, b - a]
    early, late = np.cumsum(np.append(0, found["ends"][1])), np.cumsum(np.append(0, found["ends"][2]))
    sums = found["ends"][0, 0] - early[:width] - late[width - 1 - np.arange(width)]
    return float(found["n"][0, 0]), sums, products


def _chosen_moments(windows: DataFrame, width: int, centre: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The same of any choice of windows (``x``, ``y``): products are summed window by window."""
    def partial(batch):
        w, _ = _matrix(batch["w"], width)
        w = w - centre
        return {"all": w.T @ w, "ends": w.sum(axis=0), "n": np.full((1, width), float(len(w)))}

    found = _moments(windows.select(F.concat("x", "y").alias("w")), partial, width)
    if "n" not in found or not found["n"][0, 0]:
        raise ValueError("no window to fit")
    return float(found["n"][0, 0]), found["ends"][0], found["all"][:width]


def smoothing(length: int, kernel: int) -> np.ndarray:
    """Matrix of the centred moving average of a window whose ends repeat its edge values."""
    out = np.zeros((length, length))
    for i in range(length):
        for j in range(i - (kernel - 1) // 2, i + kernel // 2 + 1):
            out[i, min(max(j, 0), length - 1)] += 1.0 / kernel
    return out


def _line(weights: np.ndarray, base: np.ndarray, x: Column) -> Column:
    """``base`` and ``weights`` times the array ``x``: one literal, one row of it for each result."""
    table = F.from_json(F.lit(json.dumps(np.column_stack([base, weights]).tolist())), "array<array<double>>")
    terms = F.concat(F.array(F.lit(1.0)), x)
    return F.transform(table, lambda row: F.aggregate(F.zip_with(row, terms, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def linear_forecast(df: DataFrame, keys: Sequence[str], pos: str, col: str, lags: int, horizon: int,
                    train: Column | None = None, kernel: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One least-squares map from the lags to every horizon, fitted over the windows where ``train`` holds (all by default);
    ``x``, ``y`` and ``f1..fP`` for all windows. ``train`` may use the keys, ``pos``, ``x`` and ``y`` of a window.

    With ``kernel`` each window is split into its moving average (ends repeated) and the rest, and each part has a map of its
    own; ``seasonal1..P`` and ``trend1..P`` (with the constant) are what they add to the forecast. Both parts are linear in the lags, so
    of all pairs of maps with the least error the smallest is taken: it follows from the undivided fit.

    Values that are null or not finite are an error. One job finds the centre, one the sums of products, of which about
    2 (L+P)^2 numbers reach the driver.
    """
    width = lags + horizon
    checked = df.select(*keys, pos, F.col(col).cast("double").alias(col))
    centre, bad = checked.agg(F.avg(col), F.count_if(is_bad_number(F.col(col)))).first()
    if bad:
        raise ValueError(f"{bad} values are null or not finite")
    table = lag_table(checked, keys, pos, col, lags, horizon, block_rows)
    centre = float(centre or 0.0)
    if train is None:
        n, sums, products = _window_moments(checked, keys, pos, col, width, centre, block_rows)
    else:
        n, sums, products = _chosen_moments(table.filter(train), width, centre)
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    weights = np.linalg.lstsq(cov[:lags, :lags], cov[:lags, lags:], rcond=None)[0].T
    mean = mean + centre
    base = mean[lags:] - weights @ mean[:lags]
    names = {"f": (weights, base)}
    if kernel is not None:
        smooth = smoothing(lags, kernel)
        rest = np.eye(lags) - smooth
        shared = weights @ np.linalg.inv(rest.T @ rest + smooth.T @ smooth)
        seasonal, trend = shared @ rest.T @ rest, shared @ smooth.T @ smooth
        names |= {"seasonal": (seasonal, -seasonal @ mean[:lags]), "trend": (trend, mean[lags:] - trend @ mean[:lags])}
    parts = table.withColumns({f"_{name}": _line(w, b, F.col("x")) for name, (w, b) in names.items()})
    return parts.withColumns({f"{name}{h + 1}": F.get(f"_{name}", F.lit(h)) for name in names for h in range(horizon)}).drop(
        *[f"_{name}" for name in names])


def boosted_forecast(df: DataFrame, keys: Sequence[str], pos: str, col: str, horizon: int, rounds: int = 5, rate: float = 0.5,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gradient-boosted splits of each series on its time index; forecasts of the ``horizon`` positions behind it.

    A round finds the split of the residual with the largest reduction of squared error from prefix sums (the earliest of
    those equal to six digits), and moves both sides by ``rate`` of their mean. A series of one row keeps its mean.
    """
    sized = series_stats(df.select(*keys, pos, F.col(col).cast("double").alias("_y")), keys, pos,
                         {"_n": F.count(F.lit(1)), "_f": F.avg("_y")}, block_rows)
    now = sized.withColumn("_r", F.col("_y") - F.col("_f")).drop("_y")
    block = block_of(df, keys, pos, block_rows)
    for _ in range(rounds):
        total = series_stats(running_sum(now, keys, [pos], block, {"_s": F.col("_r")}), keys, pos, {"_t": F.sum("_r")}, block_rows)
        left, right = F.col(pos) + 1, F.col("_n") - F.col(pos) - 1
        s, rest = F.col("_s"), F.col("_t") - F.col("_s")
        gain = F.round(s * s / left + rest * rest / F.when(right > 0, right), 6)
        order = F.struct(gain.alias("gain"), (-F.col(pos)).alias("early"))
        split = F.struct(F.col(pos).alias("cut"), (s / left).alias("low"), (rest / F.when(right > 0, right)).alias("high"))
        found = series_stats(total, keys, pos, {"_b": F.max_by(F.when(right > 0, split), F.when(right > 0, order))}, block_rows)
        move = F.when(F.col(pos) <= F.col("_b.cut"), F.col("_b.low")).otherwise(F.col("_b.high"))
        now = (found.withColumn("_r", F.col("_r") - F.coalesce(F.lit(rate) * move, F.lit(0.0)))
               .withColumn("_f", F.col("_f") + F.coalesce(F.lit(rate) * F.col("_b.high"), F.lit(0.0))).drop("_s", "_t", "_b"))
    ends = now.groupBy(*keys).agg(F.any_value("_n").alias("_n"), F.any_value("_f").alias("forecast"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))
    return ends.withColumn("_h", steps).select(*keys, (F.col("_n") + F.col("_h")).alias(pos), "forecast")


def periodic_rows(windows: DataFrame, keys: Sequence[str], x: str, length: int, period: int) -> DataFrame:
    """Fold each window by its period: subtract the window mean, add a zero-padded moving average of width
    1 + 2*(period // 2), and emit (phase, segment, value)."""
    half = period // 2
    width = float(1 + 2 * half)
    xs = F.col(x)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.lit(float(length))
    centred = windows.select(*keys, mean.alias("_m"), F.transform(xs, lambda v: v - mean).alias("_c"))
    pad = F.array_repeat(F.lit(0.0), half)
    padded = centred.withColumn("_p", F.concat(pad, F.col("_c"), pad))

    def smooth(v: Column, i: Column) -> Column:
        near = F.slice("_p", i + 1, F.lit(int(width)))
        return v + F.aggregate(near, F.lit(0.0), lambda a, y: a + y) / F.lit(width)

    rows = padded.select(*keys, F.col("_m").alias("mean"), F.posexplode(F.transform("_c", smooth)).alias("_i", "value"))
    return rows.select(*keys, "mean", (F.col("_i") % period).alias("phase"),
                       F.floor(F.col("_i") / period).cast("int").alias("segment"), "value")


def autocorrelation(windows: DataFrame, keys: Sequence[str], x: str, length: int) -> DataFrame:
    """Circular autocorrelation of each window by lag (what an inverse FFT of the power spectrum gives)."""
    xs = F.col(x)
    index = F.sequence(F.lit(0), F.lit(length - 1))
    twice = F.concat(xs, xs)

    def at(lag: Column) -> Column:
        return F.aggregate(F.zip_with(xs, F.slice(twice, lag + 1, F.lit(length)), lambda a, b: a * b), F.lit(0.0),
                           lambda acc, v: acc + v)

    return windows.select(*keys, F.posexplode(F.transform(index, at)).alias("lag", "corr"))


def top_lags(corr: DataFrame, keys: Sequence[str], length: int, factor: float = 1.0, digits: int = 6) -> DataFrame:
    """int(factor * ln L) lags of highest mean autocorrelation per key; equal values prefer the smaller lag.

    A key has ``length`` rows after the average, so the ranking window is small.
    """
    mean = corr.groupBy(*keys, "lag").agg(F.round(F.avg("corr"), digits).alias("corr"))
    ranked = mean.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("corr"), "lag")))
    return ranked.filter(F.col("rank") <= int(factor * math.log(length)))
