"""Differential-privacy mechanisms."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoveil.functions import vectors as vec
from chronoveil.functions.rng import gaussian, laplace, uniform
from chronoveil.operators.clean import group_stats
from chronoveil.operators.position import (BLOCK_ROWS, framed, merge_stages, previous, trailing_scratch,
                                           trailing_sum)


def clip_factor(norm: Column, bound: float, eps: float = 1e-12) -> Column:
    return F.least(F.lit(1.0), F.lit(float(bound)) / (norm + F.lit(eps)))


def clip_l2(df: DataFrame, col: str, bound: float, eps: float = 1e-12) -> DataFrame:
    """Scale vectors to norm at most ``bound``; adds ``norm``, ``factor`` and ``clipped``."""
    return (df.withColumn("norm", vec.l2_norm(F.col(col)))
            .withColumn("factor", clip_factor(F.col("norm"), bound, eps))
            .withColumn("clipped", vec.scale(F.col(col), F.col("factor"))))


def private_vector_mean(df: DataFrame, keys: Sequence[str], col: str, bound: float, sigma: float, batch: float,
                        seed: int, noise_scale: float = 1.0) -> DataFrame:
    """(sum of clipped vectors + N(0, (noise_scale*sigma*C)^2)) / K per key and dimension.

    K is the nominal batch size. ``noise_scale`` is 1 for ledgers that count a replacement as distance 2 and 2 for the
    ledgers that count it as distance 1; mechanism and ledger must be of the same family. The sums are combined
    map-side, so a group of any size costs one row per dimension and task in the shuffle.
    """
    clipped = clip_l2(df, col, bound)
    dims = clipped.select(*keys, F.posexplode("clipped").alias("d", "x"))
    sums = dims.groupBy(*keys, "d").agg(F.sum("x").alias("_s"))
    ids = [*[F.col(k) for k in keys], F.col("d")]
    noise = gaussian(uniform(seed, "noise1", *ids), uniform(seed, "noise2", *ids)) * F.lit(noise_scale * sigma * bound)
    return sums.select(*keys, "d", (F.col("_s") / F.lit(float(batch))).alias("mean"),
                       ((F.col("_s") + noise) / F.lit(float(batch))).alias("private_mean"))


def clip_stats(df: DataFrame, keys: Sequence[str], col: str, loss: str, bound: float) -> DataFrame:
    """Clipped fraction, mean norm before and after clipping, mean loss."""
    c = clip_l2(df, col, bound)
    return c.groupBy(*keys).agg(
        F.avg((F.col("norm") > bound).cast("double")).alias("clipped_fraction"), F.avg("norm").alias("norm_mean"),
        F.avg(F.col("norm") * F.col("factor")).alias("clipped_norm_mean"), F.avg(loss).alias("loss_mean"))


def laplace_release(df: DataFrame, ids: Sequence[str], cols: Sequence[str], sensitivity: float, epsilon: float,
                    seed: int) -> DataFrame:
    """Add Laplace(sensitivity/epsilon) noise to each coordinate; adds ``<col>_noisy``."""
    keys = [F.col(i) for i in ids]
    return df.withColumns({f"{c}_noisy": F.col(c) + laplace(uniform(seed, "laplace", c, *keys), sensitivity / epsilon)
                           for c in cols})


def stream_sensitivity(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Widest channel range and largest step between neighbouring rows, per stream.

    Publishing these leaks; they are for offline study or for choosing public bounds.
    """
    lagged = previous(df.select(*keys, pos, *cols), keys, pos, {f"_p_{c}": c for c in cols}, block_rows=block_rows)
    return lagged.groupBy(*keys).agg(
        _greatest([F.max(c) - F.min(c) for c in cols]).alias("s_p"),
        _greatest([F.max(F.abs(F.col(c) - F.col(f"_p_{c}"))) for c in cols]).alias("s_s"))


def _greatest(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def stream_dissimilarity(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], window: int,
                         windows_back: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean absolute and mean squared change between neighbouring rows, and the variance proxy over recent pairs.

    The proxy of row i uses the last window*windows_back - 1 pairs, never the first pair of the stream, and only
    pairs that changed.
    """
    lagged = previous(df, keys, pos, {f"_p_{c}": c for c in cols}, block_rows=block_rows)
    diffs = [F.col(c) - F.col(f"_p_{c}") for c in cols]
    dim = float(len(cols))
    steps = lagged.withColumn("dis", _sum([F.abs(d) for d in diffs]) / dim).withColumn(
        "sq", _sum([d * d for d in diffs]) / dim)
    used = (F.col(pos) >= 2) & (F.col("sq") > 0)
    pairs = window * windows_back - 1
    sums = {"_c": F.lit(1.0), "_q": F.col("sq"), "_a": F.col("dis")}
    stages = merge_stages(*[trailing_sum(n, F.when(used, v), pairs, pos) for n, v in sums.items()])
    out = framed(steps, keys, pos, pairs, 0, stages, block_rows).drop(*trailing_scratch(*sums))
    mean_abs = F.col("_a") / F.col("_c")
    return (out.withColumn("proxy", F.when(F.col("_c") > 0.5, F.col("_q") / F.col("_c") - mean_abs * mean_abs)
                           .otherwise(F.lit(0.0)))
            .drop("_c", "_q", "_a", *[f"_p_{c}" for c in cols]))


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def optimal_c(proxy: Column, eps_p: float, s_p: Column | float, window: int, theta: float = 0.5) -> Column:
    """Number of publications a window should hold, from the variance proxy."""
    slack = (1.0 - 2.0 * theta) * window
    s = s_p if isinstance(s_p, Column) else F.lit(float(s_p))
    root = F.sqrt(F.lit(slack * slack) + F.lit(3.0 * theta * theta * eps_p * eps_p) * proxy / (s * s))
    return F.greatest(F.floor((root - slack) / (6.0 * theta)), F.lit(1)).cast("bigint")


def budget_window_ledger(df: DataFrame, keys: Sequence[str], pos: str, eps_used: str, eps_p: float, window: int,
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Budget left for each row from the window-1 rows before it, and the first of them that spent budget."""
    back = window - 1
    spends = F.when(F.col(eps_used) > 0, F.col(pos))
    stages = merge_stages(
        trailing_sum("_sum", F.col(eps_used), window, pos),
        # First spending row at or after each position, read where the window starts.
        [{"_at": ("desc", lambda w: F.min(spends).over(w.rowsBetween(Window.unboundedPreceding, 0)))},
         {"_first": lambda w: F.lag("_at", back).over(w), "_top": lambda w: F.first("_at").over(
             w.rowsBetween(Window.unboundedPreceding, 0))}])
    out = framed(df, keys, pos, window, 0, stages, block_rows)
    candidate = F.coalesce("_first", F.when(F.col(pos) < back, F.col("_top")))
    return (out.withColumn("eps_remain", F.lit(float(eps_p)) - (F.col("_sum") - F.col(eps_used)))
            .withColumn("first_sampled", F.when(candidate < F.col(pos), candidate).otherwise(F.col(pos)))
            .drop("_sum", *trailing_scratch("_sum"), "_at", "_first", "_top"))


class StreamPublisher:
    """State of one private stream: publishes rows under a w-event budget, one call per row.

    Memory is bounded by the window: the last W spends and the last W*k published changes.
    """

    def __init__(self, epsilon: float, s_p: float, s_s: float, window: int, windows_back: int, dim: int, warm_rows: int | None = None):
        self.eps_p, self.eps_s = 0.75 * epsilon, 0.25 * epsilon
        self.eps_threshold = self.eps_query = self.eps_s / 2.0
        self.s_p, self.s_s, self.window, self.dim = s_p, s_s, window, dim
        self.warm_rows = window if warm_rows is None else warm_rows
        # Warm-up releases share the budget exactly: one every ``interval`` rows.
        self.interval = min(20, window)
        self.warm_eps = self.eps_p / -(-window // self.interval)
        self.history = window * windows_back - 1
        # Rows that spent budget within the last window - 1 rows: (row, release budget, comparison budget). The sums
        # over a window are kept up to date and summed anew once per window, so a row costs the same at any window.
        self.spent: deque[tuple[int, float, float]] = deque()
        self.sum_eps = self.sum_svt = 0.0
        self.changes: deque[tuple[float, float]] = deque()
        self.moved, self.sum_squares, self.sum_sizes = 0, 0.0, 0.0
        self.i, self.c, self.rho = 0, 1, 0.0
        self.last_raw: np.ndarray | None = None
        self.out: np.ndarray | None = None

    def publish(self, row: np.ndarray, noise: np.ndarray, u_query: float, u_threshold: float) -> tuple[float, float]:
        """Publish ``row``; ``noise`` is unit Laplace per channel, the others unit Laplace scalars. Returns the budgets
        booked: that of the release (what its noise spends, but for a share of comparison budget that is booked as such)
        and that of comparisons."""
        spent = tested = 0.0
        if self.i < self.warm_rows:
            if self.i % self.interval == 0:
                spent = self.warm_eps
                fresh = row + noise * (self.s_p / spent)
            else:
                fresh = self.out
        else:
            if self.i == self.warm_rows:
                self.rho = u_threshold * self.s_s / self.eps_threshold
            fresh, spent, tested = self._decide(row, noise, u_query)
        if self.out is not None and self.i >= 2:
            d = fresh - self.out
            self._note_change(float(d @ d) / self.dim, float(np.abs(d).sum()) / self.dim)
        self.out, self.last_raw = fresh, row
        self._book(spent, tested)
        self.i += 1
        if self.i >= self.warm_rows:
            self.c = self._target_count()
        return spent, tested

    def _book(self, spent: float, tested: float) -> None:
        if spent > 0 or tested > 0:
            self.spent.append((self.i, spent, tested))
            self.sum_eps += spent
            self.sum_svt += tested
        # The next row looks back over window - 1 rows, this one included.
        while self.spent and self.spent[0][0] <= self.i + 1 - self.window:
            _, eps, svt = self.spent.popleft()
            self.sum_eps -= eps
            self.sum_svt -= svt
        if self.i % self.window == 0:
            self.sum_eps, self.sum_svt = (math.fsum(x[k] for x in self.spent) for k in (1, 2))

    def _note_change(self, square: float, size: float) -> None:
        self.changes.append((square, size))
        old = self.changes.popleft() if len(self.changes) > self.history else (0.0, 0.0)
        for (sq, ab), sign in (((square, size), 1), (old, -1)):
            if sq > 0:
                self.moved += sign
                self.sum_squares += sign * sq
                self.sum_sizes += sign * ab
        if self.i % self.window == 0:
            self.sum_squares, self.sum_sizes = (math.fsum(x[k] for x in self.changes if x[0] > 0) for k in (0, 1))

    def snapshot(self) -> dict:
        """State as plain values."""
        return {**self.scalars(), "spent": [list(x) for x in self.spent], "changes": [list(x) for x in self.changes]}

    def scalars(self) -> dict:
        """What does not grow with the window."""
        return {"i": self.i, "c": self.c, "rho": self.rho, "sums": [self.sum_eps, self.sum_svt], "moved": [self.moved, self.sum_squares, self.sum_sizes],
                "raw": None if self.last_raw is None else self.last_raw.tolist(), "out": None if self.out is None else self.out.tolist()}

    def restore(self, doc: dict) -> None:
        self.i, self.c, self.rho = doc["i"], doc["c"], doc["rho"]
        self.spent = deque((int(n), eps, svt) for n, eps, svt in doc["spent"])
        self.sum_eps, self.sum_svt = doc["sums"]
        self.changes = deque((a, b) for a, b in doc["changes"])
        self.moved, self.sum_squares, self.sum_sizes = doc["moved"]
        self.last_raw = None if doc["raw"] is None else np.asarray(doc["raw"])
        self.out = None if doc["out"] is None else np.asarray(doc["out"])

    def last_row(self) -> tuple[int, float, float, float, float]:
        """Row, budgets it spent, and the change it made: what later rows need of the row that was published last."""
        n = self.i - 1
        eps, svt = self.spent[-1][1:] if self.spent and self.spent[-1][0] == n else (0.0, 0.0)
        return (n, eps, svt, *(self.changes[-1] if n >= 2 else (0.0, 0.0)))

    def restore_rows(self, scalars: dict, rows: list[tuple[int, float, float, float, float]]) -> None:
        """The state from ``scalars`` and ``last_row`` of each row that may still be in sight, in order."""
        i = scalars["i"]
        self.restore({**scalars, "spent": [r[:3] for r in rows if (r[1] > 0 or r[2] > 0) and r[0] > i - self.window],
                      "changes": [r[3:] for r in rows if r[0] >= max(2, i - self.history)]})

    def _decide(self, row, noise, u_query):
        """Every release adds noise for exactly the budget that is booked for it.

        Of the release budget a window has ``remain`` left, to be given out in shares of ``eps_p / c``. When as many rows
        are left in the window as shares, each is released; otherwise a row is released if it has moved far enough.
        """
        remain, share = self.eps_p - self.sum_eps, self.eps_p / self.c
        # Rows from the first release in sight to the row before this one; all budget returns after the window of that release.
        first = next((n for n, eps, _ in self.spent if eps > 0), self.i)
        left = self.window - (self.i - first)
        # Counts of shares are compared with a tolerance: they are exact integers but for rounding.
        if left <= int(remain / share + 1e-9):
            tested_since = math.fsum(svt for n, _, svt in self.spent if n >= first) if self.spent and self.spent[0][0] < first else self.sum_svt
            svt_left = max(0.0, self.eps_query - tested_since) / self.c
            spent = remain / left
            return row + noise * (self.s_p / (spent + svt_left)), spent, svt_left
        threshold = self.c * self.s_p / self.eps_p + self.rho
        drift = float(np.abs(row - self.last_raw).sum()) / self.dim
        noisy = drift + u_query * self.s_s * 2.0 * self.c / self.eps_query
        if noisy > threshold and remain >= share * (1.0 - 1e-9):
            spent = min(share, remain)
            return row + noise * (self.s_p / spent), spent, self.eps_query / self.c
        return self.out, 0.0, 0.0

    def _target_count(self) -> int:
        if not self.moved:
            return 1
        squares, sizes = self.sum_squares / self.moved, self.sum_sizes / self.moved
        proxy = squares - sizes * sizes
        return max(int(np.sqrt(0.75 * max(proxy, 0.0)) * self.eps_p / self.s_p / 3.0), 1)


def publish_streams(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], epsilons: Sequence[float],
                    seeds: Sequence[int], s_p: float, s_s: float, window: int, windows_back: int = 2,
                    warm_rows: int | None = None) -> DataFrame:
    """Private release of every (series, epsilon, seed) stream with its budget use per row.

    A series is shuffled and read once, however many budgets and seeds there are: its task drives a publisher for each of them.
    One stream is sequential by definition; series run in parallel. The rows of a series reach its task sorted and are
    consumed batch by batch with bounded state, so even a very long one is never held in memory. ``s_p`` and ``s_s`` are public
    bounds of range and step. Noise is derived from row identifiers behind the shuffle, so that a re-run task repeats the
    same release and no noise is shuffled.
    """
    if window < 2:
        raise ValueError("the window must have at least two rows")
    grid = [(float(e), int(s)) for e in epsilons for s in seeds]
    each = F.array(*[F.struct(F.lit(e).alias("epsilon"), F.lit(s).alias("seed")) for e, s in grid])
    ids = [F.col(k) for k in (*keys, pos)]

    def noise(g: Column) -> Column:
        def unit(role: str) -> Column:
            return laplace(uniform("spas", role, g["seed"], (g["epsilon"] * 1e6).cast("bigint"), *ids), 1.0)
        return F.array(*[unit(role) for role in (*cols, "query", "threshold")])

    width = len(cols) + 2
    ordered = df.select(*keys, pos, *cols).repartition(*keys).sortWithinPartitions(*keys, pos)
    noised = ordered.select(*keys, pos, *[F.col(c).cast("double").alias(c) for c in cols], F.flatten(F.transform(each, noise)).alias("_z"))
    fields = {f.name: f.dataType.simpleString() for f in noised.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "epsilon double", "seed int", f"{pos} {fields[pos]}",
                        *[f"{c} double" for c in cols], "eps_used double", "svt_used double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in cols]).astype(float)
            z = np.asarray(batch["_z"].flatten()).reshape(n, len(grid), width)
            out, used = np.empty((len(grid), n, len(cols))), np.empty((len(grid), n, 2))
            for i, name in enumerate(zip(*[batch[k].to_pylist() for k in keys])):
                if name != current:
                    current = name
                    states = [StreamPublisher(e, s_p, s_s, window, windows_back, len(cols), warm_rows) for e, _ in grid]
                for g, state in enumerate(states):
                    used[g, i] = state.publish(x[i], z[i, g, :-2], z[i, g, -2], z[i, g, -1])
                    out[g, i] = state.out
            for g, (epsilon, seed) in enumerate(grid):
                yield pa.RecordBatch.from_arrays(
                    [*[batch[k] for k in keys], pa.array(np.full(n, epsilon)), pa.array(np.full(n, seed, dtype=np.int32)), batch[pos],
                     *[pa.array(out[g, :, j]) for j in range(len(cols))], pa.array(used[g, :, 0]), pa.array(used[g, :, 1])],
                    [*keys, "epsilon", "seed", pos, *cols, "eps_used", "svt_used"])

    return noised.mapInArrow(run, schema)


def grr_keep_probability(epsilon: Column | float, classes: int) -> Column:
    e = F.exp(epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon)))
    return e / (e + F.lit(classes - 1))


def grr_row_epsilon(total: float, rows: Column, length: int, fraction: float = 0.005) -> Column:
    """Label budget of one window: the total divided by the windows that can share an event."""
    return F.lit(float(total)) / F.ceil(rows * F.lit(fraction) / F.lit(length))


def randomised_response(df: DataFrame, ids: Sequence[str], label: str, epsilon: Column | float, classes: int,
                        seed: int, out: str = "noisy_label") -> DataFrame:
    """Keep a label 1..k with probability e^eps/(e^eps+k-1), else a uniform other class (skipping the true one)."""
    keys = [F.col(i) for i in ids]
    keep = uniform(seed, "keep", *keys) < grr_keep_probability(epsilon, classes)
    other = (F.floor(uniform(seed, "other", *keys) * F.lit(classes - 1)) + 1).cast("int")
    skipped = other + F.when(other >= F.col(label), 1).otherwise(0)
    return df.withColumn(out, F.when(keep, F.col(label)).otherwise(skipped).cast("int"))


def debias_counts(df: DataFrame, keys: Sequence[str], noisy: str, epsilon: float, classes: int) -> DataFrame:
    """Observed and unbiased class counts from randomised labels."""
    p = grr_keep_probability(epsilon, classes)
    q = (1.0 - p) / F.lit(float(classes - 1))
    seen = df.groupBy(*keys, noisy).agg(F.count(F.lit(1)).alias("observed"))
    joined = group_stats(seen, keys, {"_n": F.sum("observed")})
    return joined.withColumn("estimate", (F.col("observed") - F.col("_n") * q) / (p - q)).drop("_n")
