"""Time-ordered splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.position import BLOCK_ROWS, join_null_safe, key_ranges, running_sum, series_stats


def split_ratio(df: DataFrame, keys: Sequence[str], pos: str, train: float = 0.7, test: float = 0.2) -> DataFrame:
    """Add ``split``: train = int(n*train) rows, test = int(n*test) last rows, val between (double arithmetic)."""
    sized = series_stats(df, keys, pos, {"n": F.count(F.lit(1))})
    n_train = F.floor(F.col("n") * F.lit(float(train)))
    n_test = F.floor(F.col("n") * F.lit(float(test)))
    label = (F.when(F.col(pos) < n_train, "train").when(F.col(pos) < F.col("n") - n_test, "val").otherwise("test"))
    return sized.withColumn("split", label)


def split_borders(df: DataFrame, pos: str, borders: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Rows of each split [lo, hi); intervals may overlap, so a row can be in several splits. The borders are
    expressions of the row, hence a filter over a short array and no range join."""
    marks = F.array(*[F.when((F.col(pos) >= lo) & (F.col(pos) < hi), F.lit(name)) for name, lo, hi in borders])
    return df.withColumn("split", F.explode(F.array_compact(marks)))


def split_with_context(df: DataFrame, keys: Sequence[str], pos: str, seq_len: int, train: float = 0.7,
                       test: float = 0.2, val: float | None = None) -> DataFrame:
    """70/10/20 style split whose val and test parts start ``seq_len`` rows earlier.

    ``val`` fixes the validation share; by default validation is what train and test leave.
    """
    sized = series_stats(df, keys, pos, {"n": F.count(F.lit(1))})
    n = F.col("n")
    n_train, n_test = F.floor(n * F.lit(float(train))), F.floor(n * F.lit(float(test)))
    n_val = n - n_train - n_test if val is None else F.floor(n * F.lit(float(val)))
    return split_borders(sized, pos, [
        ("train", F.lit(0), n_train),
        ("val", n_train - seq_len, n_train + n_val),
        ("test", n - n_test - seq_len, n)])


def split_fixed(df: DataFrame, pos: str, seq_len: int, train: int, val: int, test: int) -> DataFrame:
    """Splits of fixed row counts, e.g. 12/4/4 months of hourly rows."""
    return split_borders(df, pos, [
        ("train", F.lit(0), F.lit(train)),
        ("val", F.lit(train - seq_len), F.lit(train + val)),
        ("test", F.lit(train + val - seq_len), F.lit(train + val + test))])


def split_by_key(df: DataFrame, key: str, assignment: Mapping[str, Column]) -> DataFrame:
    """Assign whole subjects to splits; ``assignment`` maps a split to a predicate on the key."""
    label = F.lit(None).cast("string")
    for name, cond in reversed(list(assignment.items())):
        label = F.when(cond, F.lit(name)).otherwise(label)
    return df.withColumn("split", label).filter(F.col("split").isNotNull())


def split_eval_gap(df: DataFrame, keys: Sequence[str], pos: str, fraction: float, gap: int) -> DataFrame:
    """Per sequence: development = [0, cut), held_out = [cut + gap, n), cut = int(n * fraction).

    Adds ``split`` and ``new_pos``, the position inside the selected part."""
    sized = series_stats(df, keys, pos, {"n": F.count(F.lit(1))})
    cut = F.floor(F.col("n") * F.lit(float(fraction))).cast("bigint")
    part = F.when(F.col(pos) < cut, "development").when(F.col(pos) >= cut + gap, "held_out")
    return (sized.withColumn("split", part).filter(F.col("split").isNotNull())
            .withColumn("new_pos", F.when(F.col("split") == "development", F.col(pos))
                        .otherwise(F.col(pos) - cut - gap)))


def pooled_position(df: DataFrame, keys: Sequence[str], pos: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Position in the concatenation of all series (series in key order): offset of the series + own position.

    Only one row per series takes part in the prefix sum; beyond ``block_rows`` series that table is cut into ranges of its
    keys, which may be of any type and number.
    """
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    summed = running_sum(lengths, [], list(keys), key_ranges(lengths, keys, block_rows), {"_cum": F.col("_len")})
    offsets = summed.select(*keys, (F.col("_cum") - F.col("_len")).alias("_off"))
    return join_null_safe(df, offsets, keys).withColumn("pool_pos", F.col("_off") + F.col(pos)).drop("_off")


def forecast_tail(df: DataFrame, keys: Sequence[str], pos: str, t: str, value: str, seq_len: int, horizon: int,
                  step: int) -> DataFrame:
    """Last ``seq_len`` rows of each series and the ``horizon`` future time points after it (value null)."""
    last = df.groupBy(*keys).agg(F.max(pos).alias("_last"), F.max_by(t, pos).alias("_t"))
    tail = (join_null_safe(df, last, keys).filter(F.col(pos) > F.col("_last") - seq_len)
            .select(*keys, F.col(pos).alias("pos"), F.col(t).alias("t"), F.col(value).alias("value"),
                    F.lit("context").alias("part")))
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    future = (last.select(*keys, "_last", "_t", h.alias("_h"))
              .select(*keys, (F.col("_last") + F.col("_h")).alias("pos"), (F.col("_t") + F.col("_h") * step).alias("t"),
                      F.lit(None).cast("double").alias("value"), F.lit("future").alias("part")))
    return tail.unionByName(future)


