"""Validation as one-pass aggregates; nothing but verdicts leaves the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.position import BLOCK_ROWS, framed, join_null_safe
from chronoveil.operators.quantile import exact_quantiles


def is_bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def tiling(bounds: DataFrame, keys: Sequence[str], start: str, stop: str, name: str, rows: DataFrame) -> DataFrame:
    """Per key: intervals have unique names and tile [0, n) exactly; ``rows`` gives ``n`` per key.

    Every start must be 0 or the stop of another interval and the lengths must add up to n: then a chain of
    intervals covers [0, n) and no length is left for an overlap. No interval list is sorted or collected.
    """
    stops = bounds.select(*keys, F.col(stop).alias(start)).distinct().withColumn("_met", F.lit(True))
    seen = join_null_safe(bounds, stops, [*keys, start], "left")
    stats = seen.groupBy(*keys).agg(
        F.count_if(F.col("_met").isNull() & (F.col(start) != 0)).alias("gaps"),
        F.count_if(F.col(start) >= F.col(stop)).alias("empty"),
        (F.count(F.lit(1)) - F.count_distinct(name)).alias("repeated"),
        F.sum(F.col(stop) - F.col(start)).alias("total"), F.max(stop).alias("covered"))
    return join_null_safe(stats, rows, keys).withColumn(
        "ok", (F.col("gaps") == 0) & (F.col("empty") == 0) & (F.col("repeated") == 0)
        & (F.col("covered") == F.col("n")) & (F.col("total") == F.col("n")))


def monotonic(df: DataFrame, keys: Sequence[str], pos: str, t: str, expected: int, tolerance: float,
              columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per key: strictly increasing time, median step close to the expected one, nulls per column."""
    steps = framed(df.select(*keys, pos, t, *columns), keys, pos, 1, 0,
                   {"_d": lambda w: F.col(t) - F.lag(t).over(w)}, block_rows)
    basics = steps.groupBy(*keys).agg(
        F.coalesce(F.min("_d") > 0, F.lit(True)).alias("increasing"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
    median = exact_quantiles(steps, keys, "_d", {"median_step": 0.5})
    return join_null_safe(basics, median, keys, "left").withColumn(
        "step_ok", F.coalesce(F.abs(F.col("median_step") - F.lit(expected)) <= tolerance, F.lit(False)))


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, t: str) -> DataFrame:
    """Per key: rows of both sides and positions whose times differ or exist on one side only."""
    a = left.select(*keys, pos, F.col(t).alias("_a"))
    b = right.select(*keys, pos, F.col(t).alias("_b"))
    both = join_null_safe(a, b, [*keys, pos], "full")
    return both.groupBy(*keys).agg(
        F.count("_a").alias("left_rows"), F.count("_b").alias("right_rows"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"))


def binary_labels(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per key: labels are within {0, 1} and both occur."""
    return df.groupBy(*keys).agg(
        F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("invalid"),
        F.count_distinct(label).alias("classes")).withColumn(
        "ok", (F.col("invalid") == 0) & (F.col("classes") == 2))


def strict_timestamp(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Parse, and fail the job with the offending text when a non-null value does not parse."""
    parsed = F.try_to_timestamp(text, F.lit(fmt))
    return F.when(text.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit("unparsable timestamp: "), text))).otherwise(parsed)


def to_numeric(text: Column) -> Column:
    """Number, or null when the text is not one."""
    return text.try_cast("double")


def time_unit_ms(first_value: Column, value: Column) -> tuple[Column, Column]:
    """Unit guessed from the first value of a file and the value in integer milliseconds.

    Fixed thresholds: above 1e15 microseconds, above 1e12 milliseconds, above 1e9 seconds, else milliseconds.
    """
    unit = (F.when(first_value > 1e15, "us").when(first_value > 1e12, "ms")
            .when(first_value > 1e9, "s").otherwise("ms"))
    ms = (F.when(unit == "us", (value / 1000).cast("bigint")).when(unit == "s", (value * 1000).cast("bigint"))
          .otherwise(value.cast("bigint")))
    return unit, ms


# Fixed candidate names of a time column, in order of preference.
TIME_COLUMNS = ["timestamp", "time", "t", "ts", "unix_time", "attr_time"]


def time_column(columns: Sequence[str]) -> str:
    """Name of the time column of a schema."""
    for name in TIME_COLUMNS:
        if name in columns:
            return name
    for name in columns:
        if "time" in name.lower():
            return name
    raise ValueError(f"no time column among {list(columns)}")


def id_ranges(text: Column) -> Column:
    """Ids named by text such as ``1,3-5``; parts that are not numbers are dropped. Sorted, without repeats."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))

    def expand(p: Column) -> Column:
        lo = F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 1).try_cast("bigint")
        hi = F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 2).try_cast("bigint")
        one = F.regexp_extract(p, r"^([+-]?\d+)$", 1).try_cast("bigint")
        return (F.when(one.isNotNull(), F.array(one))
                .when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<bigint>")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def feature_mode(columns: Sequence[str], target: str, mode: str) -> tuple[list[str], list[str]]:
    """Input and output columns: S = target only, M = all, MS = all inputs and the target as output."""
    ordered = [c for c in columns if c != target] + [target]
    if mode == "S":
        return [target], [target]
    if mode == "M":
        return ordered, ordered
    if mode == "MS":
        return ordered, [target]
    raise ValueError(f"unknown feature mode {mode!r}")


def unit_columns(columns: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """Columns with one of the prefixes, sorted."""
    return sorted(c for c in columns if c.startswith(tuple(prefixes)))
