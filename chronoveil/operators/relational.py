"""Joins, unions and set-like operators on series tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.operators.position import join_null_safe


def common_range(df: DataFrame, keys: Sequence[str], parts: Sequence[str], t: str) -> DataFrame:
    """Time range shared by all parts (sensors) of a key: latest start to earliest end; empty ranges are dropped."""
    per_part = df.groupBy(*keys, *parts).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return (per_part.groupBy(*keys).agg(F.max("_lo").alias("t_start"), F.min("_hi").alias("t_end"))
            .filter(F.col("t_end") > F.col("t_start")))


def both_sides(df: DataFrame, keys: Sequence[str], side: str, required: Sequence) -> DataFrame:
    """Groups that have every required side, and which ones are missing where not (all of them, if a group has none)."""
    have = F.collect_set(F.when(F.col(side).isin(list(required)), F.col(side)))
    need = F.array(*[F.lit(r) for r in required])
    return (df.groupBy(*keys).agg(have.alias("_have"))
            .select(*keys, (F.size("_have") == len(required)).alias("complete"),
                    F.concat_ws(",", F.array_sort(F.array_except(need, "_have")).cast("array<string>")).alias("missing")))


def keep_complete(df: DataFrame, keys: Sequence[str], side: str, required: Sequence) -> DataFrame:
    """Rows of the groups that have every required side (relational division by semi-join)."""
    good = both_sides(df, keys, side, required).filter("complete").select(*keys)
    return join_null_safe(df, good, keys, "left_semi")


def align_columns(long: DataFrame, keys: Sequence[str], channel: str, value: str, channels: Sequence[str]) -> DataFrame:
    """Merge channels on a common grid: one column per channel, null where a channel has no value."""
    return long.groupBy(*keys).pivot(channel, list(channels)).agg(F.first(value))


def union_fill(frames: Sequence[DataFrame], fill: float | None = 0.0) -> DataFrame:
    """Union of tables with different columns; columns a table lacks are filled with ``fill`` (None keeps null)."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out if fill is None else out.fillna(fill)


def submatrix(edges: DataFrame, nodes: DataFrame, node: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose both ends are in ``nodes``: two semi-joins."""
    keep = nodes.select(node)
    return (edges.join(keep.withColumnRenamed(node, src), src, "left_semi")
            .join(keep.withColumnRenamed(node, dst), dst, "left_semi"))


def missing_from_grid(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each run key: ok, missing, duplicate or unexpected."""
    counts = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"))
    both = expected.select(*keys).withColumn("_e", F.lit(True)).transform(lambda d: join_null_safe(d, counts, keys, "full"))
    runs = F.coalesce("runs", F.lit(0))
    status = (F.when(F.col("_e").isNull(), "unexpected").when(runs == 0, "missing")
              .when(runs > 1, "duplicate").otherwise("ok"))
    return both.select(*keys, runs.cast("bigint").alias("runs"), status.alias("status"))


def sweep(base: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """Cartesian grid of parameter values, attached to every row of ``base`` by exploding literal arrays."""
    out = base
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def unseen_classes(train: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """Classes of ``other`` that never occur in ``train``."""
    return join_null_safe(other.select(label).distinct(), train.select(label).distinct(), [label], "left_anti")


def duplicate_report(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose key, null included, repeats an earlier row; of rows that tie in ``order`` the smallest is the first, and
    all other copies of it are reported. Equal rows are counted and the first row per key is an aggregate, so a key shared
    by a third of the table is never sorted in one task."""
    row = F.struct(order, *[c for c in df.columns if c != order])
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy(*keys).agg(F.min(row).alias("_first"))
    again = join_null_safe(counted, first, keys).withColumn("_n", F.col("_n") - row.eqNullSafe(F.col("_first")).cast("int"))
    return again.filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*df.columns)


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of each key in ``order``, as a map-side combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` tuple per key."""
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_b")[c].alias(c) for c in cols])
