"""Row positions and order-dependent primitives that do not depend on key sizes.

An ordered window over ``partitionBy(series)`` puts one series into one task. That is fine while the longest series
is known to be short, and fatal when one series holds a third of the table. ``with_position`` measures the longest
series once and stores the bound in the metadata of the position column; the other primitives read it and use the
plain window below the bound. Beyond it, or when the bound is unknown, they work on fixed blocks of positions:

* frames (``framed``): each row is also copied to the neighbouring block that needs it,
* carries (``carry``): last/next known value per block, joined through a table of one row per block,
* prefix sums (``running_sum``): block-local sums plus block offsets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from chronoveil.session import scratch_path

BLOCK_ROWS = 1 << 20
# Rows times columns of a broadcast table: some 10 MB.
BROADCAST_CELLS = 400_000
ROW_BOUND = "max_series_rows"
SERIES_COUNT = "series_count"
SERIES_KEYS = "series_keys"
ROWS = "rows"
BLK = "_blk"
# Rows that a task sorts; a stage of several windows holds a sort for each.
TASK_ROWS = 1 << 16
# Distinct values or keys that one sorted range holds, and the most ranges.
RANGE_ROWS = 1 << 20
MAX_RANGES = 1024


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key is a key like any other; the keys are those of ``left``, of a full join those of either side."""
    if not any(left.schema[k].nullable and right.schema[k].nullable for k in on):
        return left.join(right, list(on), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    match = F.lit(True)
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    both = left.join(renamed, match, how)
    if how == "full":
        both = both.withColumns({k: F.coalesce(k, f"_r_{k}") for k in on})
    return both.drop(*[f"_r_{k}" for k in on])


def join_sized(big: DataFrame, small: DataFrame, on: Sequence[str], rows: int | None, how: str = "inner") -> DataFrame:
    """Null-safe join that broadcasts ``small`` only when its row count is known to be small and its rows are of a few
    columns of one value each; otherwise AQE chooses by bytes (skew join included)."""
    plain = all(not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in small.schema.fields)
    few = rows is not None and plain and rows * max(1, len(small.columns)) <= BROADCAST_CELLS
    return join_null_safe(big, F.broadcast(small) if few else small, on, how)


def mark_bound(df: DataFrame, pos: str, rows: int, keys: Sequence[str], series: int, total: int | None = None) -> DataFrame:
    """Record on the position column how long the longest series is, how many series there are and, if known, how many rows."""
    known = {} if total is None else {ROWS: int(total)}
    return df.withMetadata(pos, {ROW_BOUND: int(rows), SERIES_COUNT: int(series), SERIES_KEYS: list(keys), **known})


def spread(df: DataFrame, cols: Sequence[str], rows: int | None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows by ``cols``, in as many parts as ``rows`` need for ``task_rows`` each: the number that the session names, and merging by
    bytes, know neither how wide rows become nor how many sorts a task runs. A table of few rows is returned as it is."""
    if rows is None or rows <= task_rows:
        return df
    return df.repartition(max(-(-rows // task_rows), df.sparkSession.sparkContext.defaultParallelism), *cols)


def group_bound(df: DataFrame, keys: Sequence[str]) -> int | None:
    """Measured upper bound on the number of groups of ``keys``, if positions recorded one."""
    for field in df.schema.fields:
        if keys and set(keys) <= set(field.metadata.get(SERIES_KEYS, [])):
            return field.metadata[SERIES_COUNT]
    return None


def is_short(df: DataFrame, keys: Sequence[str], pos: str, block_rows: int) -> bool:
    """Whether every group of ``keys`` is known to have at most ``block_rows`` rows: the bound was measured for series
    whose keys are all among ``keys``."""
    measured = df.schema[pos].metadata
    return ROW_BOUND in measured and measured[ROW_BOUND] <= block_rows and set(measured[SERIES_KEYS]) <= set(keys)


def with_position(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (), out: str = "pos",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by ``order`` (a BIGINT) then ``tie``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    long_keys = sizes.filter(F.col("_n") > block_rows)
    longest, n_long, n_series, n_rows = sizes.agg(
        F.max("_n"), F.count_if(F.col("_n") > block_rows), F.count(F.lit(1)), F.sum("_n")).first()
    if not n_long:
        spec = Window.partitionBy(*keys).orderBy(order, *tie)
        placed = (spread(df, keys, n_rows) if keys else df).withColumn(out, F.row_number().over(spec).cast("bigint") - 1)
        return mark_bound(placed, out, longest or 0, keys, n_series, n_rows or 0)

    cuts = long_keys.select(
        *keys, "_lo", ((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / F.lit(block_rows))).alias("_width"))
    tagged = join_sized(df, cuts, keys, n_long, "left").withColumn(
        BLK, F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("bigint"))
    tagged = _refine(tagged.withColumn("_long", F.col("_lo").isNotNull()).drop("_lo", "_width"), keys, order, tie, block_rows)
    blocks = [BLK, "_sub"]
    counts = tagged.filter("_long").groupBy(*keys, *blocks).agg(F.count(F.lit(1)).alias("_c"))
    if counts.agg(F.max("_c")).first()[0] > 4 * block_rows:  # equal times whose ties are no numbers, or bursts within bursts
        return mark_bound(_position_by_ranges(df, keys, order, tie, out, -(-n_rows // block_rows)), out, longest, keys, n_series, n_rows)
    earlier = Window.partitionBy(*keys).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *blocks, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"))
    # The offset of a block is a row of its own, the first in it: rows and offsets meet in one shuffle.
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in tagged.schema.fields if f.name not in (*keys, *blocks)]
    heads = offsets.select(*keys, *blocks, *blank, "_off")
    both = tagged.withColumn("_off", F.lit(None).cast("bigint")).unionByName(heads)
    block = Window.partitionBy(*keys, *blocks)
    rank = F.row_number().over(block.orderBy(F.col("_off").isNull(), order, *tie))
    head = F.max("_off").over(block.orderBy(F.col("_off").isNull(), order, *tie).rowsBetween(Window.unboundedPreceding, 0))
    placed = (spread(both, [*keys, *blocks], n_rows).select("*", rank.alias("_rn"), head.alias("_head")).filter(F.col("_off").isNull())
              .withColumn(out, F.when(F.col("_head").isNull(), F.col("_rn") - 1).otherwise(F.col("_head") + F.col("_rn") - 2).cast("bigint"))
              .drop(*blocks, "_long", "_rn", "_off", "_head"))
    return mark_bound(placed, out, longest, keys, n_series, n_rows)


def _position_by_ranges(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], out: str, ranges: int) -> DataFrame:
    """Positions from ranges of the full order, of any types: rows are sorted into equal ranges, whatever they hold, numbered where they lie,
    and shifted by the rows of their series in earlier ranges. The ranges are a written table, so every evaluation agrees on them."""
    spark = df.sparkSession
    full = [*keys, order, *tie, "_place"]
    cut = (df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(max(2, ranges), *full).sortWithinPartitions(*full)
           .withColumn("_place", F.monotonically_increasing_id()))
    path = scratch_path(spark, "positions")
    cut.write.parquet(path)
    rows = spark.read.schema(cut.schema).parquet(path).withColumn("_part", F.shiftright("_place", 33))
    counts = rows.groupBy(*keys, "_part").agg(F.min("_place").alias("_least"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_part", "_least", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    met = join_null_safe(rows, counts, [*keys, "_part"])
    return met.select(*df.columns, (F.col("_place") - F.col("_least") + F.col("_off")).cast("bigint").alias(out))


def _refine(tagged: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], block_rows: int) -> DataFrame:
    """Cut blocks of long keys that are still too large (bursts, equal times) once more; adds ``_sub``.

    A block is cut by its own range of ``order``, or by the first tie column where all its times are equal. All cuts
    come from exact counts and extremes, so every evaluation of the plan agrees on them.
    """
    second = tie[0] if tie and tagged.schema[tie[0]].dataType.typeName() in ("long", "integer", "short", "byte") else None
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")]
    if second:
        aggs += [F.min(second).alias("_tlo"), F.max(second).alias("_thi")]
    large = tagged.filter("_long").groupBy(*keys, BLK).agg(*aggs).filter(F.col("_n") > 4 * block_rows)
    n_large = large.count()
    if not n_large:
        return tagged.withColumn("_sub", F.lit(0).cast("bigint"))
    parts = F.ceil(F.col("_n") / F.lit(block_rows))
    by_time = F.floor((F.col(order) - F.col("_lo")) * parts / (F.col("_hi") - F.col("_lo") + 1))
    by_tie = F.floor((F.col(second) - F.col("_tlo")) * parts / (F.col("_thi") - F.col("_tlo") + 1)) if second else F.lit(0)
    cut = F.when(F.col("_hi") > F.col("_lo"), by_time).otherwise(by_tie)
    joined = join_sized(tagged, large, [*keys, BLK], n_large, "left")
    extra = ["_n", "_lo", "_hi"] + (["_tlo", "_thi"] if second else [])
    return joined.withColumn("_sub", F.coalesce(cut, F.lit(0)).cast("bigint")).drop(*extra)


Stage = dict[str, Callable[[WindowSpec], Column] | tuple]


def _stages(df: DataFrame, part: Sequence[str], pos: str, stages: Sequence[Stage]) -> DataFrame:
    asc = Window.partitionBy(*part).orderBy(pos)
    desc = Window.partitionBy(*part).orderBy(F.col(pos).desc())

    def column(fn) -> Column:
        if not isinstance(fn, tuple):
            return fn(asc)
        if fn[0] == "desc":
            return fn[1](desc)
        _, rows, order, inner = fn
        chunk = F.floor(F.col(pos) / F.lit(rows)).cast("bigint")
        return inner(Window.partitionBy(*part, chunk).orderBy(pos if order == "asc" else F.col(pos).desc()))
    for stage in stages:
        df = df.select("*", *[column(fn).alias(name) for name, fn in stage.items()])
    return df


def framed(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, exprs: Stage | Sequence[Stage],
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` rows ahead of a dense position.

    ``exprs`` maps a column name to a function of the ordered window, to ``("desc", function)`` for the descending one,
    or to ``("chunk", rows, "asc" or "desc", function)`` for windows that end at every ``rows``-th position. A list of such maps is applied in order inside the same shuffle; later stages see the columns of earlier ones.
    """
    stages = [exprs] if isinstance(exprs, dict) else exprs
    if is_short(df, keys, pos, block_rows):
        return _stages(df, keys, pos, stages)
    p = F.col(pos)
    first = F.greatest(F.lit(0), F.floor((p - after) / F.lit(block_rows))).cast("bigint")
    last = F.floor((p + before) / F.lit(block_rows)).cast("bigint")
    rows = df.schema[pos].metadata.get(ROWS)
    copies = 1 + (before + after) / block_rows
    copied = spread(df.withColumn(BLK, F.explode(F.sequence(first, last))), [*keys, BLK], None if rows is None else math.ceil(rows * copies))
    return (_stages(copied, [*keys, BLK], pos, stages)
            .filter(F.col(BLK) == F.floor(F.col(pos) / F.lit(block_rows)))
            .drop(BLK))


def trailing_sum(name: str, value: Column, rows: int, pos: str = "pos") -> list[Stage]:
    """Stages for the sum over the last ``rows`` rows, the current one included (null counts as 0).

    Positions are cut into chunks of ``rows``. A frame is the end of one chunk and the beginning of the next, so it is one
    sum from the right and one from the left: every row costs the same at any length, and only values inside the frame
    enter it. Nothing is subtracted, so a NaN or a very large value does not reach rows behind its frame. The stages leave
    ``trailing_scratch(name)`` behind.
    """
    v = F.coalesce(value, F.lit(0).cast("double"))
    before, behind = trailing_scratch(name)

    def running(w: WindowSpec) -> Column:
        return F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def whole(w: WindowSpec) -> Column:
        rest = F.when(F.col(pos) % rows != rows - 1, F.lag(behind, rows - 1).over(w))
        return F.col(before) + F.coalesce(rest, F.lit(0.0))
    return [{before: ("chunk", rows, "asc", running), behind: ("chunk", rows, "desc", running)}, {name: whole}]


def trailing_scratch(*names: str) -> list[str]:
    """Helper columns of ``trailing_sum``, to be dropped."""
    return [f"_{side}_{n}" for n in names for side in ("pre", "suf")]


def merge_stages(*parts: list[Stage]) -> list[Stage]:
    """Run several stage lists side by side."""
    depth = max(len(p) for p in parts)
    return [{k: v for p in parts if i < len(p) for k, v in p[i].items()} for i in range(depth)]


def series_stats(df: DataFrame, keys: Sequence[str], pos: str, exprs: dict[str, Column],
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Attach plain aggregates of each series to its rows.

    Series known to be short take an unordered window: positions already placed a series in one partition, so this
    needs no further shuffle or scan. Otherwise the aggregate is combined map-side and joined back.
    """
    if is_short(df, keys, pos, block_rows):
        spec = Window.partitionBy(*keys)
        return df.select("*", *[e.over(spec).alias(n) for n, e in exprs.items()])
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in exprs.items()])
    return join_sized(df, stats, keys, group_bound(df, keys))


def previous(df: DataFrame, keys: Sequence[str], pos: str, cols: dict[str, str], step: int = 1,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``lag`` columns: ``cols`` maps the new name to the source column."""
    return framed(df, keys, pos, step, 0,
                  {new: (lambda w, c=src: F.lag(c, step).over(w)) for new, src in cols.items()}, block_rows)


def block_of(df: DataFrame, keys: Sequence[str], pos: str, block_rows: int = BLOCK_ROWS) -> Column | None:
    """Block id of a row, or None when every series is known to fit one block."""
    if is_short(df, keys, pos, block_rows):
        return None
    return F.floor(F.col(pos) / F.lit(block_rows)).cast("bigint")


def carry(df: DataFrame, keys: Sequence[str], order: str, block: Column | None,
          values: dict[str, Column], forward: bool = True, inclusive: bool = True) -> DataFrame:
    """Last (``forward``) or next known value of each expression, over the whole series.

    ``block`` must be monotone in ``order``. A series then occupies one task per block, and only one row per block
    crosses blocks. With ``block=None`` the series is known to be short and a plain window is used.
    """
    asc = F.col(order).asc() if forward else F.col(order).desc()
    edge = 0 if inclusive else -1
    if block is None:
        spec = Window.partitionBy(*keys).orderBy(asc).rowsBetween(Window.unboundedPreceding, edge)
        return df.select("*", *[F.last(v, ignorenulls=True).over(spec).alias(n) for n, v in values.items()])

    tagged = df.withColumn(BLK, block)
    choose = F.max_by if forward else F.min_by
    summary = tagged.groupBy(*keys, BLK).agg(
        *[choose(v, F.when(v.isNotNull(), F.col(order))).alias(f"_s_{n}") for n, v in values.items()])
    blk_order = F.col(BLK).asc() if forward else F.col(BLK).desc()
    outer = Window.partitionBy(*keys).orderBy(blk_order).rowsBetween(Window.unboundedPreceding, -1)
    seeds = summary.select(*keys, BLK, *[F.last(f"_s_{n}", ignorenulls=True).over(outer).alias(f"_c_{n}")
                                         for n in values])
    spec = Window.partitionBy(*keys, BLK).orderBy(asc).rowsBetween(Window.unboundedPreceding, edge)
    local = tagged.repartition(*keys, BLK).select(
        "*", *[F.last(v, ignorenulls=True).over(spec).alias(f"_l_{n}") for n, v in values.items()])
    joined = join_null_safe(local, seeds, [*keys, BLK], "left")
    return joined.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None,
                values: dict[str, Column]) -> DataFrame:
    """Inclusive prefix sums in ``order`` inside ``keys``; ``block`` must be monotone in the order."""
    if block is None:
        spec = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(spec).alias(n) for n, v in values.items()])
    tagged = df.withColumn(BLK, block)
    outer = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, BLK).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    offsets = totals.select(*keys, BLK, *[F.sum(f"_s_{n}").over(outer).alias(f"_o_{n}") for n in values])
    spec = Window.partitionBy(*keys, BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.repartition(*keys, BLK).select(
        "*", *[F.sum(v).over(spec).alias(f"_l_{n}") for n, v in values.items()])
    joined = join_null_safe(local, offsets, [*keys, BLK], "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_l_{n}") + F.col(f"_o_{n}"), f"_l_{n}", f"_o_{n}").alias(n)
                                        for n in values])


def minimum_before(df: DataFrame, keys: Sequence[str], order: str, block: Column | None, col: str,
                   out: str) -> DataFrame:
    """Smallest value among all earlier rows of the series (null on the first row)."""
    def spec(cols, by):
        return Window.partitionBy(*cols).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    if block is None:
        return df.withColumn(out, F.min(col).over(spec(keys, order)))
    tagged = df.withColumn(BLK, block)
    lows = tagged.groupBy(*keys, BLK).agg(F.min(col).alias("_m"))
    seeds = lows.select(*keys, BLK, F.min("_m").over(spec(keys, BLK)).alias("_p"))
    local = tagged.repartition(*keys, BLK).withColumn("_l", F.min(col).over(spec([*keys, BLK], order)))
    return (join_null_safe(local, seeds, [*keys, BLK], "left").withColumn(out, F.least("_l", "_p")).drop("_l", "_p", BLK))


def range_count(rows: int, rows_per_range: int = RANGE_ROWS) -> int:
    """Ranges to cut so many rows into; ranges grow beyond ``MAX_RANGES`` of them, as every row is compared with all cuts."""
    return max(1, min(MAX_RANGES, -(-rows // rows_per_range)))


def key_ranges(df: DataFrame, cols: Sequence[str], rows_per_range: int = RANGE_ROWS) -> Column | None:
    """Range number of a row in the order of ``cols`` of any type, None if all rows fit one range.

    Cuts are the rows whose hash falls on a share of the values that brings about eight for each range: the same in every
    evaluation of the plan, and as evenly spread as the rows are.
    """
    rows = df.count()
    parts = range_count(rows, rows_per_range)
    if parts == 1:
        return None
    share = max(1, rows // (8 * parts))
    types = {c: df.schema[c].dataType for c in cols}
    drawn = df.select(*cols).filter(F.pmod(F.xxhash64(F.lit("cut"), *cols), F.lit(share)) == 0).distinct()
    cuts = drawn.orderBy(*[F.col(c).asc_nulls_first() for c in cols]).collect()
    cuts = cuts[::max(1, -(-len(cuts) // parts))]
    if not cuts:
        return None
    edges = F.array(*[F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in cols]) for r in cuts])
    return _cuts_below(edges, len(cuts), F.struct(*cols))


def value_splits(df: DataFrame, col: str, parts: int, error: float = 0.001) -> list[float]:
    """Approximate equi-depth cut points of a numeric column (at most ``parts - 1`` numbers reach the driver)."""
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(col, probs, error))) if probs else []


def _cuts_below(cuts: Column, count: int, value: Column) -> Column:
    """How many of the ascending literals ``cuts`` are not above ``value`` (null: none), by a search of halving steps."""
    steps = [1 << k for k in reversed(range(count.bit_length()))]

    def further(at: Column, step: Column) -> Column:
        inside = F.least(at + step, F.lit(count))
        return F.when((at + step <= count) & (F.element_at(cuts, inside) <= value), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def split_index(col: Column, splits: Sequence[float]) -> Column:
    """Index of the interval a value falls in; monotone in the value."""
    if not splits:
        return F.lit(0)
    return _cuts_below(F.array(*[F.lit(float(s)) for s in splits]), len(splits), col)


def explode_range(df: DataFrame, first: Column, last: Column, out: str, chunk: int = 1 << 16) -> DataFrame:
    """One row per integer first..last (none when last < first), without ever building a long array."""
    bounds = df.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint")).filter(
        F.col("_last") >= F.col("_first"))
    low = F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(chunk).cast("bigint")))
    parts = bounds.withColumn("_low", low)
    high = F.least(F.col("_low") + (chunk - 1), F.col("_last"))
    return parts.withColumn(out, F.explode(F.sequence(F.col("_low"), high))).drop("_first", "_last", "_low")


def spread_sequence(df: DataFrame, keys: Sequence[str], count: str, out: str, chunk: int = 1 << 16) -> DataFrame:
    """One row per index 0..count-1. Long sequences are first cut into chunks that are spread over the tasks, so a
    row with a very large count is not expanded inside one task."""
    chunks = (df.filter(F.col(count) > 0)
              .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                         F.floor((F.col(count) - 1) / chunk).cast("bigint"))))
              .repartition(*keys, "_chunk"))
    low = F.col("_chunk") * chunk
    high = F.least(low + chunk, F.col(count)) - 1
    return chunks.withColumn(out, F.explode(F.sequence(low.cast("bigint"), high.cast("bigint")))).drop("_chunk")
