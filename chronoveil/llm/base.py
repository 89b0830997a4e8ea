"""What the operators of this subpackage share: column picking, scratch tables, ordered blocks and word splitting."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoveil.session import prepare, scratch_path

#: Rows, and bytes, that one Arrow batch carries to a Python worker; they bound the worker's memory.
ARROW_ROWS = 2_000
ARROW_BYTES = "4m"
#: Most blocks an ordered table is cut into. Their bounds are the only thing the driver holds (8 bytes each).
MAX_BLOCKS = 65_536


def set_up(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and Arrow batches small enough for whole texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that further columns of any name cannot clash.

    ``pick(df, doc_id=("id", "bigint"), text=("body", "string"))`` reads ``id`` and ``body``.
    """
    return df.select(*[df[name].cast(kind).alias(alias) for alias, (name, kind) in columns.items()])


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pick(df, doc_id=(doc_id, "bigint"), text=(text, "string"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = f"_{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later stages survive lost executors and repeat nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex[:8]}")
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def released(run):
    """``run`` over the batches of a task; then the worker, which waits for further tasks, gives back what Arrow holds for reuse."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return whole


def ordered_bounds(df: DataFrame, key: str, rows_per_block: int) -> list[int]:
    """Upper bounds that cut the long column ``key`` into blocks of about ``rows_per_block`` rows.

    Reads that one column. Blocks grow once there would be more than ``MAX_BLOCKS``.
    """
    rows = df.count()
    blocks = min(MAX_BLOCKS, max(1, -(-rows // rows_per_block)))
    if blocks == 1:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    cuts = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * blocks)).alias("cuts")).first().cuts
    return sorted({int(c) for c in cuts or []})


def block_of(key: str, bounds: list[int]) -> Column:
    """Number of the block of a row: how many bounds lie below its key. Null keys come first.

    A binary search over the literal bounds: a chain of comparisons of logarithmic depth.
    """
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) <= F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))
    if len(bounds) <= 64:
        return F.coalesce(F.when(F.col(key).isNull(), F.lit(0)).otherwise(search(0, len(bounds))), F.lit(0)).cast("int")
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(keys):
        import pandas as pd
        return pd.Series(np.searchsorted(cuts, keys.fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64)))
    return find(F.col(key))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch, one after another, and the offsets at which each begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch of texts between ASCII white space, their code at each position, and text offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    if len(flat):  # white space at either end gives empty words
        full = pc.not_equal(flat, "")
        if not pc.all(full).as_py():
            keep = full.to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), offsets


#: Odd multipliers of a polynomial hash over bytes.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:end]``; spans follow each other and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    most = int(lengths.max()) if len(lengths) else 0
    table = powers(most + 1)
    total = int(lengths.sum())
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(total) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        terms = (data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)) * table[place]
        sums = np.zeros(len(starts), np.uint64)
        full = lengths > 0
        if full.any():
            sums[full] = np.add.reduceat(terms, first[full])
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """64-bit hash of each word of a dictionary."""
    data, offsets = utf8(dictionary)
    return hash_spans(data, offsets[:-1], offsets[1:])


def ranked(df: DataFrame, group: list[str], order: list[str], label: str, rows_per_range: int = 16_384, most: int = 20_000) -> DataFrame:
    """``df`` as a written table with ``rank``: from 0 within ``group`` (no nulls), in ``order`` (nulls first).

    Rows are cut into ranges of the full order, numbered where they lie and shifted by the rows of earlier ranges, so neither a
    group of any size nor repeated rows (told apart by their place in the input) gather in one task.
    """
    part, place, least, rows = (fresh(df, s) for s in ("part", "place", "least", "rows"))
    ranges = max(1, min(most, -(-df.count() // rows_per_range)))
    keys = [*group, *order]
    cut = df.withColumn(place, F.monotonically_increasing_id())
    cut = cut.repartitionByRange(ranges, *keys, place).sortWithinPartitions(*keys, place)
    table = written(cut.withColumn(place, F.monotonically_increasing_id()), label)
    numbered = table.withColumn(part, F.shiftright(place, 33))
    counts = numbered.groupBy(*group, part).agg(F.min(place).alias(least), F.count("*").alias(rows))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, part, F.col(least), F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(rows))
    out = numbered.join(counts, [*group, part])
    out = out.select(*df.columns, (F.col(place) - F.col(least) + F.col(rows)).alias("rank"))
    out._scratch = table._scratch
    return out
