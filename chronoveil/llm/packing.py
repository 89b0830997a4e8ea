"""Packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` ids; only longer ones are cut. Bins are filled one at a time: the longest
length still there, then the fullest feasible combination of the rest, found by subset sums over a bitset, which is taken
away. Only the count per length matters for that (at most ``capacity`` numbers, whatever the size of the corpus), and a
combination that was fullest stays fullest while its lengths last, so it is repeated at once: the driver makes a short
list of patterns and Spark gives every piece its place by its rank among pieces of its length.

Defined results: a null text is empty and has the end id alone; null and repeated ids are packed like all others; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base, tokens

CAPACITY = 4096
END_ID = 1
#: Rows of one length are ranked in at least so many independent groups, one more for each million pieces.
GROUPS = 64

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def fullest(counts: np.ndarray, room: int) -> tuple[int, dict[int, int]]:
    """The fullest combination of lengths that fits into ``room``: its sum and how often it takes each length.

    Bit s of ``reach`` says that a sum s can be made. Copies of a length are added in powers of two; the reach before
    every step is kept for the way back. Long lengths first, and no further once the room is filled exactly.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        copies, take = min(int(counts[length]), room // length), 1
        while copies > 0:
            take = min(take, copies)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            copies, take = copies - take, take * 2
        if reach >> room & 1:
            break
    best = total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return best, chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, pieces of each length in every one of them) until all pieces of the histogram are placed."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    counts[0] = 0
    out = []
    while True:
        left = np.flatnonzero(counts)
        if not len(left):
            return out
        longest = int(left[-1])
        counts[longest] -= 1
        _, taken = fullest(counts, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        bins = min(int(counts[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            counts[length] -= bins * n
        out.append((bins, taken))


def slots(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, in the order of (length, rank): runs of ranks with their first bin."""
    rows, begun, first = [], {}, 0
    for bins, taken in patterns(histogram, capacity):
        offset = 0
        for length in sorted(taken, reverse=True):
            rank = begun.get(length, 0)
            rows.append((length, rank, taken[length], first, offset))
            begun[length] = rank + bins * taken[length]
            offset += taken[length] * length
        first += bins
    before, total = {}, 0
    for length in sorted(histogram):
        before[length] = total
        total += histogram[length]
    rows = sorted((before[length] + rank, length, each, first, offset) for length, rank, each, first, offset in rows)
    names = ("begin", "length", "each", "first", "offset")
    table = {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)}
    table["before"] = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in before.items():
        table["before"][length] = n
    return table


def _cut(path: str, capacity: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        encoder = tokens.word_encoder(path)
        for batch in batches:
            ids, offsets = encoder.encode(batch.column("text"))
            ids, rows = ids.astype("<u4"), []
            end = np.array([end_id], dtype="<u4")
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.concatenate((ids[a:b], end))
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start:start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def _place(table: dict[str, np.ndarray]):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            place = table["before"][length] + batch.column("rank").to_numpy()
            slot = np.searchsorted(table["begin"], place, side="right") - 1
            row = place - table["begin"][slot]
            each = table["each"][slot]
            kept = [batch.column(n) for n in schema.names[:5]]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(table["first"][slot] + row // each), pa.array(
                table["offset"][slot] + row % each * length)], schema=schema)
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    base.set_up(docs.sparkSession)
    rows = base.documents(docs, doc_id, text)
    cut = rows.mapInArrow(_cut(tokenizer or tokens.public_tokenizer(), capacity, end_id), PIECES)
    pieces = base.written(cut, "pieces")
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    groups = max(GROUPS, sum(histogram.values()) // 1_000_000)
    spread = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    ranked = spread.withColumn("place", F.expr(
        "row_number() over (partition by length, grp order by doc_id, piece, ids_crc32) - 1"))
    before = spread.groupBy("length", "grp").count().select("length", "grp", F.expr(
        "sum(count) over (partition by length order by grp rows unbounded preceding) - count").alias("before"))
    ranked = ranked.join(before, ["length", "grp"]).withColumn("rank", F.col("place") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint").alias("rank"))
    return ranked.mapInArrow(_place(slots(histogram, capacity)), f"{PIECES}, sequence_id bigint, offset bigint")
