"""Bounded training samples, split off by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.llm.base import fresh


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, which no model learns from. A null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


#: Drawn keys that are broadcast (16 bytes and the label each).
BROADCAST_KEYS = 500_000


def sample_per_class(rows: DataFrame, label: str, key: list[str], most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each value of ``label`` (all where there are fewer), drawn by a hash of the columns ``key``.

    Rows that are equal in ``label`` and ``key`` count as one, so a repeated row or id brings no more than its share. Also
    the number of different rows of each value. Every value takes part; the driver holds one count for each.
    """
    draw = fresh(rows, "draw")
    marked = rows.withColumn(draw, F.xxhash64(F.lit("sample"), *key))
    different = marked.select(label, draw).distinct()
    counts = different.groupBy(label).count()
    share = F.shiftrightunsigned(draw, 11).cast("double") / F.lit(float(2 ** 53)) < F.lit(float(most)) / F.col("count")
    drawn = different.join(counts, label).filter(share).select(label, draw)
    few = drawn.count() <= BROADCAST_KEYS
    found = marked.join(F.broadcast(drawn) if few else drawn, [label, draw], "left_semi").dropDuplicates([label, draw])
    return found.drop(draw), {r[label]: r["count"] for r in counts.collect()}
