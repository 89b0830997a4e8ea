"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of one symbol become one symbol; deterministic coin tossing turns each symbol into
one of six labels that depends on its few left neighbours only; local maxima of the labels begin the phrases; a phrase is
named by a hash of its symbols, and the names are the symbols of the next level. So equal substrings are parsed alike but
for a few symbols at their borders, wherever they stand. The fingerprint keeps the ``SKETCH`` smallest hashes of the
distinct phrase names from level ``FROM_LEVEL`` on (about nine bytes and more); likeness is the share of common names
among the smallest of both.

Defined results: a null text is empty; the empty text has the empty fingerprint; texts of one phrase have one name; two
empty fingerprints are alike (1), an empty and another are not (0). Memory grows with the longest text of a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base

SKETCH = 64
FROM_LEVEL = 2
ROWS_PER_RANGE = 2_000
#: Bytes of text that are parsed together.
TOGETHER = 1 << 20


def _toss_table(bits: int) -> np.ndarray:
    """Twice the lowest differing bit of a symbol and its left neighbour, plus that bit; at ``symbol << bits | neighbour``."""
    n = 1 << bits
    x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    differ = x ^ y
    place = np.where(differ > 0, np.bitwise_count((differ & -differ) - 1), 0)
    return (2 * place + (x >> place & 1)).astype(np.uint8).reshape(-1)


_TOSS = {bits: _toss_table(bits) for bits in (3, 4, 7, 8)}
_rng = np.random.default_rng(20_240_601)
_BYTES = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _tables or len(_tables[0]) < n:
        out = []
        for step in (_ODD, _INVERSE):
            steps = np.full(max(n, 1 << 16), step, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _tables[:] = out
    return _tables[0], _tables[1]


def _toss(labels: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """One round of coin tossing over small labels; the first symbol of a text has no neighbour and gives its last bit."""
    out = np.empty(len(labels), dtype=np.uint8)
    wide = labels.astype(np.uint16)
    out[1:] = _TOSS[bits][(wide[1:] << np.uint16(bits)) | wide[:-1]]
    out[first] = labels[first] & 1
    return out


def _level(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of a level from its symbols (bytes at level 0) and the flags of each text's first symbol; the new flags."""
    new = first.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    heads = np.flatnonzero(new)
    raw, lengths = symbols, None
    if len(heads) < len(symbols):
        lengths = np.diff(np.append(heads, len(symbols)))
        raw, first = symbols[heads], first[heads]
    names = _BYTES[raw] if level == 0 else raw.copy()
    if lengths is not None:
        runs = np.flatnonzero(lengths > 1)
        names[runs] = base.mix(names[runs] + lengths[runs].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    starts = np.flatnonzero(first)
    if level == 0:
        labels = _toss(_toss(_toss(raw, starts, 8), starts, 4), starts, 3)
    else:
        differ = raw[1:] ^ raw[:-1]
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) & np.uint8(63)
        labels = np.empty(len(raw), dtype=np.uint8)
        labels[1:] = 2 * place + ((raw[1:] >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        labels[starts] = (raw[starts] & np.uint64(1)).astype(np.uint8)
        labels = _toss(_toss(_toss(labels, starts, 7), starts, 4), starts, 3)
    rise = labels[1:] > labels[:-1]
    fall = labels[1:] < labels[:-1]
    cut = np.empty(len(labels), dtype=bool)
    cut[0] = True
    cut[1:] = rise | first[1:]
    peak = np.ones(len(labels), dtype=bool)
    peak[:-1] = fall | first[1:]
    cut &= peak
    cut[1:] &= ~first[:-1]  # a phrase has two symbols or more, but for the last of a text
    cut |= first
    begins = np.flatnonzero(cut)
    up, down = _powers(len(names))
    sums = np.add.reduceat(names * up[:len(names)], begins) * down[begins]
    return base.mix(sums + np.uint64(level + 1) * np.uint64(0x165667B19E3779F9)), first[begins]


def phrase_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 32-bit hash) of the distinct phrase names of all texts, sorted."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
    whose = np.flatnonzero(sizes)  # the text of each first symbol
    first = np.zeros(len(symbols), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[whose]] = True
    found, level = [], 0
    with np.errstate(over="ignore"):
        while len(symbols):
            symbols, first = _level(symbols, first, level)
            level += 1
            owner = np.cumsum(first) - 1
            if level >= FROM_LEVEL:
                short = (base.mix(symbols) >> np.uint64(32)).astype(np.uint64)
                found.append((whose[owner].astype(np.uint64) << np.uint64(32)) | short)
                counts = np.bincount(owner, minlength=len(whose))
                go_on = counts > 1  # a text of one symbol is parsed to its end
                if not go_on.all():
                    keep = go_on[owner]
                    symbols, first, whose = symbols[keep], first[keep], whose[go_on]
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def fingerprints(texts: list[bytes], sketch: int = SKETCH) -> list[bytes]:
    """The smallest hashes of each text, ascending, as big-endian 32-bit numbers. Texts are parsed in groups of bounded size."""
    out: list[bytes] = []
    begin = 0
    while begin < len(texts):
        end, held = begin, 0
        while end < len(texts) and (end == begin or held + len(texts[end]) <= TOGETHER):
            held += len(texts[end])
            end += 1
        whose, hashes = phrase_hashes(texts[begin:end])
        bounds = np.searchsorted(whose, np.arange(end - begin + 1))
        ordered = hashes.astype(">u4")
        out += [ordered[a:min(b, a + sketch)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        begin = end
    return out


def likeness(a: bytes, b: bytes, sketch: int = SKETCH) -> float:
    """Share of common names among the smallest names of both: an estimate of the Jaccard similarity of all names."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = [a[i:i + 4] for i in range(0, len(a), 4)]
    y = {b[i:i + 4] for i in range(0, len(b), 4)}
    smallest = sorted(y.union(x))[:sketch]
    common = y.intersection(x)
    return sum(s in common for s in smallest) / len(smallest)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the beginning of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
COLUMNS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compare(batches):
    """Rows come range by range in order; behind the last of a range comes the first of the next, as a guest."""
    held = None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text"))))
        rows = [held] + rows if held else rows
        held = rows[-1]
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            continue
        changed = [edited(texts[i], texts[i + 1]).encode() for i in pairs]
        prints = fingerprints([t.encode() for t in texts])
        prints_changed = fingerprints(changed)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((
            [rows[i][2] for i in pairs], [len(texts[i]) for i in pairs], [hashlib.sha256(x).hexdigest() for x in changed],
            [prints[i].hex() for i in pairs], [x.hex() for x in prints_changed],
            [likeness(prints[i], x) for i, x in zip(pairs, prints_changed)],
            [likeness(prints[i], prints[i + 1]) for i in pairs]), _SCHEMA.types)], schema=_SCHEMA)


def compare_with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike the text is to that and to the next document.

    Documents are ordered by (doc_id, text), null ids first; the last is followed by the first. They are cut into ranges
    of that order, and a range also gets the first document of the one behind it, so each text is shuffled once.
    """
    base.set_up(docs.sparkSession)
    rows = base.documents(docs, doc_id, text).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("key")
    bounds = base.ordered_bounds(keys, "key", rows_per_range)
    ranges = keys.select("key", base.block_of("key", bounds).alias("range")).groupBy("range").agg(F.min("key").alias("first"))
    heads = [(r.range, r.first) for r in sorted(ranges.collect())]  # at most base.MAX_BLOCKS rows
    if not heads:
        return docs.sparkSession.createDataFrame([], COLUMNS)
    firsts = np.array([f for _, f in heads], dtype=np.int64)
    numbers = np.array([n for n, _ in heads], dtype=np.int64)
    rest = rows.mapInArrow(_to_ranges(firsts, numbers), "range int, guest boolean, key bigint, doc_id bigint, text string")
    inorder = rest.repartition("range").sortWithinPartitions("range", "guest", "key", "text")
    return inorder.select("range", "guest", "doc_id", "text").mapInArrow(_compare, COLUMNS)


def _to_ranges(firsts: np.ndarray, numbers: np.ndarray):
    """Each row with its range, and rows that may begin a range once more as guests of the range before it."""
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = np.searchsorted(firsts, keys, side="right") - 1
            guests = np.flatnonzero(firsts[at] == keys)
            take = np.concatenate((np.arange(len(keys)), guests))
            where = np.concatenate((numbers[at], numbers[at[guests] - 1]))
            flag = np.arange(len(take)) >= len(keys)
            more = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array(flag), more.column("key"), more.column("doc_id"), more.column("text")],
                names=["range", "guest", "key", "doc_id", "text"])
    return run
