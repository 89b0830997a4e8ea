"""Token ids in files: canonical length-limited Huffman codes from counts over the whole corpus.

A folder holds ``codebook`` (id, bits) and ``blocks``, Parquet tables whose ``payload`` is one independently coded block:
four bytes ``TID1``, then as little-endian 64-bit numbers the count of ids, the distance of checkpoints in ids and their
count, the bit offset at each checkpoint, and the code words, highest bit first. A block has whole documents, in
ascending doc_id order, and ``start`` ids come before it. Blocks are decoded by table look-up, all checkpoints of a block
in step, and none needs another.

Defined results: a null text is empty and has the end id alone; null ids come first, repeated ids stay next to each other;
an empty table gives an empty codebook and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoveil.llm import base, tokens
from chronoveil.session import scratch_path

END_ID = 2
MAX_BITS = 18
BLOCK_IDS = 65_536
CHECKPOINT = 128
ROWS_PER_RANGE = 2_000
MAGIC = b"TID1"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of each symbol's code word: optimal among prefix codes of at most ``limit`` bits (0: never used).

    Package-merge. Level by level, pairs of the cheapest items form packages that are merged with the symbols; then the
    first 2n - 2 items of the last level are opened again, and each level in which a symbol is taken is one bit of it.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, items = [], weight
    leaf = np.ones(n, dtype=bool)
    for _ in range(limit - 1):
        levels.append(leaf)
        even = items[:len(items) // 2 * 2]
        merged = np.concatenate((weight, even[0::2] + even[1::2]))
        at = np.argsort(merged, kind="stable")
        items, leaf = merged[at], at < n
    levels.append(leaf)
    taken = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:taken].sum())
        lengths[order[:leaves]] += 1
        taken = 2 * (taken - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order]
        top = int(bits.max())
        steps = np.uint64(1) << (top - bits).astype(np.uint64)
        begin = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps)[:-1])).astype(np.uint64)
        codes[order] = begin >> (top - bits).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every string of as many bits as the longest code word has, and that number of bits."""
    top = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (top - lengths[order])
    symbol = np.zeros(1 << top, dtype=np.uint32)
    length = np.ones(1 << top, dtype=np.uint8)
    filled = int(spans.sum())
    symbol[:filled] = np.repeat(order, spans)
    length[:filled] = np.repeat(lengths[order], spans)
    return symbol, length, top


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = CHECKPOINT) -> bytes:
    """One payload. Code words are set into 32-bit words; those that begin in the same word are summed."""
    bits = lengths[ids]
    ends = np.cumsum(bits)
    starts = ends - bits
    marks = starts[::every].astype("<u8")
    head = MAGIC + struct.pack("<QQQ", len(ids), every, len(marks)) + marks.tobytes()
    if not len(ids):
        return head
    word = starts >> 5
    shifted = codes[ids] << (64 - (starts & 31) - bits).astype(np.uint64)
    out = np.zeros((int(ends[-1]) >> 5) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return head + out.astype(">u4").tobytes()[:(int(ends[-1]) + 7) // 8]


def decode_block(payload: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of one payload: a step reads one id behind every checkpoint."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, every, marks = struct.unpack_from("<QQQ", payload, 4)
    at = np.frombuffer(payload, dtype="<u8", count=marks, offset=28).astype(np.int64)
    if not n:
        return np.zeros(0, np.uint32)
    data = np.concatenate((np.frombuffer(payload, dtype=np.uint8, offset=28 + 8 * marks), np.zeros(8 + 4 * every, np.uint8))).astype(np.uint32)
    window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    symbol, length, top = table
    out = np.empty((every, marks), dtype=np.uint32)
    drop = np.uint32(32 - top)
    for step in range(every):  # behind the last checkpoint there may be fewer ids: what is read there is cut off below
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> drop
        out[step] = symbol[key]
        at += length[key]
    return out.T.reshape(-1)[:n]


def _encode_texts(path: str, end_id: int, bounds: list[int]):
    schema = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder, cuts = tokens.word_encoder(path), np.array(bounds, dtype=np.int64)
        kind = "<u2" if max(encoder.vocabulary, end_id) < 1 << 16 else "<u4"
        for batch in batches:
            ids, offsets = encoder.encode(batch.column("text"))
            ids, end = ids.astype(kind), np.array([end_id], dtype=kind).tobytes()
            each = [ids[a:b].tobytes() + end for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            size = np.dtype(kind).itemsize
            keys = pc.fill_null(batch.column("doc_id"), -(2 ** 63)).to_numpy()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(cuts, keys).astype(np.int32)), batch.column("doc_id"), pa.array([len(x) // size for x in each], pa.int64()),
                pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())], schema=schema)
    return run


def _gather(batches):
    """Documents of a range, in order, into rows of about ``BLOCK_IDS`` ids; ``first`` counts the ids before a row in its range."""
    schema = pa.schema([("range", pa.int32()), ("first", pa.int64()), ("docs", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())), ("wide", pa.bool_()), ("ids", pa.binary())])
    now, first, docs, sizes, parts, held, wide = None, 0, [], [], [], 0, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
            (now, first, docs, sizes, wide, b"".join(parts)), schema.types)], schema=schema)
    for batch in batches:
        for part, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "n", "ids"))):
            if held and (part != now or held + n > BLOCK_IDS):
                yield row()
                first = first + held if part == now else 0
                docs, sizes, parts, held = [], [], [], 0
            elif part != now:
                first = 0
            now, wide = part, len(ids) == 4 * n
            docs.append(doc)
            sizes.append(n)
            parts.append(ids)
            held += n
    if held:
        yield row()


_GATHERED = "range int, first bigint, docs array<bigint>, sizes array<bigint>, wide boolean, ids binary"


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u4" if w else "<u2").astype(np.int64)
            for x, w in zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist())]


def _count(batches):
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for ids in _ids(batch):
            new = np.bincount(ids, minlength=len(counts))
            new[:len(counts)] += counts
            counts = new
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])


def _encode_blocks(lengths: np.ndarray, before: dict[int, int]):
    schema = pa.schema([("start", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        codes = canonical_codes(lengths)
        for batch in batches:
            start = [before[r] + f for r, f in zip(batch.column("range").to_pylist(), batch.column("first").to_pylist())]
            blocks = [encode_block(ids, lengths, codes) for ids in _ids(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), batch.column("docs"), batch.column("sizes"),
                                              pa.array(blocks, pa.binary())], schema=schema)
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, max_bits: int = MAX_BITS,
              rows_per_range: int = ROWS_PER_RANGE, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the folder ``path``."""
    spark = base.set_up(docs.sparkSession)
    rows = base.documents(docs, doc_id, text)
    bounds = base.ordered_bounds(rows.select("doc_id"), "doc_id", rows_per_range)
    ranged = rows.mapInArrow(base.released(_encode_texts(tokenizer or tokens.public_tokenizer(), end_id, bounds)),
                             "range int, doc_id bigint, n bigint, crc bigint, ids binary")
    inorder = ranged.repartition("range").sortWithinPartitions("range", "doc_id", "n", "crc").select("range", "doc_id", "n", "ids")
    gathered = base.written(inorder.mapInArrow(_gather, _GATHERED), "token-ids", compression="zstd")
    counts = gathered.select("ids", "wide").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()  # one row per id of the vocabulary at most
    table = np.zeros(max([r.id for r in found], default=-1) + 1, dtype=np.int64)
    for r in found:
        table[r.id] = r.n
    lengths = code_lengths(table, max(max_bits, int(len(table)).bit_length()))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    sums = gathered.select("range", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    sums = sums.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()  # at most base.MAX_BLOCKS rows
    before, total = {}, 0
    for r in sums:
        before[r["range"]] = total
        total += r.n
    coded = gathered.mapInArrow(_encode_blocks(lengths, before), "start bigint, docs array<bigint>, sizes array<bigint>, payload binary")
    coded.write.option("compression", "none").parquet(f"{path}/blocks")
    base.discard(gathered)


def _decode_blocks(lengths: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for start, docs, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("start", "docs", "sizes", "payload"))):
                ids = decode_block(payload, table).astype("<u4")
                ends = np.cumsum(sizes)
                if ends[-1] != len(ids):
                    raise ValueError(f"a block has {len(ids)} ids, its documents {ends[-1]}")
                begins = ends - sizes
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(start + begins), pa.array(sizes, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())], schema=schema)
    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit numbers) of every document of a folder."""
    base.set_up(spark)
    book = spark.read.schema("id bigint, bits int").parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(max([r.id for r in book], default=-1) + 1, dtype=np.int64)
    for r in book:
        lengths[r.id] = r.bits
    blocks = spark.read.schema("start bigint, docs array<bigint>, sizes array<bigint>, payload binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(_decode_blocks(lengths), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that have just been written."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_ids(docs, path, **options)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
