"""Byte-level BPE: encoding by folding ranked merges over the bytes of distinct words, decoding by joining the pieces' bytes.

A word (a match of the pattern) starts as its bytes. ``aggregate`` folds one merge a step: of all neighbours whose joined bytes have a
rank, those of the least rank, the leftmost first, become one piece, until none has. The ranks are one literal, a map of hexadecimal
pieces cut into an array of small maps, since a map is searched from its beginning. Boundaries between pieces are the bits of a long,
so a step writes one short array.

Words that occur often are folded once: all matches of all documents are counted, the ``remembered`` most frequent ones are encoded as
a table of distinct words, and tasks look them up. That table has a proven bound and goes to the workers; a word beyond it is folded
where it occurs, by the same expression, so the bound changes no id. Words of more than 60 bytes have too many bits for that fold (and it
would take the square of their length): the worker merges them from a heap, in the same order.

Defined results: a null or empty text has no ids; ids are kept as they are, nulls and repeated rows included; further columns are
ignored; an empty table gives no rows. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base

#: Longest word, in bytes, whose boundaries fit into a long.
LONGEST = 60
#: Distinct words of at most LONGEST bytes that the workers hold (some 50 bytes each).
REMEMBERED = 1_500_000
#: Words and counts that a task holds before it adds them up, and passes them on if half as many are left.
COUNTED = 600_000
#: Bytes of an Arrow batch: a task has two workers at a time, and each takes some thirty times as much for one batch, which it keeps.
BATCH_BYTES = "256k"
#: Ids whose pieces are joined at a time: the places of their bytes take many times as much as the bytes.
JOINED = 16_384
#: Small maps that the rank map is cut into, a power of two: a rank or two in each, as a map is searched from its beginning.
_MAPS = 32_768
#: Stands for no rank, and is as long as any rank is written: with a comma, 8 bytes a cell.
_NONE = "9999999"
_CELL_BITS = 3
_IDS = "array<int>"
_vocabularies: dict[str, dict[bytes, int]] = {}


def public_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks, which are also their ids."""
    if path not in _vocabularies:
        with open(path, "rb") as lines:
            _vocabularies[path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return _vocabularies[path]


def let(value: Column, body, kind: str) -> Column:
    """``body``, of the type ``kind``, of a value that is computed once. An aggregation, unlike a transformation, copies no result."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def rank_map(path: str) -> Column:
    """The literal: an array of maps from hexadecimal pieces to ranks, written with as many digits as ``_NONE``, in bytes."""
    maps: list[dict] = [{} for _ in range(_MAPS)]
    for piece, rank in ranks(path).items():
        maps[zlib.crc32(piece.hex().encode()) % _MAPS][piece.hex()] = base64.b64encode(b"%0*d" % (len(_NONE), rank)).decode()
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,binary>>")


def encode_word(word: Column, path: str) -> Column:
    """Ids of a word of at most ``LONGEST`` bytes.

    The ranks at its byte boundaries are cells of a binary, so that finding the least is a string function and writing three of
    them copies bytes (places in a string are found by counting its characters); the boundaries that are left are the bits of a long.
    """
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
    highest = lambda bits: F.length(F.bin(bits)) - 1
    lowest = lambda bits: F.bit_count(bits.bitwiseAND(-bits) - 1).cast("int")
    wide, none, state_kind = 1 << _CELL_BITS, F.lit(_NONE.encode()), "struct<cells:binary,cuts:bigint,least:string>"

    def whole(args: Column) -> Column:
        table, text = args["ranks"], args["text"]
        rank = lambda piece: F.get(table, F.crc32(piece).bitwiseAND(_MAPS - 1).cast("int"))[piece.cast("string")]
        cell = lambda piece: F.coalesce(rank(piece), none)
        size = F.shiftright(F.length(text), 1)
        part = lambda a, b: F.substring(text, a * 2 + 1, (b - a) * 2)
        least = lambda cells: F.array_min(F.split(cells.cast("string"), ","))
        write = lambda cells, at, value: F.overlay(cells, value, at * wide - (wide - 1), F.lit(wide - 1))

        def step(state, _):
            found = F.shiftright(F.instr(state["cells"].cast("string"), state["least"]) + (wide - 1), _CELL_BITS)
            return F.when(state["least"] >= _NONE, state).otherwise(let(found, lambda at: without(state, at), state_kind))

        def without(state, at):
            """Boundary ``at`` goes: the boundaries to its left and right stand between other pieces now."""
            left = highest(state["cuts"].bitwiseAND(bit(at) - 1))
            right = lowest(state["cuts"].bitwiseAND(-bit(at + 1)))
            return let(F.struct(at.alias("at"), left.alias("a"), right.alias("b")), lambda e: between(state, e), state_kind)

        def between(state, e):
            at, a, b = e["at"], e["a"], e["b"]
            before = lambda: cell(part(highest(state["cuts"].bitwiseAND(bit(a) - 1)), b))
            after = lambda: cell(part(a, lowest(state["cuts"].bitwiseAND(-bit(b + 1)))))
            gone = write(state["cells"], at, none)
            left = F.when(a > 0, write(gone, a, before())).otherwise(gone)
            cells = let(left, lambda cells: F.when(b < size, write(cells, b, after())).otherwise(cells), "binary")
            return let(cells, lambda cells: F.struct(
                cells.alias("cells"), (state["cuts"] - bit(at)).alias("cuts"), least(cells).alias("least")), state_kind)

        inner = F.slice(F.sequence(F.lit(0), size), F.lit(1), F.greatest(size - 1, F.lit(0)))
        cells = F.array_join(F.transform(inner, lambda i: cell(part(i, i + 2)).cast("string")), ",").cast("binary")
        start = let(cells, lambda c: F.struct(
            c.alias("cells"), (bit(size + 1) - 1).alias("cuts"), F.when(size > 1, least(c)).otherwise(F.lit(_NONE)).alias("least")), state_kind)
        cuts = F.aggregate(inner, start, step, lambda state: state["cuts"])
        places = lambda bits: F.filter(F.sequence(F.lit(0), size), lambda i: F.getbit(bits, i) == 1)
        return let(let(cuts, places, _IDS), lambda at: F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1), lambda a, i: rank(part(a, F.get(at, i + 1))).cast("string").cast("int")), _IDS)
    text = F.lower(F.hex(word.cast("binary"))).cast("binary")
    return let(F.struct(rank_map(path).alias("ranks"), text.alias("text")), whole, _IDS)


def merge(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the least rank first, then the leftmost, from a heap."""
    ends, before, alive = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), [True] * len(word)
    heap: list = []

    def offer(a: int) -> None:
        b = ends[a]
        if b < len(word):
            rank = table.get(word[a:ends[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, ends[b]))
    for a in range(len(word)):
        offer(a)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not alive[a] or ends[a] != b or ends[b] != end or not alive[b]:
            continue
        alive[b], ends[a] = False, end
        if end < len(word):
            before[end] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < len(word):
        out.append(table[word[a:ends[a]]])
        a = ends[a]
    return out


# Fixed values of the public pattern: what a contraction may be, and white space.
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def _class_of() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    if not _classes:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = 1 if kind == "L" else 2
        table[_SPACES] = 3
        _classes.append(table)
    return _classes[0]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Matches of the public pattern in every text of a batch, one after another, and where each text begins among them.

    The matches tile a text, so only their beginnings are sought: where the class of characters changes, but for a space that goes
    with what follows; before the last of several white spaces that something follows; and around a contraction.
    """
    data, offsets = base.utf8(column)
    offsets = offsets.astype(np.int64)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    table = _class_of()
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at]
    code = first.astype(np.int32)
    for low, size, bits in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        which = np.flatnonzero((first >= low) & (first < (0xE0, 0xF0, 0x100)[size - 2]))
        if len(which):
            value = (first[which] & bits).astype(np.int32)
            for k in range(1, size):
                value = value << 6 | (data[at[which] + k] & 0x3F)
            code[which] = value
    kind = table[code]
    begin = np.zeros(len(at) + 1, dtype=bool)  # of a text, in characters
    begin[np.searchsorted(at, offsets)] = True
    space = kind == 3
    follows = np.zeros(len(at), dtype=bool)  # the next character is of the same text and no white space
    follows[:-1] = ~space[1:] & ~begin[1:-1]
    start = begin[:-1].copy()
    changes = kind[1:] != kind[:-1]
    start[1:] |= np.where(space[1:], ~space[:-1] | follows[1:], changes & (code[:-1] != 0x20))
    quotes = np.flatnonzero(start & (code == 0x27))
    for letters in _CONTRACTIONS:
        hit = quotes[quotes + len(letters) < len(at)]
        for k, letter in enumerate(letters, 1):
            hit = hit[(code[hit + k] == letter) & ~begin[hit + k]]
        start[hit + 1] = False
        rest = hit + len(letters) + 1
        start[rest[rest < len(at)]] = True
    starts = at[start]
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
    return flat, np.searchsorted(starts, offsets)


def _added(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of all parts and the sums of their counts: words become numbers once, and counts are added by number."""
    words = pa.concat_arrays([words for words, _ in parts]).dictionary_encode()
    counts = np.concatenate([counts for _, counts in parts])
    sums = np.zeros(len(words.dictionary), dtype=np.int64)
    np.add.at(sums, words.indices.to_numpy(), counts)
    return words.dictionary, sums


def _counts(docs: DataFrame) -> DataFrame:
    """How often every distinct word occurs; counted within tasks before the shuffle."""
    def tally(batches):
        parts, rows = [], 0

        def passed(words, counts):
            for i in range(0, len(words), 65_536):
                yield pa.RecordBatch.from_arrays([words.slice(i, 65_536).cast(pa.string()), pa.array(counts[i:i + 65_536])], ["word", "n"])
        for batch in batches:
            found = pc.value_counts(split_words(batch["text"])[0])
            parts.append((found.field("values"), found.field("counts").to_numpy()))
            rows += len(found)
            if rows > COUNTED:
                parts = [_added(parts)]
                rows = len(parts[0][0])
                if rows > COUNTED // 2:
                    yield from passed(*parts[0])
                    parts, rows = [], 0
        if parts:
            yield from passed(*_added(parts))

    return docs.select("text").mapInArrow(base.released(tally), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """At most ``most`` of the distinct words: all that occur as often as a threshold, found from the counts of all of them."""
    short = F.octet_length("word") <= LONGEST
    counts = base.written(_counts(docs).filter(short), "word-counts")
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")))).cast("bigint"))
    sizes = sorted(((r.least, r.words) for r in counts.groupBy(step.alias("least")).agg(F.count("*").alias("words")).collect()), reverse=True)
    taken, threshold = 0, None
    for least, words_there in sizes:
        if taken + words_there > most:
            break
        taken, threshold = taken + words_there, least
    kept = counts.filter(F.col("n") >= threshold) if threshold is not None else counts.limit(0)
    kept._scratch = counts._scratch
    return kept


def _by_hash(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Remembered words in the order of their hashes: hashes, words, and where the ids of each begin among all ids."""
    words, ids = table["word"].combine_chunks(), table["ids"].combine_chunks()
    del table  # the driver holds each column twice at most
    hashes = np.concatenate([base.hash_words(words.slice(i, 100_000)) for i in range(0, max(1, len(words)), 100_000)])
    order = pa.array(np.argsort(hashes))
    words = words.take(order)
    ids = ids.take(order) if len(words) else pa.array([], pa.list_(pa.int32()))
    values = ids.values.to_numpy()
    return hashes[order], words, ids.offsets.to_numpy(), values.astype(np.uint16 if values.max(initial=0) < 1 << 16 else np.int32)


def _find(hashes: np.ndarray, known: pa.Array, words: pa.Array) -> np.ndarray:
    """Place of each word, found by its hash and compared with its bytes; -1 if it is not remembered."""
    if not len(hashes) or not len(words):
        return np.full(len(words), -1, dtype=np.int64)
    at = np.searchsorted(hashes, base.hash_words(words)).clip(max=len(hashes) - 1)
    return np.where(pc.equal(known.take(pa.array(at)), words.cast(pa.string())).to_numpy(zero_copy_only=False), at, -1)


def encode(docs: DataFrame, path: str | None = None, remembered: int = REMEMBERED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids`` of every text. ``remembered`` bounds the words that are folded once, and changes no id."""
    spark = base.set_up(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = path or public_ranks()
    rows = base.documents(docs, doc_id, text)
    known = frequent(rows, remembered)
    folded = base.written(known.select("word", encode_word(F.col("word"), path).alias("ids")), "word-ids")
    held = spark.sparkContext.broadcast(_by_hash(folded.toArrow()))
    base.discard(known, folded)
    pa.default_memory_pool().release_unused()

    def look_up(batches):
        hashes, known, starts, ids = held.value
        for batch in batches:
            flat, ends = split_words(batch["text"])
            coded = flat.dictionary_encode()
            distinct, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            place = _find(hashes, known, distinct)
            new = place < 0
            long = new & (pc.binary_length(distinct).to_numpy() > LONGEST)
            own = {i: merge(distinct[i].as_py().encode(), ranks(path)) for i in np.flatnonzero(long).tolist()}
            sizes = np.where(new, 0, starts[place + 1] - starts[place]).astype(np.int64) if len(starts) > 1 else np.zeros(len(place), np.int64)
            first = np.where(new, 0, starts[place]).astype(np.int64) if len(starts) > 1 else np.zeros(len(place), np.int64)
            pool = [ids]
            for i, found in own.items():
                first[i], sizes[i] = sum(map(len, pool)), len(found)
                pool.append(np.array(found, dtype=np.int32))
            pool = np.concatenate(pool) if own else ids
            lengths = sizes[codes]
            after = np.concatenate(([0], np.cumsum(lengths)))
            out = pool[np.repeat(first[codes] - after[:-1], lengths) + np.arange(after[-1])].astype(np.int32)
            # A part ends at each word that is still to be folded, and at the end of each text.
            open_at = np.flatnonzero((new & ~long)[codes])
            places = np.concatenate([ends[1:], open_at])
            order = np.lexsort((np.repeat([0, 1], [len(ends) - 1, len(open_at)]), places))
            word = np.concatenate([np.full(len(ends) - 1, -1), codes[open_at]])[order]
            parts = pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], after[places[order]])).astype(np.int32)), pa.array(out)),
                distinct.take(pa.array(word, mask=word < 0)).cast(pa.string())], ["ids", "word"])
            texts = np.concatenate(([0], np.flatnonzero(order < len(ends) - 1) + 1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(texts.astype(np.int32)), parts)], ["doc_id", "parts"])

    found = rows.mapInArrow(base.released(look_up), f"doc_id bigint, parts array<struct<ids:{_IDS},word:string>>")
    whole = F.flatten(F.transform("parts", lambda p: F.when(p.word.isNull(), p.ids).otherwise(F.concat(p.ids, encode_word(p.word, path)))))
    return found.select("doc_id", whole.alias("ids"))


class _Pieces:
    """Byte strings by id, laid out one after another; an id that has none has the empty one."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([*map(len, pieces), 0], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of ``ids``, one after another, and where each begins, plus the end."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes) - 1), ids, len(self.sizes) - 1)
        after = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        data = np.empty(after[-1], dtype=np.uint8)
        for i in range(0, len(ids), JOINED):
            part, ends = ids[i:i + JOINED], after[i:i + JOINED + 1]
            places = np.repeat(self.first[part] - ends[:-1], self.sizes[part])
            data[ends[0]:ends[-1]] = self.data[places + np.arange(ends[0], ends[-1])]
        return data, after


def _pieces_of(path: str) -> _Pieces:
    table = ranks(path)
    pieces = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece
    return _Pieces(pieces)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, one list after another, and where each list begins."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(), offsets - offsets[0]


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that ids stand for: their pieces, one after another."""
    path = path or public_ranks()

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        flat, ends = _flat(column)
        data, after = _pieces_of(path).joined(flat)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [
            None, pa.py_buffer(after[ends].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
    return joined(ids)


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Number and hash of the ids of each text, and hash of the bytes they decode to."""
    path = path or public_ranks()

    def run(batches):
        pieces = _pieces_of(path)
        numbers = _Pieces([b"%d " % i for i in range(len(pieces.sizes) - 1)])
        for batch in batches:
            flat, ends = _flat(batch["ids"])
            text, text_ends = numbers.joined(flat)
            data, data_ends = pieces.joined(flat)
            text, data, a, b = memoryview(text), memoryview(data), text_ends[ends].tolist(), data_ends[ends].tolist()
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(text[x:max(x, y - 1)]).hexdigest() for x, y in zip(a, a[1:])], pa.string()),
                pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(b, b[1:])], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(base.released(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
