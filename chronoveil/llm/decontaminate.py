"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and lose everything but letters and digits; of scripts without spaces each letter is a word. A mask
takes some words of a stretch and ignores the others, so a passage with substituted words still has equal hashes where the
substitutions fall on ignored places. Hashes of the benchmark meet those of the corpus; each meeting fixes how item and
document lie on each other, and there the two are compared word by word: any stretch with ``LEAST`` matching words (of
shorter items four fifths) of which four fifths of the words match is an overlap, and the one with the most matching words
is given.

Long items, of ``LONG`` words or more, are hashed by ``MASKS`` at every place: 13 words on end, or 14, 15 and 16 words with 1, 2
and 3 substitutions are always found; a longer passage would be lost if its substitutions fell on all masks at all places.
Items of 8 to 15 words have masks of their own size, enough that none that meets the rule is lost, also where the document
begins or ends within it. Items of fewer words are found only where all their words stand one after another, so an item of
one word overlaps with every document that has it.

Up to ``SEEDS_IN_TASKS`` benchmark hashes are sent to the tasks, which then need no shuffle; a larger benchmark meets the
corpus in a shuffled join by hash, where distinct texts are compared and the overlaps joined back to every row. Both give
the same rows; where an item lies on a document in several ways, the most matching words count, then the smallest shift.

Defined results: null texts have no words; null and repeated document ids give rows of their own; repeated items count
once for each item id, and different texts under one item id are items of their own; no result row where nothing
overlaps; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base

#: Long items have ``LONG`` words or more. The places that each of their masks looks at.
LONG = 16
MASKS = ((0, 1, 3, 6, 8, 9, 11), (0, 2, 3, 5, 7, 10, 11), (0, 1, 2, 5, 8, 10, 11), (0, 1, 2, 4, 6, 7, 8), (0, 1, 2, 3, 5, 9, 10),
         (0, 1, 3, 7, 8, 9, 10))
#: Items of fewer words than this must be there word by word.
SPACED = 8
SHORTEST = 1
LEAST = 13
SHARE = 0.8
SEEDS_IN_TASKS = 1_000_000
_FILTER_BITS = 22
#: Scripts without spaces between words: each letter counts as a word.
_UNSEGMENTED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def needed(size: int) -> int:
    return size if size < SPACED else min(LEAST, int(np.ceil(SHARE * size)))


def short_masks(size: int) -> list[tuple[int, ...]]:
    """Places of the masks of items of ``size`` words: whichever words differ, as many as may, one mask looks at none of them."""
    differ = size - needed(size)
    groups = differ + 2 if differ else 1
    return [tuple(p for p in range(size) if p % groups in looked) for looked in combinations(range(groups), groups - differ)]


#: All masks, those of short items behind the spaced ones of long items: (number, size of the items or 0 for long ones, first
#: place looked at, places from there on).
ALL_MASKS = tuple((k, size, places[0], tuple(p - places[0] for p in places)) for k, (size, places) in enumerate(
    [(0, m) for m in MASKS] + [(n, m) for n in range(SHORTEST, LONG) for m in short_masks(n)]))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and where each text begins."""
    dictionary, codes, offsets = base.words(column)
    plain = pc.replace_substring_regex(pc.utf8_lower(dictionary), r"[^\p{L}\p{N}]+", "")
    if pc.any(pc.match_substring_regex(plain, _UNSEGMENTED)).as_py():
        parts, part, at = base.words(pc.replace_substring_regex(plain, f"({_UNSEGMENTED})", r" \1 "))
        sizes = np.diff(at)[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return base.hash_words(parts)[part[np.repeat(at[:-1][codes] - ends[:-1], sizes) + np.arange(ends[-1])]], ends[offsets]
    real = pc.not_equal(plain, "").to_numpy(zero_copy_only=False).astype(bool)
    keep = real[codes]
    return base.hash_words(plain)[codes[keep]], np.concatenate(([0], np.cumsum(keep)))[offsets]


def seed_hashes(words: np.ndarray, number: int, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words that the mask looks at, for every place where the stretch begins."""
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(number * 2 + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, p in enumerate(places):
            total += words[p:p + n] * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
        return base.mix(total)


def seeds_of(words: np.ndarray, offsets: np.ndarray, items: bool, numbers: set[int] | None = None):
    """(mask, text, place, hash) of all texts: of items by the masks of their size, of documents by those of ``numbers``.

    The place of an item is where the stretch that the mask looks at begins.
    """
    sizes = np.diff(offsets)
    out = []
    for number, size, first, places in ALL_MASKS:
        if numbers is not None and number not in numbers:
            continue
        if items and size:
            text = np.flatnonzero(sizes == size)
            at = offsets[text] + first
            hashes = seed_hashes(words, number, places) if len(text) else None
        else:
            hashes = seed_hashes(words, number, places)
            at = np.arange(len(hashes))
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + places[-1] < offsets[text + 1]
            if items:
                inside &= sizes[text] >= LONG
            at, text = at[inside], text[inside]
        if len(at):
            out.append((np.full(len(at), number), text, at - offsets[text], hashes[at]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]


def best_overlap(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first word in the text, words, matching words) of the best stretch where ``item[i]`` lies on ``text[i + shift]``.

    That is the one with the most matching words among those of which four fifths match, the first of equal ones. It begins
    and ends with a match.
    """
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    if high <= low:
        return None
    same = item[low:high] == text[low + shift:high + shift]
    if int(same.sum()) < needed(len(item)):
        return None
    # Four fifths match where the sum of 1 for a match and -4 for a substitution is not negative. For each end, the earliest
    # begin with that has the most matches: the first place where the lowest sum so far is no higher than at the end.
    run = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    begins = np.searchsorted(-np.minimum.accumulate(run), -run, side="left")
    count = np.concatenate(([0], np.cumsum(same)))
    matches = count - count[begins]
    stop = int(np.argmax(matches))
    if matches[stop] < needed(len(item)):
        return None
    begin = int(begins[stop])
    begin += int(np.argmax(same[begin:stop]))
    return low + begin + shift, stop - begin, int(matches[stop])


@dataclass
class Benchmark:
    """Items with their words, and their seeds ordered by hash."""
    ids: list
    words: np.ndarray
    offsets: np.ndarray
    mask: np.ndarray
    item: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    numbers: set[int]

    @classmethod
    def of(cls, rows: list) -> "Benchmark":
        words, offsets = word_hashes(pa.array([r[1] for r in rows], pa.large_string()))
        mask, item, place, hashes = seeds_of(words, offsets, items=True)
        order = np.argsort(hashes, kind="stable")
        return cls([r[0] for r in rows], words, offsets, mask[order], item[order], place[order], hashes[order], set(mask.tolist()))

    def own(self, item: int) -> np.ndarray:
        return self.words[self.offsets[item]:self.offsets[item + 1]]

    def meetings(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct (text, item, shift) where hashes of texts and items are equal."""
        flags = np.zeros(1 << _FILTER_BITS, dtype=bool)
        flags[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        found = []
        for number, _, _, places in ALL_MASKS:
            if number not in self.numbers:
                continue
            hashes = seed_hashes(words, number, places)
            at = np.flatnonzero(flags[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(self.hashes, hashes[at], side="left")
            many = np.searchsorted(self.hashes, hashes[at], side="right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            if not len(at):
                continue
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + places[-1] < offsets[text + 1]
            at, text, low, many = at[inside], text[inside], low[inside], many[inside]
            seed = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum())) if len(many) else low
            row = np.repeat(np.arange(len(at)), many)
            found.append(np.stack((text[row], self.item[seed], at[row] - offsets[text[row]] - self.place[seed]), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def overlaps(self, column: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The best verified overlap of each (text, item) of a batch: the most matching words, then the smallest shift."""
        words, offsets = word_hashes(column)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, shift in self.meetings(words, offsets).tolist():
            found = best_overlap(self.own(item), words[offsets[text]:offsets[text + 1]], shift)
            if found and found[2] > best.get((text, item), (0, 0, 0))[2]:
                best[text, item] = found
        return best


COLUMNS = "doc_id bigint, item_id bigint, first_word bigint, words bigint, matches bigint"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "first_word", "words", "matches")])


def _in_tasks(bench: Benchmark):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[t], bench.ids[i], *o) for (t, i), o in sorted(bench.overlaps(batch.column("text")).items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA)
    return run


def _seed_rows(items: bool, numbers: set[int] | None = None):
    schema = pa.schema([("mask", pa.int32()), ("address", pa.string()), ("place", pa.int64()), ("hash", pa.int64())])

    def run(batches):
        for batch in batches:
            words, offsets = word_hashes(batch.column("text"))
            mask, text, place, hashes = seeds_of(words, offsets, items, numbers)
            yield pa.RecordBatch.from_arrays([pa.array(mask, pa.int32()), batch.column("address").take(pa.array(text)),
                                              pa.array(place, pa.int64()), pa.array(hashes.view(np.int64))], schema=schema)
    return run


def _verify(batches):
    schema = pa.schema([("address", pa.string()), ("item_at", pa.string())] + [
        (n, pa.int64()) for n in ("shift", "first_word", "words", "matches")])
    for batch in batches:
        rows = []
        item_words, item_at = word_hashes(batch.column("item_text"))
        words, at = word_hashes(batch.column("text"))
        for k, (address, item, shift) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("address", "item_at", "shift")))):
            found = best_overlap(item_words[item_at[k]:item_at[k + 1]], words[at[k]:at[k + 1]], shift)
            if found:
                rows.append((address, item, shift, *found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _shuffled(rows: DataFrame, items: DataFrame) -> DataFrame:
    """address, item_at and the best overlap of each distinct document text with each distinct item text.

    ``rows`` and ``items`` have ``address`` and ``text``, repeated ones too.
    """
    kinds = "mask int, address string, place bigint, hash bigint"
    rows, items = rows.select("address", "text"), items.select("address", "text").distinct()
    right = items.mapInArrow(_seed_rows(True), kinds)
    numbers = {r.mask for r in right.select("mask").distinct().collect()}
    left = rows.mapInArrow(_seed_rows(False, numbers), kinds)
    met = left.alias("d").join(right.alias("b"), F.col("d.hash") == F.col("b.hash")).select(
        F.col("d.address").alias("address"), F.col("b.address").alias("item_at"),
        (F.col("d.place") - F.col("b.place")).alias("shift")).distinct()
    texts = rows.join(met.select("address").distinct(), "address", "left_semi").dropDuplicates(["address"])
    full = met.join(texts, "address").join(items.select(F.col("address").alias("item_at"), F.col("text").alias("item_text")), "item_at")
    checked = full.select("address", "item_at", "shift", "text", "item_text").mapInArrow(
        _verify, "address string, item_at string, shift bigint, first_word bigint, words bigint, matches bigint")
    best = checked.groupBy("address", "item_at").agg(
        F.max(F.struct("matches", (-F.col("shift")).alias("back"), "first_word", "words")).alias("b"))
    return best.select("address", "item_at", "b.first_word", "b.words", "b.matches")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return base.pick(benchmark, item_id=(item_id, "bigint"), text=(text, "string")).filter("text is not null").distinct()


def _small(items: DataFrame, most: int) -> Benchmark | None:
    """The benchmark for the tasks, if its seeds are no more than ``most``: words bound seeds, and bytes bound words."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if len(MASKS) * size / 2 > 16 * most:
        return None
    bench = Benchmark.of(sorted(((r.item_id, r.text) for r in items.collect()), key=lambda r: (r[0] is not None, r)))
    return bench if len(bench.hashes) <= most else None


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text", most: int = SEEDS_IN_TASKS) -> DataFrame:
    """doc_id, item_id and the best overlap: its first word in the document, its length and its matching words."""
    base.set_up(docs.sparkSession)
    rows, items = base.documents(docs, doc_id, text), _items(benchmark, item_id, item_text)
    bench = _small(items, most)
    if bench is not None:
        return rows.mapInArrow(_in_tasks(bench), COLUMNS)
    address = F.sha2(F.col("text").cast("binary"), 256)
    rows = rows.filter("text is not null").withColumn("address", address)
    items = items.withColumn("address", address)
    best = _shuffled(rows, items).join(items.select("item_id", F.col("address").alias("item_at")), "item_at")
    return rows.select("doc_id", "address").join(best, "address").select("doc_id", "item_id", "first_word", "words", "matches")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", most: int = SEEDS_IN_TASKS) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, in the columns of ``docs``."""
    base.set_up(docs.sparkSession)
    items = _items(benchmark, item_id, item_text)
    bench = _small(items, most)
    if bench is not None:
        @F.arrow_udf("boolean")
        def leaks(column: pa.Array) -> pa.Array:
            bad = np.zeros(len(column), dtype=bool)
            bad[[t for t, _ in bench.overlaps(column)]] = True
            return pa.array(bad)
        name = base.fresh(docs, "leaks")
        return docs.withColumn(name, leaks(F.col(text).cast("string"))).filter(~F.col(name)).select(*docs.columns)
    # Whether a text overlaps depends on the text alone: rows are matched by its address.
    address = base.fresh(docs, "address")
    keyed = docs.withColumn(address, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    rows = keyed.select(F.col(address).alias("address"), F.col(text).cast("string").alias("text")).filter("text is not null")
    bad = _shuffled(rows, items.withColumn("address", F.sha2(F.col("text").cast("binary"), 256)))
    return keyed.join(bad.select(F.col("address").alias(address)).distinct(), address, "left_anti").select(*docs.columns)
