"""Phrase collocations by SETM: relations of occurrences, joined by piece and position, counted, and cut to the frequent groups.

The relation of length 1 has a row for each text: the places of its frequent words, ascending, and their ids. Places count the words
of a text and one more at each change of piece, so neighbours in a piece are those whose places differ by one. A relation of
length k has the places and ids of frequent phrases beside the words in reach of them. Each round merge-joins
it with the words at the next place, counts the groups (phrase, word) in tasks and then over all, and semi-joins the occurrences
with the groups that are frequent, whose numbers are the ids of the next relation. Every relation is a written table.

The frequent groups are looked up in the tasks up to ``IN_TASKS`` of them; beyond that the occurrences meet them in a shuffled join
and are put together again by text. Both give the same relation.

Defined results: null texts are empty; null languages are ``und``; repeated rows count each; ids are not read; further columns are
ignored; without a frequent phrase, or without rows, there is no row. Counts are of whole pieces, scores are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoveil.llm import base

#: Words of the longest phrase, and occurrences that make a group frequent.
LONGEST = 5
LEAST = 100
#: Phrases reported of each language.
MOST = 2000
#: Frequent groups that tasks hold (16 bytes each, and the spelling of words).
IN_TASKS = 2_000_000
#: Occurrences whose groups a task counts together before it passes them on.
_TOGETHER = 1_500_000

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_BREAK = np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
_GAP = np.isin(np.arange(256), list(b" \t"))


def occurrences(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch, the code and place of each occurrence, and where each text begins among the occurrences."""
    data, offsets = base.utf8(texts)
    data = _LOWER[data]
    stop = _BREAK[data]
    apart = stop | _GAP[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = apart[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = np.flatnonzero(first & ~apart)
    packed = data[~apart]
    inside = np.cumsum(~apart, dtype=np.int32)
    starts = np.append(inside[begins] - 1, len(packed)).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(packed))
    ends = np.searchsorted(begins, offsets)
    piece = np.cumsum(stop, dtype=np.int32)[begins] if len(begins) else np.zeros(0, np.int64)
    changes = np.concatenate(([0], np.cumsum(np.diff(piece) > 0))) if len(begins) else piece
    place = np.arange(len(begins)) + changes
    inside = ends[:-1][np.diff(ends) > 0]  # the first word of each text that has one
    place = place - np.repeat(place[inside], np.diff(ends)[np.diff(ends) > 0])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), place, ends


def _languages(batch: pa.RecordBatch):
    """The batch by language: (language, its texts)."""
    coded = batch["lang"].dictionary_encode()
    codes = coded.indices.to_numpy()
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, batch["text"].filter(pa.array(codes == i)), codes == i


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their counts."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(np.concatenate(counts)[order], first)


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and its occurrences; the row of each language without a word has all of them."""
    kind = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def tally(batches):
        parts, rows, totals = [], 0, {}

        def merged():
            return pa.concat_tables(parts).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])
        for batch in batches:
            for lang, texts, _ in _languages(batch):
                words, codes, _, _ = occurrences(texts)
                totals[lang] = totals.get(lang, 0) + len(codes)
                parts.append(pa.table([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()),
                                       pa.array(np.bincount(codes, minlength=len(words)))], ["lang", "word", "n"]))
                rows += len(words)
            if rows > _TOGETHER:
                parts = [merged()]
                rows = len(parts[0])
                if rows > _TOGETHER // 2:
                    yield from parts[0].cast(kind).to_batches(65_536)
                    parts, rows = [], 0
        if parts:
            yield from merged().cast(kind).to_batches(65_536)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()),
                                              pa.array(list(totals.values()), pa.int64())], schema=kind)

    return docs.mapInArrow(tally, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(), offsets - offsets[0]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def _spread(place: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all texts on one axis, further apart between texts than any phrase is long."""
    sizes = np.diff(ends)
    widths = np.zeros(len(sizes), dtype=np.int64)
    full = sizes > 0
    widths[full] = place[ends[1:][full] - 1] + LONGEST + 1
    return place + np.repeat(np.cumsum(widths) - widths, sizes)


#: block, places and ids of words, and in relations beyond the first, whose phrases are its words, places and ids of phrases.
_FIRST = "block bigint, place array<int>, word array<int>"
_RELATION = f"{_FIRST}, at array<int>, phrase array<int>"


def _first(docs: DataFrame, words: DataFrame, in_tasks: int) -> DataFrame:
    """The relation of length 1 from (lang, word, rank)."""
    if words.count() <= in_tasks:
        held = docs.sparkSession.sparkContext.broadcast(words.select("lang", "word", "rank").toArrow())

        def keep(batches):
            index: dict[str, dict[str, int]] = {}
            table = held.value
            for lang, word, rank in zip(table["lang"].to_pylist(), table["word"].to_pylist(), table["rank"].to_pylist()):
                index.setdefault(lang, {})[word] = rank
            for batch in batches:
                for lang, texts, which in _languages(batch):
                    known = index.get(lang)
                    if not known:
                        continue
                    distinct, codes, place, ends = occurrences(texts)
                    ids = np.array([known.get(w, -1) for w in distinct.to_pylist()], dtype=np.int64)
                    of = ids[codes] if len(codes) else np.zeros(0, np.int64)
                    kept = of >= 0
                    ends = np.concatenate(([0], np.cumsum(kept)))[ends]
                    yield pa.RecordBatch.from_arrays([batch["block"].filter(pa.array(which)), _lists(place[kept], ends), _lists(of[kept], ends)],
                                                     ["block", "place", "word"])
        return docs.mapInArrow(keep, _FIRST).filter(F.size("word") > 1)

    def split(batches):
        for batch in batches:
            for lang, texts, which in _languages(batch):
                distinct, codes, place, ends = occurrences(texts)
                yield pa.RecordBatch.from_arrays([
                    batch["block"].filter(pa.array(which)), pa.array([lang] * len(texts), pa.string()), _lists(place, ends),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), distinct.cast(pa.string()).take(pa.array(codes)))],
                    ["block", "lang", "place", "words"])
    rows = docs.mapInArrow(split, "block bigint, lang string, place array<int>, words array<string>")
    rows = rows.select("block", "lang", F.explode(F.arrays_zip("place", "words")).alias("o")).select(
        "block", "lang", F.col("o.place").alias("place"), F.col("o.words").alias("word"))
    met = rows.join(words.select("lang", "word", F.col("rank").cast("int").alias("id")), ["lang", "word"])
    runs = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("r"))
    return runs.select("block", F.col("r.place").alias("place"), F.col("r.id").alias("word")).filter(F.size("word") > 1)


def _joined(batch: pa.RecordBatch, length: int):
    """Merge-join of phrases of ``length`` - 1 words with the words right behind them.

    Keys of the pairs, the phrase's index in the batch, and both relations on one axis: (words, their places, ends; places, ends).
    """
    place, ends = _flat(batch["place"])
    word, _ = _flat(batch["word"])
    at, at_ends = _flat(batch["at"]) if length > 2 else (place, ends)
    phrase = _flat(batch["phrase"])[0] if length > 2 else word
    axis = _spread(place.astype(np.int64), ends)
    shift = axis[ends[:-1].clip(max=max(len(axis) - 1, 0))] - place[ends[:-1].clip(max=max(len(place) - 1, 0))] if len(place) else np.zeros(0)
    start = at + np.repeat(shift, np.diff(at_ends)).astype(np.int64)
    wanted = start + length - 1
    found = np.searchsorted(axis, wanted)
    there = found < len(axis)
    there[there] = axis[found[there]] == wanted[there]
    keys = phrase[there].astype(np.int64) << 32 | word[found[there]]
    return keys, np.flatnonzero(there), (word, place, axis, ends), (at, start, at_ends)


def _group_counts(relation: DataFrame, length: int, least: int) -> DataFrame:
    """Frequent groups of ``length`` words: key (phrase id, word id) and n."""
    def tally(batches):
        keys, counts, rows = [], [], 0
        for batch in batches:
            found, many = np.unique(_joined(batch, length)[0], return_counts=True)
            if not len(found):
                continue
            keys.append(found)
            counts.append(many)
            rows += len(found)
            if rows > _TOGETHER:
                key, n = _summed(keys, counts)
                keys, counts, rows = [key], [n], len(key)
                if rows > _TOGETHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                    keys, counts, rows = [], [], 0
        if rows:
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return relation.mapInArrow(tally, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keep(relation: DataFrame, groups: DataFrame, length: int, in_tasks: int) -> DataFrame:
    """The relation of ``length``: occurrences of ``groups`` (key, rank), and the words in their reach."""
    if groups.count() <= in_tasks:
        table = groups.select("key", "rank").toArrow().sort_by("key")
        held = relation.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["rank"].to_numpy()))

        def keep(batches):
            known, rank = held.value
            for batch in batches:
                keys, which, (word, place, axis, ends), (at, start, at_ends) = _joined(batch, length)
                found = np.searchsorted(known, keys)
                hit = found < len(known)
                hit[hit] = known[found[hit]] == keys[hit]
                which, found = which[hit], found[hit]
                at_ends = np.searchsorted(which, at_ends)
                begun = start[which]
                reach = np.searchsorted(begun, axis, "right") > np.searchsorted(begun, axis - LONGEST + 1)
                ends = np.concatenate(([0], np.cumsum(reach)))[ends]
                yield pa.RecordBatch.from_arrays([batch["block"], _lists(place[reach], ends), _lists(word[reach], ends),
                                                  _lists(at[which], at_ends), _lists(rank[found], at_ends)],
                                                 ["block", "place", "word", "at", "phrase"])
        return relation.mapInArrow(keep, _RELATION).filter(F.size("at") > 0)

    def spread(batches):
        for batch in batches:
            keys, which, _, (at, _, at_ends) = _joined(batch, length)
            block = np.repeat(np.arange(batch.num_rows), np.diff(at_ends))[which]
            yield pa.RecordBatch.from_arrays([batch["block"].take(pa.array(block)), pa.array(at[which].astype(np.int32)), pa.array(keys)],
                                             ["block", "at", "key"])
    met = relation.mapInArrow(spread, "block bigint, at int, key bigint").join(groups.select("key", F.col("rank").cast("int").alias("id")), "key")
    runs = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("r"))
    return relation.select("block", "place", "word").join(runs, "block").select(
        "block", "place", "word", F.col("r.at").alias("at"), F.col("r.id").alias("phrase"))


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, in_tasks: int = IN_TASKS,
            lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, size, phrase, head (its first words, but the last), tail (but the first) and n of all frequent words and phrases,
    and for each language a row of size 0 with all its occurrences. A written table. ``longest`` is at most ``LONGEST``.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    base.set_up(docs.sparkSession)
    rows = base.pick(docs, lang=(lang, "string"), text=(text, "string")).select(
        F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.monotonically_increasing_id().alias("block"))
    counted = base.written(_word_counts(rows).filter((F.col("n") >= least) | F.col("word").isNull()), "word-counts")
    words = base.ranked(counted.filter("word is not null"), [], ["lang", "word"], "frequent-words")
    out = counted.select("lang", F.when(F.col("word").isNull(), 0).otherwise(1).alias("size"), F.coalesce("word", F.lit("")).alias("phrase"),
                         F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail"), "n")
    relation = base.written(_first(rows, words, in_tasks), "occurrences-1")
    names = words.select("lang", F.col("rank").alias("last"), F.col("word").alias("name"))
    known = words.select("lang", "rank", F.col("word").alias("phrase"))
    for length in range(2, longest + 1):
        groups = base.ranked(base.written(_group_counts(relation, length, least), f"groups-{length}"), [], ["key"], f"frequent-{length}")
        named = groups.select("rank", "n", F.shiftright("key", 32).alias("before"), F.col("key").bitwiseAND(2 ** 32 - 1).alias("last"))
        named = named.join(known.select("lang", F.col("rank").alias("before"), F.col("phrase").alias("head")), "before").join(
            names.drop("lang"), "last")
        named = base.written(named.select("lang", "rank", "head", F.concat_ws(" ", "head", "name").alias("phrase"), "n"), f"phrases-{length}")
        out = out.unionByName(named.select("lang", F.lit(length).alias("size"), "phrase", "head",
                                           F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("tail"), "n"))
        if named.isEmpty():
            break
        if length < longest:
            after = base.written(_keep(relation, groups, length, in_tasks), f"occurrences-{length}")
            base.discard(relation)
            relation, known = after, named.select("lang", "rank", "phrase")
    base.discard(relation)
    return base.written(out, "phrases")


def collocations(docs: DataFrame, most: int = MOST, **options) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase scores as its weakest cut, floor(1000 a n / (l r)), and is left out if one word more, on either side, occurs as often: the
    counts of longer phrases fall, so no longer one needs a look.
    """
    found = phrases(docs, **options)
    totals = found.filter("size = 0").select("lang", F.col("n").alias("total"))
    larger = found.filter("size > 2")
    larger = larger.select("lang", F.col("head").alias("phrase"), "n").unionByName(larger.select("lang", F.col("tail").alias("phrase"), "n"))
    larger = larger.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    candidates = found.filter("size > 1").join(larger, ["lang", "phrase"], "left").filter("longer is null or longer < n")
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.expr("array_join(slice(split(phrase, ' '), k + 1, 5), ' ')").alias("right"))
    parts = found.filter("size > 0").select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(cast(1000 * cast(a as decimal(17, 0)) as decimal(20, 0)) * cast(total as decimal(17, 0)) as decimal(38, 0)) "
                   "div cast(cast(l as decimal(19, 0)) * cast(r as decimal(18, 0)) as decimal(38, 0))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
