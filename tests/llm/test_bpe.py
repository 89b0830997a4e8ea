import hashlib
import random
import time
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import edge
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken
from chronoveil.llm import bpe
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.public_ranks()), special_tokens={})


def texts():
    rng = random.Random(4)
    kinds = [(32, 127), (32, 127), (0x80, 0x3000), (0x4E00, 0x9FFF), (0x1F300, 0x1F700)]
    odd = ["Hello  world's   we'll\n\n\n  x ", "中文字符测试，你好世界", "🙂🙂🙂 été", "a" * 3000, "".join(rng.choice("abcdefghij") for _ in range(900)),
           "x" * 60 + " " + "y" * 59 + " " + "z" * 61, "<|endoftext|>", "\t\ttabs\r\n", " " * 200 + "z", "\x00\x01\x1c\x1d\x1e\x1f\x85 q",
           " x  y​ z", "1234567 ١٢٣ Ⅷ ½"]
    made = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 50))) for _ in range(150)]
    return edge.texts() + [(100 + i, t) for i, t in enumerate(odd + made)]


@pytest.mark.parametrize("remembered", [1_000_000, 40, 0])
def test_equals_the_library(spark, library, remembered):
    rows = texts()
    encoded = bpe.encode(edge.documents(spark, rows), remembered=remembered)
    got = encoded.withColumn("bytes", bpe.decode(F.col("ids"))).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in got) == want


def test_digest(spark, library):
    rows = [(1, "one two"), (2, None), (None, "one two"), (None, "one two")]
    got = Counter(tuple(r) for r in bpe.digest(bpe.encode(edge.documents(spark, rows))).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_empty_table_and_unknown_ids(spark):
    assert bpe.encode(edge.empty(spark)).collect() == []
    ids = spark.sql("select array(64, 10000000, 65) as ids")
    assert bytes(ids.select(bpe.decode(F.col("ids")).alias("d")).first().d) == b"ab"


def test_words_remembered_are_the_most_frequent(spark):
    docs = edge.documents(spark, [(1, "a-a b b-"), (2, "a d-"), (3, "x" * 61 + "-" + "x" * 61)])
    kept = lambda most: {r.word for r in bpe.frequent(docs, most).collect()}
    assert kept(1) == {"-"} and kept(2) == {"-", "a"} and kept(3) == {"-", "a"} | {" b"} and kept(9) == {"-", "a", " b", " d"} and kept(0) == set()


def test_words_are_the_matches_of_the_pattern():
    rng = random.Random(6)
    pattern = regex.compile(public_tokenizers.PATTERN)
    parts = ["'", "'s", "'ll", "'re", "'t", "l", "s", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\u3000", "a", "é", "中", "7", "½", "!", "🙂", "\x1c", "\x85", "re", ""]
    for _ in range(400):
        column = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6)] + [None, ""]
        flat, ends = bpe.split_words(pa.array(column))
        words = flat.to_pylist()
        assert [words[a:b] for a, b in zip(ends[:-1], ends[1:])] == [pattern.findall(t or "") for t in column]


def test_heap_merges_like_the_library(library):
    rng = random.Random(8)
    table = bpe.ranks(bpe.public_ranks())
    for n in (1, 2, 61, 400, 5000):
        for alphabet in ("ab", "thequickbrown", "中文字"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert bpe.merge(word.encode(), table) == library.encode_ordinary(word)


def test_counts_are_passed_on_in_bounded_parts(spark, monkeypatch):
    """A task holds few words at a time, and every word is counted all the same."""
    monkeypatch.setattr(bpe, "COUNTED", 50)
    texts = [f"w{i % 700} and w{i % 31} x" for i in range(3_000)]
    docs = edge.documents(spark, list(enumerate(texts))).select("doc_id", "text")
    found = {r.word: r.n for r in bpe._counts(docs).collect()}
    assert found[" and"] == 3_000 and sum(n for w, n in found.items() if w == "w") == 3_000 and found[" x"] == 3_000


def test_words_are_counted_with_little_work(spark):
    """Adding up the counts of batches takes little more than counting the words of each (before: some ten times as much)."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(250_000)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([" ".join(rng.choices(words, k=200)) for _ in range(75)])}) for _ in range(60)]
    docs = MagicMock()
    bpe._counts(docs)
    tally = docs.select.return_value.mapInArrow.call_args.args[0]
    begun = time.process_time()
    counted = [pc.value_counts(bpe.split_words(batch["text"])[0]) for batch in batches]
    alone = time.process_time() - begun
    begun = time.process_time()
    found = list(tally(iter(batches)))
    whole = time.process_time() - begun
    want = Counter()
    for part in counted:
        want.update(dict(zip(part.field("values").to_pylist(), part.field("counts").to_pylist())))
    got = Counter()
    for batch in found:
        got.update(dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist())))
    assert got == want
    assert whole < 4 * alone, (whole, alone)


def test_workers_get_small_batches(spark):
    """A worker holds some thirty times a batch, and keeps it: no batch of several texts is large."""
    docs = edge.documents(spark, [(i, f"word{i} " * 1_000) for i in range(300)]).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(ids) for ids in batch["ids"]) * 4])})
    found = [r.n for r in bpe.encode(docs).select("ids").mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 300 * 1_000 * 4 and max(found) <= 400_000


def test_pieces_are_joined_in_little_memory():
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in rng.integers(0, 9, 1_000)]
    ids = rng.integers(-5, 1_010, 500_000).astype(np.int32)
    table = bpe._Pieces(pieces)
    tracemalloc.start()
    data, after = table.joined(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [pieces[i] if 0 <= i < 1_000 else b"" for i in ids.tolist()]
    assert bytes(data) == b"".join(want) and np.diff(after).tolist() == list(map(len, want))
    assert most < 10 * len(data)
