import itertools
import random
import zlib
from collections import Counter

import edge
import numpy as np
import pytest
from chronoveil.llm import packing, token_codec, tokens
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.public_tokenizer())


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randrange(1, 12) for _ in range(rng.randrange(0, 8))]
        room = rng.randrange(0, 25)
        counts = np.bincount(lengths, minlength=30) if lengths else np.zeros(30, int)
        best = max(sum(s) for k in range(len(lengths) + 1) for s in itertools.combinations(lengths, k) if sum(s) <= room)
        total, chosen = packing.fullest(counts, room)
        assert total == best == sum(a * n for a, n in chosen.items())
        assert all(n <= counts[a] for a, n in chosen.items())


def test_patterns_equal_bin_by_bin():
    rng = random.Random(2)
    for _ in range(40):
        lengths = Counter(rng.choice([3, 5, 8, 13, 20, 21, 34]) for _ in range(rng.randrange(1, 80)))
        counts, slow = np.zeros(41, int), []
        for a, n in lengths.items():
            counts[a] = n
        while counts.any():
            longest = int(np.flatnonzero(counts)[-1])
            counts[longest] -= 1
            _, taken = packing.fullest(counts, 40 - longest)
            for a, n in taken.items():
                counts[a] -= n
            taken[longest] = taken.get(longest, 0) + 1
            slow.append(tuple(sorted(taken.items())))
        fast = [tuple(sorted(t.items())) for n, t in packing.patterns(dict(lengths), 40) for _ in range(n)]
        assert fast == slow


def test_packed_documents(spark, tokenizer):
    rows = edge.texts()
    got = packing.pack(edge.documents(spark, rows), capacity=64).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, a in enumerate(range(0, len(ids), 64)):
            part = ids[a:a + 64]
            want[i, piece, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(edge.empty(spark)).collect() == []


def test_ids_are_those_of_the_tokenizer(tokenizer):
    import pyarrow as pa
    rng = random.Random(1)
    letters = list("abcDEF'stremvld.,;:!?  \n\t\v\f\r\x1c0129É×÷éßİı̈́̇ñÀ中文<|>~\"-") + ["<|endoftext|>", "'s", "don't", "K", "ſ"]
    encoder = tokens.WordEncoder(tokens.public_tokenizer(), remembered=50)
    for k in range(150):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) if rng.random() > .05 else None for _ in range(20)]
        if k % 2:
            texts = [None if x is None else x.replace("<|", "<") for x in texts]
        ids, at = encoder.encode(pa.array(texts))
        for i, x in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == tokenizer.encode(x or "", add_special_tokens=False).ids


def test_code_lengths_are_optimal():
    import heapq
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 200):
        counts = np.zeros(n + 5, np.int64)
        counts[:n] = rng.integers(1, 1000, n) ** 2
        heap, cost = list(counts[:n].tolist()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        lengths = token_codec.code_lengths(counts, 30)
        assert (lengths * counts).sum() == (cost or counts.sum())
        short = token_codec.code_lengths(counts, max(1, int(np.ceil(np.log2(n)))))
        assert short.max() <= max(1, np.ceil(np.log2(n))) and (2.0 ** -short[short > 0]).sum() <= 1
        assert (lengths[n:] == 0).all()


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 3000)
        lengths = token_codec.code_lengths(np.bincount(ids, minlength=1), 18)
        payload = token_codec.encode_block(ids, lengths, token_codec.canonical_codes(lengths))
        assert (token_codec.decode_block(payload, token_codec.decode_table(lengths)) == ids).all()


def test_files_round_trip(spark, tokenizer, tmp_path):
    rows = edge.texts()
    got = token_codec.round_trip(edge.documents(spark, rows), str(tmp_path / "ids"), rows_per_range=4).collect()
    coded = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in coded)
    end = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_codec.round_trip(edge.empty(spark), str(tmp_path / "none")).collect() == []
