import hashlib
import random

import edge
import numpy as np
from chronoveil.llm import fingerprint as fp


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(2)
    for _ in range(20):
        body = edge.words(rng, 200).encode()
        moved = b"".join((b"#" * rng.randrange(40), edge.words(rng, 3).encode(), body))
        _, a = fp.phrase_hashes([body])
        _, b = fp.phrase_hashes([moved])
        assert len(np.intersect1d(a, b)) > 0.75 * len(np.unique(a))


def test_texts_do_not_touch_each_other():
    rng = random.Random(3)
    texts = [b"", b"a", b"aa", b"aaaaaaaaaaaaaaa", b"ab" * 50, b"abc", edge.words(rng, 500).encode(), "é🙂".encode() * 9, b"", b"zz"]
    together = fp.fingerprints(texts)
    assert together == [fp.fingerprints([t])[0] for t in texts]
    assert together[0] == b"" and all(together[i] for i in range(1, 8))
    assert len({together[i] for i in range(1, 8)}) == 7


def test_phrases_shrink_every_level():
    rng = np.random.default_rng(1)
    for symbols in (rng.integers(0, 3, 5000), rng.integers(0, 256, 5000), np.arange(5000) % 2):
        now, first, level = symbols.astype(np.uint8), np.arange(5000) == 0, 0
        while len(now) > 1:
            new, first = fp._level(now, first, level)
            assert len(new) <= (len(now) + 1) / 2
            now, level = new, level + 1


def test_likeness_estimates_overlap():
    rng = random.Random(5)
    a, b = edge.words(rng, 900), edge.words(rng, 900)
    half = fp.edited(a, b)
    x, y, z = fp.fingerprints([a.encode(), half.encode(), b.encode()])
    assert 0.15 < fp.likeness(x, y) < 0.55 and fp.likeness(x, z) < 0.1
    assert fp.likeness(x, x) == 1 == fp.likeness(b"", b"") and fp.likeness(x, b"") == 0


def test_edited_texts_and_neighbours(spark):
    rows = edge.texts()
    for size in (3, 1000):
        got = fp.compare_with_next(edge.documents(spark, rows), rows_per_range=size).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
        want = []
        for k, (i, t) in enumerate(order):
            t, following = t or "", order[(k + 1) % len(order)][1] or ""
            changed = fp.edited(t, following)
            p, q, n = fp.fingerprints([t.encode(), changed.encode(), following.encode()])
            want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), p.hex(), q.hex(), fp.likeness(p, q), fp.likeness(p, n)))
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_document_and_none(spark):
    one = fp.compare_with_next(edge.documents(spark, [(7, "abcd")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.compare_with_next(edge.empty(spark)).collect() == []
