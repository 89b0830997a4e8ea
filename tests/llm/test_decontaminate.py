import itertools
import random
import re
from collections import Counter

import edge
import numpy as np
import pyarrow as pa
from chronoveil.llm import decontaminate as dc


def plain(text):
    return [w for w in (re.sub(r"[\W_]+", "", w) for w in (text or "").lower().split()) if w]


def brute(docs, items):
    """Every item at every shift on every document."""
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number) + 1) for w in ws], dtype=np.uint64)
    out = {}
    for i, t in docs:
        d = code(plain(t))
        for j, x in items:
            e = code(plain(x))
            if len(e) < dc.SHORTEST:
                continue
            for shift in range(-len(e), len(d)):
                found = dc.best_overlap(e, d, shift)
                if found and found[2] > out.get((i, j), (0, 0, 0))[2]:
                    out[i, j] = found
    return out


def fixture():
    rng = random.Random(8)
    items = [(k, edge.words(rng, n, 500)) for k, n in enumerate((5, 8, 9, 11, 12, 14, 25, 40, 60))] + [(90, None), (None, edge.words(rng, 30, 500)), (91, "")]
    docs = list(edge.texts()[:9])
    n = 100
    for k, (_, text) in enumerate(items):
        if not text:
            continue
        for rate in (0.0, 0.08, 0.5):
            ws = [w.upper() + "," if rng.random() < 0.2 else f"sub{rng.random()}" if rng.random() < rate else w for w in text.split()]
            docs.append((n, edge.words(rng, 30) + "\n" + " ".join(ws) + " " + edge.words(rng, 20)))
            n += 1
    docs.append((n, " ".join(items[7][1].split()[5:30])))
    return docs, items


def test_overlaps_match_brute_force(spark):
    docs, items = fixture()
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items] + [(8, items[8][1], "x", 1)], "item_id bigint, text string, doc_id string, hash int")
    frame = edge.documents(spark, docs)
    got = {(r.doc_id, r.item_id): (r.first_word, r.words, r.matches) for r in dc.overlaps(frame, bench).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    lost = [k for k in want if k not in got]  # only where substitutions fall on all masks
    assert len(lost) <= 1 and len(got) > 12
    again = {(r.doc_id, r.item_id): (r.first_word, r.words, r.matches) for r in dc.overlaps(frame, bench, most=0).collect()}
    assert again == got
    bad = {k[0] for k in got}
    kept = dc.clean(frame, bench)
    assert kept.schema == frame.schema
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(i for i, _ in docs if i not in bad and i is not None)
    assert dc.clean(frame, bench, most=0).count() == kept.count()


def test_spaced_seeds_survive_substitutions():
    rng = random.Random(3)
    found = 0
    for _ in range(100):
        item = edge.words(rng, 30, 100_000).split()
        text = [w if i % 8 != 4 else "other" for i, w in enumerate(item)]
        found += bool(dc.Benchmark.of([(1, " ".join(item))]).overlaps(pa.array([" ".join(text)])))
    assert found == 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = edge.documents(spark)
    assert dc.overlaps(docs, none).collect() == [] and dc.clean(docs, none).count() == docs.count()
    assert dc.overlaps(edge.empty(spark), none).collect() == []


def stretches(same, size):
    """Most matching words of any stretch that meets the rule, which is stated here on its own."""
    least = min(13, -(-4 * size // 5))
    found = [sum(same[b:e]) for b in range(len(same)) for e in range(b + 1, len(same) + 1) if 5 * sum(same[b:e]) >= 4 * (e - b)]
    return max((m for m in found if m >= least), default=None)


def test_every_stretch_that_meets_the_rule_is_accepted():
    rng = random.Random(11)
    item = np.arange(1, 61, dtype=np.uint64)
    patterns = [[k not in out for k in range(16)] for n in (1, 2, 3, 4) for out in itertools.combinations(range(16), n)]
    patterns += [[rng.random() < rng.choice((0.6, 0.8, 0.9)) for _ in range(rng.randrange(16, 45))] for _ in range(400)]
    accepted = 0
    for same in patterns:
        own = item[:len(same)]
        shift = rng.randrange(5)
        text = np.concatenate((np.full(shift, 99, np.uint64), np.where(same, own, np.uint64(0)), np.full(3, 98, np.uint64)))
        found, want = dc.best_overlap(own, text, shift), stretches(same, len(own))
        assert (found[2] if found else None) == want
        if found:
            part = same[found[0] - shift:found[0] - shift + found[1]]
            assert len(part) == found[1] and sum(part) == found[2] and 5 * found[2] >= 4 * found[1] and part[0] and part[-1]
            accepted += 1
    assert accepted > 700


def test_both_paths_give_the_same_rows(spark):
    docs, items = fixture()
    lost = [(None, t) for i, t in docs if i is not None and i >= 100]
    twice = items[8][1].split()
    docs = docs + lost + [(100, t) for _, t in lost] + docs[-3:] + [
        (300, " ".join(twice + ["between"] + twice)), (301, " ".join(["x"] + twice[:20] + ["y", "y", "y"] + twice[:20]))]
    items = items + [(7, items[8][1]), (8, items[7][1]), (8, items[8][1]), (None, items[6][1]), (500, " ".join(twice[:15] * 3))]
    frame = edge.documents(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    tasks, shuffled = dc.overlaps(frame, bench), dc.overlaps(frame, bench, most=0)
    assert tasks.schema == shuffled.schema
    want = Counter(map(tuple, tasks.collect()))
    assert Counter(map(tuple, shuffled.collect())) == want
    assert sum(n for r, n in want.items() if r[0] is None) > 20 and max(want.values()) > 1
    assert Counter(r.doc_id for r in dc.clean(frame, bench).collect()) == Counter(r.doc_id for r in dc.clean(frame, bench, most=0).collect())


def test_short_items_are_found_wherever_the_rule_holds():
    rng = random.Random(12)
    for size in range(1, 16):
        item = [f"i{k}" for k in range(size)]
        least = size if size < 8 else min(13, -(-4 * size // 5))
        texts, want = [], []
        for n in range(0, size - least + 2):
            for out in itertools.combinations(range(size), n):
                same = [k not in out for k in range(size)]
                middle = [w if s else "other" for w, s in zip(item, same)]
                while middle and middle[0] == "other":  # the document begins within the item
                    middle.pop(0)
                around = [[], [f"a{rng.random()}"]]
                texts.append(" ".join(around[0] + middle + rng.choice(around)))
                found = [sum(same[b:e]) for b in range(size) for e in range(b + 1, size + 1) if 5 * sum(same[b:e]) >= 4 * (e - b)]
                want.append(max(found, default=0) >= least)
        got = dc.Benchmark.of([(1, " ".join(item))]).overlaps(pa.array(texts))
        assert {t for t, _ in got} == {t for t, w in enumerate(want) if w}
        assert any(want) and (size == 1 or not all(want))


def test_scripts_without_spaces_are_split_into_letters(spark):
    item = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    docs = [(1, "前文。" + item[:9] + "犬" + item[10:] + "、後文"), (2, "全く別の文章でありこの句とは何も似ていない"), (3, "See x" + item[2:18] + "yz, ok")]
    frame, bench = edge.documents(spark, docs), spark.createDataFrame([(7, item), (8, "ภาษาไทย ไม่มี")], "item_id bigint, text string")
    want = [(1, 7, 2, 20, 19), (3, 7, 2, 16, 16)]
    assert sorted(map(tuple, dc.overlaps(frame, bench).collect())) == want
    assert sorted(map(tuple, dc.overlaps(frame, bench, most=0).collect())) == want
    assert [r.doc_id for r in dc.clean(frame, bench).collect()] == [2]


def test_passages_of_long_items_are_found_whatever_is_substituted():
    rng = random.Random(13)
    item = [f"i{k}" for k in range(30)]
    texts = []
    for size, n in ((13, 0), (14, 1), (15, 2), (16, 3)):
        for out in itertools.combinations(range(size), n):
            at = rng.randrange(30 - size)
            texts.append(" ".join(["a", *[f"s{k}" if k in out else item[at + k] for k in range(size)], "b"]))
    found = {t for t, _ in dc.Benchmark.of([(1, " ".join(item))]).overlaps(pa.array(texts))}
    assert found == set(range(len(texts)))
