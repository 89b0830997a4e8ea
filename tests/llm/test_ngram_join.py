import random
import re
from collections import Counter, defaultdict

import edge
from chronoveil.llm import components, ngram_join


def sets_of(texts, size):
    out = []
    for t in texts:
        ws = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        out.append(frozenset(tuple(ws[k:k + size]) for k in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)] if ws else []))
    return out


def brute(rows, size, link):
    """(id, set size, smallest id reached) of every row."""
    sets, at, root = sets_of([t for _, t in rows], size), defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        shared = Counter(j for h in s for j in at[h])
        for h in s:
            at[h].append(i)
        for j, n in shared.items():
            if link[1] * n >= link[0] * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near_copies():
    """Groups of copies with few to many edits, chains of edits, a common passage, and groups without their original."""
    rng, rows, n = random.Random(12), list(edge.texts()), 100
    passage = edge.words(rng, 40)
    for size in (6, 12, 30, 150):
        original = edge.words(rng, size).split()
        for k in range(12):
            ws = list(original)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                ws[rng.randrange(len(ws))] = f"e{rng.randrange(8)}"
            rows.append((n, " ".join(ws)))
            n += 1
    chain = edge.words(rng, 60).split()
    for k in range(15):
        chain[4 * k] = f"c{k}"
        rows.append((n, " ".join(chain)))
        n += 1
    for k in range(40):
        rows.append((n, passage + " " + edge.words(rng, rng.choice([2, 6, 40]))))
        n += 1
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark):
    rows = near_copies()
    for size, link in ((4, (85, 100)), (5, (80, 100)), (2, (60, 100))):
        got = ngram_join.link_documents(edge.documents(spark, rows), size, link).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, size, link)


def test_large_group_needs_few_products(spark):
    """Hundreds of near copies of one text: products grow with the group, not with its square."""
    rng = random.Random(4)
    original = edge.words(rng, 100).split()
    rows = []
    for k in range(400):
        ws = list(original)
        ws[rng.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(ws)))
    docs = edge.documents(spark, rows)
    counted, real = [], ngram_join._verified

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return real(pairs, *rest)
    ngram_join._verified = counting
    try:
        got = ngram_join.link_documents(docs).collect()
    finally:
        ngram_join._verified = real
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, (85, 100))
    assert sum(counted) < 40 * len(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_one_of_each(spark):
    rows = near_copies()
    docs = edge.documents(spark, rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.schema == docs.schema
    parts = brute(rows, 5, (80, 100))
    want = len({c for _, n, c in parts if n}) + sum(k for (_, n, _), k in parts.items() if not n)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == want and set(ids) >= {c for _, n, c in parts if n}


def test_empty(spark):
    assert ngram_join.link_documents(edge.empty(spark)).collect() == []
    assert ngram_join.one_of_each(edge.empty(spark)).collect() == []


def test_each_class_gets_one_text_whatever_the_ids(spark, monkeypatch):
    rng = random.Random(4)
    originals = [edge.words(rng, 60).split() for _ in range(6)]
    rows = [(i, " ".join([*ws[:k], "changed", *ws[k + 1:]])) for ws in originals for k in (3, 30, 55) for i in (None, 7)]
    read, whole = [], ngram_join._rows_of_matrix
    frames = type(spark.range(0))
    mapped = frames.mapInArrow

    def spy(self, function, *args, **kwargs):
        if getattr(function, "__qualname__", "").startswith(whole.__qualname__):
            read.append(self.groupBy("cls").count().collect())
        return mapped(self, function, *args, **kwargs)
    monkeypatch.setattr(frames, "mapInArrow", spy)
    frame = edge.documents(spark, rows + rows[:4])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(frame, 3, (80, 100)).collect())
    assert got == brute(rows + rows[:4], 3, (80, 100))
    assert len(read) == 1 and len(read[0]) == 18 and all(r["count"] == 1 for r in read[0])
