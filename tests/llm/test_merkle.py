import hashlib
import random
import zlib
from collections import Counter, defaultdict

import edge
import pytest
from chronoveil.llm import merkle
from pyspark.sql import functions as F

SCHEMA = edge.SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for row in tree[:-1]:
        yield (i & 1, row[i ^ 1] if i ^ 1 < len(row) else None)
        i //= 2


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text): every result row, and the trees by language."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = [*siblings(trees[k], i), *siblings(top, at)]
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(*r[:3], r[3] + 1, r[4]) if hit else own
            for left, digest in path:
                now = sha(now if digest is None else digest + now if left else now + digest)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], sha("".join(d for _, d in path if d)), now, now == top[-1][0]))
    return Counter(out), trees


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, 0.5, "x", "b", 1, "c", "r", 2, "k", "p", "q", 3) for i, s, lang, n, t in rows], SCHEMA)


def manifest(docs, height):
    return merkle.build(docs, {"n_chars": merkle.tampered(F.col("doc_id"), F.col("n_chars"))}, height=height)


def all_rows(count):
    rng = random.Random(count)
    rows = [(i, rng.choice(["s", None, "né"]), rng.choice(["en", "de", None, "", "zz"]), rng.choice([None, 0, 17, 2 ** 63 - 1]), t)
            for i, t in edge.texts()]
    return rows + [(rng.randrange(3 * count), "s", rng.choice(["en", "en", "fr"]), i, f"text {i}") for i in range(count)] + [(5, "s", "en", 1, "same")] * 9


@pytest.mark.parametrize("height", [1, 3, 10])
def test_equals_brute_force(spark, height):
    rows = all_rows(60)
    made = manifest(table(spark, rows), height)
    want, trees = brute(rows)
    assert Counter(tuple(r) for r in merkle.audit(made).collect()) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    log = defaultdict(dict)
    for e in made.entries().collect():
        assert e.position not in log[e.tree]
        log[e.tree][e.position] = bytes(e.digest).hex()
    for lang, tree in trees.items():  # an appender that writes every node as soon as it is complete
        want_log = []
        for i in range(len(tree[0])):
            for k, row in enumerate(tree):
                if k == 0 or (i + 1) % (1 << k) == 0 or i == len(tree[0]) - 1:
                    want_log.append(row[i >> k])
        assert log["" if lang is None else f"={lang}"] == dict(enumerate(want_log))


def test_small_manifests(spark):
    assert merkle.audit(manifest(edge.empty(spark), 10)).collect() == []
    one = [(None, None, None, None, None)]
    assert Counter(tuple(r) for r in merkle.audit(manifest(table(spark, one), 10)).collect()) == brute(one)[0]
    for n in range(1, 18):
        rows = [(i, "s", "en", i, "t") for i in range(n)]
        made = manifest(table(spark, rows), 2) if n in (1, 4, 5, 16, 17) else None
        if made:
            assert Counter(tuple(r) for r in merkle.audit(made).collect()) == brute(rows)[0]


def test_positions_are_the_completion_order():
    for n in range(1, 70):
        seen = {int(merkle.position(k, j, n)) for k in range(merkle.height(n) + 1) for j in range(-(-n >> k))}
        assert seen == set(range(sum(-(-n >> k) for k in range(merkle.height(n) + 1))))
