import random
import re
from collections import Counter, defaultdict

import edge
import pytest
from chronoveil.llm import collocations


def brute(rows, least, most, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[i:i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * found[q[i:i + k]]}
        rows_ = []
        for p in found.keys() - inside:
            score, k = min((1000 * found[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -found[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows_)[:most])]
    return sorted(out)


def rows():
    rng = random.Random(2)
    vocabulary = ["A", "b", "c", "d", "E", "é", "É", "ß", "the", "of", "x"]
    made = [(rng.choice(["en", "de", None, "und"]), "".join(
        rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.randrange(60)))) for _ in range(250)]
    return made + [("en", "New York city hall is big")] * 40 + [("zz", None), ("zz", ""), ("zz", " . , "), ("fr", "a " * 5000)] + [
        ("edge", t) for _, t in edge.texts()]


def table(spark, data):
    return spark.createDataFrame([(lang, t, 1, "p", 0.5, "b") for lang, t in data],
                                 "lang string, text string, rank int, phrase string, score double, block string")


@pytest.mark.parametrize("in_tasks", [2_000_000, 0])
def test_equals_brute_force(spark, in_tasks):
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows()), least=10, most=40, in_tasks=in_tasks).collect())
    want = brute(rows(), 10, 40)
    assert got == want and {r[0] for r in got} == {"en", "de", "und", "fr"} and max(r[1] for r in got) == 40


def test_shorter_phrases_only(spark):
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows()), longest=3, least=20, most=40).collect())
    assert got == brute(rows(), 20, 40, 3)


def test_nothing_frequent(spark):
    assert collocations.collocations(table(spark, [("en", "one two three")] * 99)).collect() == []
    assert len(collocations.collocations(table(spark, [("en", "one two three")] * 100)).collect()) == 1
    assert collocations.collocations(table(spark, rows()).limit(0)).collect() == []


def test_scores_past_64_bits(spark):
    """Exact where a n l r leave 64 bits: the counts come from repeated words of one long piece."""
    data = [("en", ("a b " * 200_000))] * 3
    assert sorted(tuple(r) for r in collocations.collocations(table(spark, data)).collect()) == brute(data, 100, 2000)
