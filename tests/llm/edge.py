"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _score string, blob string, "
          "text_hash int, cls string, `range` string, bucket int, component_id string, spans string, rank string, grp int")


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def texts() -> list:
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, "  \t\n "), (7, "One"), (8, "one two three"),
            (9, words(rng, 60_000)), (None, base + " more"), (None, None), (11, "!!! 123 ###"), (12, "été ÉTÉ 中文 🙂 token"),
            (13, words(rng, 40)), (13, words(rng, 30))]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 0.5, "x", "b", 1, "c", "r", 2, "k", "p", "q", 3)
                                  for i, t in rows], SCHEMA)


def empty(spark):
    return documents(spark).limit(0)
