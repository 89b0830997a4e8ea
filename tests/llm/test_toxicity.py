import random

import edge
import numpy as np
import pyarrow as pa
import pytest
from chronoveil.llm import base, learning, queries, toxicity
from pyspark.sql import functions as F


def corpus(n=400, seed=1):
    """Texts with a bad word, alone or at the beginning of a compound, are toxic."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ws = edge.words(rng, rng.randrange(5, 80), 300).split()
        bad = i % 3 == 0
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(["Vile!", "viletongue", "vilenessx"]) if i % 2 else "stinker,"
        rows.append((i, " ".join(ws), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = edge.documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (1, None, "x")], "doc_id bigint, toxic int, text string")
    return toxicity.fit(docs, labels)


def test_learns_words_and_beginnings(model):
    rows = corpus(300, seed=9)
    values = toxicity.scores(model, pa.array([t for _, t, _ in rows]))
    truth = np.array([y for _, _, y in rows])
    assert ((values >= toxicity.THRESHOLD) == truth).mean() > 0.97
    assert values.min() >= 0 and values.max() <= 1


def test_learns_from_every_labelled_row(spark):
    """6000 toxic and 6000 clean texts, each with a word of its own: only what was learned from can be told."""
    rng = random.Random(4)
    rows = [(i, f"{edge.words(rng, 4, 200)} {''.join(rng.choices('bcdfghklmnprstvw', k=9))}", i // 7 % 2) for i in range(12_000)]
    docs = edge.documents(spark, [(i, t) for i, t, _ in rows])
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    held = {r.i for r in spark.range(12_000).filter(learning.held_out(F.col("id"))).select(F.col("id").alias("i")).collect()}
    learned = [r for r in rows if r[0] not in held and r[0] % 5]
    values = toxicity.raw_scores(model, *(lambda d, c, o: (toxicity.features(d), c, o))(*base.words(pa.array([t for _, t, _ in learned]))))
    truth = np.array([y for _, _, y in learned])
    assert ((values > np.median(values)) == truth).mean() > 0.9


def test_learns_from_whole_texts(spark):
    docs = edge.documents(spark, [(i, "word " * 10_000 + f"end{i}") for i in range(8)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, toxic int")
    rows = toxicity.labelled(docs, labels, "doc_id", "text", "lang", "toxic", "doc_id").collect()
    held = {r.doc_id for r in docs.filter(learning.held_out(F.col("doc_id"))).collect()}
    assert sorted((r.doc_id, r.label, len(r.text), r.text[-4:]) for r in rows) == [(i, i % 2, 50_004, f"end{i}") for i in range(8) if i not in held]


def test_many_shards_learn_the_same_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    monkeypatch.setattr(toxicity, "CHUNK_TEXTS", 30)
    rows = corpus(1_500, seed=3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    docs = edge.documents(spark, [(i, t) for i, t, _ in rows])
    table = toxicity.labelled(docs.union(docs), labels.union(labels), "doc_id", "text", "lang", "toxic", "doc_id")
    held = spark.range(1_500).filter(learning.held_out(F.col("id"))).count()
    assert table.count() == 1_500 - held and table.select("shard").distinct().count() > 5
    model = toxicity.fit(docs, labels)
    fresh = corpus(300, seed=9)
    values = toxicity.scores(model, pa.array([t for _, t, _ in fresh]))
    assert ((values >= toxicity.THRESHOLD) == np.array([y for _, _, y in fresh])).mean() > 0.97


def test_pooling_is_the_maximum_over_the_whole_text(model):
    texts = ["a b c d e", "", "one", "one two", "x y z " * 50]
    dictionary, codes, offsets = base.words(pa.array(texts))
    top, _, vectors = toxicity.pooled(model, toxicity.features(dictionary), codes, offsets)
    for i in range(len(texts)):
        own = vectors[codes[offsets[i]:offsets[i + 1]]]
        for k, span in enumerate(toxicity.SPANS):
            best = np.zeros(toxicity.FILTERS)
            for a in range(len(own) - span + 1):
                best = np.maximum(best, sum(own[a + j] @ model.taps[span][j] for j in range(span)) + model.shift[span])
            assert top[i, k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS] == pytest.approx(best, abs=1e-4)


def test_thresholds_by_language_take_effect(spark, model):
    docs = edge.documents(spark, [(1, "clean words only"), (2, "such a stinker, you"), (3, None)])
    assert [r.doc_id for r in toxicity.accepted(docs, model).collect()] == [1, 3]
    strict = toxicity.Classifier(model.embed, model.taps, model.shift, model.out, model.bias, model.slope, model.offset, {"en": 0.0})
    assert toxicity.accepted(docs, strict).collect() == []
    assert toxicity.accepted(docs, model).schema == docs.schema


def test_edges(spark, model):
    docs = edge.documents(spark)
    rows = toxicity.with_scores(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = {r.score for r in rows if not (r.text or "").strip()}
    assert len(nothing) == 1
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int")) is None
    assert {r.score for r in toxicity.with_scores(docs, None).collect()} == {0.0}
    one_class = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id bigint, toxic int"))
    assert one_class is None or toxicity.scores(one_class, pa.array(["a", None])).min() > 0.5
    assert toxicity.with_scores(edge.empty(spark), model).collect() == []


def test_query(spark, sf_dir):
    rows = queries.QUERIES["op5_toxicity_network"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    right = rows[rows.held_out].predicted == rows[rows.held_out].toxic
    assert right.mean() > 0.85
