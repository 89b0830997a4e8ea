import edge
import numpy as np
import pyarrow as pa
import pytest
from chronoveil.llm import base, language, learning, queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def predicted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.QUERIES["op1_byte_network"](spark, sf_dir)
    return found.join(docs.select("doc_id", "lang"), "doc_id").toPandas()


def test_held_out_accuracy(predicted):
    apart = predicted[predicted.held_out]
    assert len(apart) > 100 and (apart.lang == apart.lang_pred).mean() >= 0.97
    assert predicted.score.between(0, 1).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    steps = rng.integers(1, 256, (7, 3)).astype(np.uint8)
    inputs, recur = rng.normal(0, .5, (6, 256)), rng.normal(0, .5, (6, 3))
    weights = rng.normal(0, 1, (7, 3, 3))

    def loss(i, r):
        return float((language.run_direction(i.astype(np.float32), r.astype(np.float32), steps) * weights).sum())
    keep: dict = {}
    states = language.run_direction(inputs.astype(np.float32), recur.astype(np.float32), steps, keep)
    d_inputs, d_recur = language._backward(recur.astype(np.float32), steps, states, keep, weights.astype(np.float32))
    for which, value, grad in ((0, inputs, d_inputs), (1, recur, d_recur)):
        for place in ((0, steps[2, 1] if which == 0 else 1), (2, steps[0, 0] if which == 0 else 0), (4, steps[3, 2] if which == 0 else 2)):
            up, down = [inputs.copy(), recur.copy()], [inputs.copy(), recur.copy()]
            up[which][place] += 1e-2
            down[which][place] -= 1e-2
            assert (loss(*up) - loss(*down)) / 2e-2 == pytest.approx(grad[place], abs=2e-2)


def test_documents_pool_all_positions():
    net = language.Network.fresh(["a", "b", "c"])
    texts = ["x" * 300, "", "hello world " * 40, "é"]
    data, offsets = base.utf8(pa.array(texts))
    probs = language.document_probabilities(net, data, offsets, window=16)
    for i, t in enumerate(texts):
        raw, total = np.frombuffer(t.encode(), np.uint8), np.zeros(3)
        for a in range(0, len(raw), 16):
            steps = np.zeros((16, 1), np.uint8)
            steps[:len(raw[a:a + 16]), 0] = raw[a:a + 16]
            both = language.run_direction(net.inputs[0], net.recur[0], steps), language.run_direction(net.inputs[1], net.recur[1], steps[::-1])[::-1]
            total += language._position_probabilities(net, *both)[:len(raw[a:a + 16]), :, 0].sum(axis=0)
        assert probs[i] == pytest.approx(total / max(1, len(raw)), abs=1e-5)


def test_edges(spark):
    docs = edge.documents(spark)
    rows = language.identify(docs, language.fit(docs)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (4, 5, 6, 11)] == ["und"] * 4 and by[11].score == 0
    assert by[9].lang_pred == "en" and by[12].lang_pred == "en"
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.fit(edge.empty(spark)) is None
    assert language.identify(edge.empty(spark), None).collect() == []


def test_split_is_that_of_the_contract(spark):
    import zlib
    rows = spark.range(200).select("id", learning.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_samples_have_every_class_and_no_repeats(spark):
    """All of 300 languages, among them one whose rows share an id and one of a single repeated row."""
    rows = spark.range(3000).select(F.format_string("l%03d", F.col("id") % 298).alias("lang"), F.col("id").alias("doc_id"),
                                    F.concat(F.lit("text "), "id").alias("text"))
    shared = spark.range(4000).select(F.lit("shared").alias("lang"), F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    same = spark.range(4000).select(F.lit("same").alias("lang"), F.lit(8).cast("bigint").alias("doc_id"), F.lit("one text").alias("text"))
    found, counts = learning.sample_per_class(rows.unionByName(shared).unionByName(same), "lang", ["doc_id", "text"], 100)
    got = {r.lang: r["count"] for r in found.groupBy("lang").count().collect()}
    assert len(counts) == 300 == len(got) and counts["shared"] == 4000 and counts["same"] == 1
    assert got["same"] == 1 and 50 <= got["shared"] <= 200 and found.columns == ["lang", "doc_id", "text"]
