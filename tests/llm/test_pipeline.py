from collections import Counter

import corpus_pipeline
import pytest
import test_decontaminate
import test_ngram_join
import test_secrets
from chronoveil.llm import base, toxicity


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Documents, then what each stage made of what its predecessor kept."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(base.written(stage(spark, out[-1], sf_dir), f"test-{name.replace(' ', '-')}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.schema == steps[0].schema


def test_toxic_documents_go(spark, sf_dir, steps):
    import pyarrow as pa
    model = toxicity.fit(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = steps[0].select("doc_id", "text", "lang").collect()
    values = toxicity.scores(model, pa.array([r.text for r in docs]))
    keep = {r.doc_id for r, s in zip(docs, values) if s < model.thresholds.get(r.lang, toxicity.THRESHOLD)}
    assert {i for i, _ in rows(steps[1])} == keep
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs} - keep
    assert sum(labels.get(i, 1) for i in gone) >= 0.9 * len(gone) and sum(labels.get(i, 0) for i in gone) >= 0.7 * sum(labels.values())


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    want = {c for _, n, c in test_ngram_join.brute(before, 5, (80, 100)) if n}
    assert Counter(i for i, _ in rows(steps[2])) == Counter(want)


def test_documents_with_benchmark_passages_go(spark, sf_dir, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = set()
    for _, t in items:
        ws = test_decontaminate.plain(t)
        grams |= {tuple(ws[k:k + 13]) for k in range(len(ws) - 12)}
    kept = {i for i, _ in rows(steps[3])}
    for i, t in rows(steps[2]):
        ws = test_decontaminate.plain(t)
        exact = any(tuple(ws[k:k + 13]) in grams for k in range(len(ws) - 12))
        assert (i in kept) != exact


def test_secrets_are_blanked(steps):
    after = dict(rows(steps[4]))
    assert len(after) == steps[3].count()
    changed = 0
    for i, t in rows(steps[3]):
        spans, _ = test_secrets.brute(t)
        text, at = "", 0
        for a, _, b, _ in spans:
            if a >= at:
                text += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert after[i] == text + t[at:]
        changed += bool(spans)
    assert changed


def test_packing_holds_every_document_once(spark, sf_dir, steps):
    pieces = steps[5].toPandas()
    assert set(pieces.doc_id) == {i for i, _ in rows(steps[4])}
    assert (pieces.groupby("sequence_id").length.sum() <= 4096).all()
    assert pieces.sequence_id.nunique() <= -(-pieces.length.sum() // 4096) + 1
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    cols = ["doc_id", "piece", "ids_crc32"]
    assert whole[cols].sort_values(cols).values.tolist() == pieces[cols].sort_values(cols).values.tolist()
