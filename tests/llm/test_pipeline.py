"""The stages of the pipeline against what they must keep, drop and change."""

import corpus_pipeline
import pandas as pd
import pytest

from strandweave.llm import mixing, pieces, pii, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "test-stage")
        out.append(docs)
    return out


def test_stages(spark, steps):
    raw, good, single, masked, mixed, encoded = steps
    for s in (good, single, masked, mixed):
        assert s.columns == raw.columns
    predicted = {r.doc_id for r in queries.op10_quality(spark, DATA).collect() if r.predicted}
    assert {r.doc_id for r in good.collect()} == predicted
    heads = {r.doc_id for r in corpus_pipeline.jaccard.near_duplicates(good).collect() if r.keep}
    assert {r.doc_id for r in single.collect()} == heads
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        spans = pii.scored(before[r.doc_id], pii.spans_of(before[r.doc_id]))
        assert r.text == pii.masked(before[r.doc_id], spans) and r.n_chars == len(r.text)
    expected = mixing.mix(masked).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == expected
    enc = pieces.encoder(corpus_pipeline.PIECE_MODEL)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = encoded.collect()
    assert len(rows) == mixed.count()
    assert all(list(r.ids) == enc.library.encode(texts[r.doc_id]) for r in rows)


def test_run_equals_stages(spark, steps):
    a = pd.Series([r.decoded_sha256 for r in corpus_pipeline.run(spark, DATA).collect()]).sort_values().tolist()
    b = pd.Series([r.decoded_sha256 for r in steps[-1].collect()]).sort_values().tolist()
    assert a == b


def test_run_leaves_one_table_a_stage(spark, monkeypatch, tmp_path):
    """What a finished stage needed is removed; the tables of the last stage's input stay, as its rows are read from them."""
    from strandweave.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    other = common.stored(spark.range(5), "other")
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and other.count() == 5
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert left == ["other", "stage-3"]
