"""The pipeline: each stage keeps the columns, and the rows are those of the stages' own rules."""

import corpus_pipeline
import pytest
from compare import sf_dir
from test_filters import brute_hits, expected_redactions
from test_near_copies import brute_kept

from tablelens.llm import mixing, quality


def test_stages_follow_their_rules(spark):
    docs = spark.read.parquet(f"{sf_dir('0.001')}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf_dir("0.001"))
        assert kept.columns == columns
        rows = {r.doc_id: r for r in kept.collect()}
        seen[name] = (docs, rows)
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    before, after = seen["quality classifier"]
    labels = spark.read.parquet(f"{sf_dir('0.001')}/labels.parquet")
    assert set(after) == {r.doc_id for r in quality.report(before, labels).collect() if r.keep}
    before, after = seen["SimHash near-dedup"]
    assert set(after) == brute_kept({r.doc_id: r.text for r in before.collect()})
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir('0.001')}/benchmark.parquet").collect()]
    assert set(after) == {r.doc_id for r in before.collect() if not brute_hits(r.text, items)[-1]}
    before, after = seen["PII"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert set(after) == set(texts)
    for k, text in texts.items():
        assert (after[k].text != text) == bool(expected_redactions(text)) and after[k].n_chars == len(after[k].text)
        assert not expected_redactions(after[k].text)
    before, after = seen["mixing sources to target weights"]
    assert set(after) == {r.doc_id for r in mixing.report(before).collect() if r.sampled}


def test_a_missing_package_inside_is_an_error(monkeypatch):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    with pytest.raises(AttributeError):
        corpus_pipeline.nothing  # noqa: B018
