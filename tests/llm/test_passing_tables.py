"""Stages of the pipeline leave behind only the tables that their result reads."""

import os
import random

import corpus_pipeline
import pytest
from test_near_copies import brute_kept, family

from tablelens.llm import shingles
from tablelens.llm.common import materialize, passing
from tablelens.session import scratch_path


def stored(spark):
    """The names of the stored tables of this session, without their numbers."""
    folder = os.path.dirname(scratch_path(spark, "any")).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def labels(tables):
    return sorted(t.rsplit("-", 1)[0] for t in tables)


def test_near_copies_leave_two_tables(spark, documents):
    rng = random.Random(5)
    texts = [None, "", "one", *family(rng, 60, 8, 4), *family(rng, 90, 6, 9)]
    docs = documents(list(enumerate(texts)))
    before = stored(spark)
    kept = shingles.drop_near_copies(docs)
    assert labels(stored(spark) - before) == ["dropped-rows", "numbered"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_kept(dict(enumerate(texts))))


def test_the_quality_stage_stores_no_text(spark, monkeypatch, documents):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(("junk", "win", "cash") if k % 3 else ("field", "river", "stone")) for _ in range(30))) for k in range(60)]
    docs = documents(rows)
    marks = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k, _ in rows], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: marks)
    before = stored(spark)
    kept = corpus_pipeline.quality_classifier(spark, docs, "")
    folder = os.path.dirname(scratch_path(spark, "any"))
    for table in stored(spark) - before:
        assert "text" not in spark.read.parquet(f"{folder}/{table}").columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows if k % 3 == 0}


def test_tables_that_stay_go_with_the_block_around(spark):
    before, setting = stored(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    cleaned = spark.conf.get(setting)
    with passing(spark):
        with pytest.raises(ValueError), passing(spark):
            materialize(spark.range(3), "inner")
            kept = materialize(spark.range(4), "outer", stays=True)
            raise ValueError
        assert kept.count() == 4 and labels(stored(spark) - before) == ["outer"]
        last = materialize(spark.range(5), "last", stays=True)
    assert last.count() == 5 and labels(stored(spark) - before) == ["last"]
    assert spark.conf.get(setting) == cleaned
