import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontam, quality, shared
from strandline.llm.queries import QUERIES, SQL
from tests.compare import duck, rows
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_neardup import brute as components


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if name in SQL:
        assert rows(found) == rows(duck(sf_dir, SQL[name]))


def test_pipeline_by_brute_force(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "quality", "near_dedup", "decontamination", "sentencepiece"]
    known = shared.written(steps["language_id"](spark, docs, sf_dir), "t")
    good = shared.written(steps["quality"](spark, known, sf_dir), "t")
    scores = quality.scored(known, shared.table(spark, sf_dir, "labels"), shared.crc_mod(F.col("doc_id"), 4) == 2)
    assert {x.doc_id for x in good.collect()} == {x.doc_id for x in scores.where("predicted = 1").collect()}
    left = [(x.doc_id, x.text) for x in good.collect()]
    firsts = {i for i, (_, c) in components(left).items() if i == c}
    items = [(x.item_id, x.text) for x in shared.table(spark, sf_dir, "benchmark").collect()]
    clean = {r[0] for r in contaminated([x for x in left if x[0] in firsts], items) if not r[5]}
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "piece_ids", "lossless"]
    got = out.collect()
    assert {x.doc_id for x in got} == clean and all(x.lossless for x in got)


def test_stages_take_odd_rows(spark, sf_dir, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        if name != "sentencepiece":
            assert got.columns == odd.columns
        got.count()
        assert stage(spark, none, sf_dir).count() == 0
    assert decontam.WINDOW == 13
