"""The pipeline, stage by stage, each judged on what its predecessor kept."""

import collections

import pytest

import corpus_pipeline
from test_operators import groups, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, odd_docs, items, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    items.write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = odd_docs, [odd_docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs)
    return str(folder), kept


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    assert all(d.columns == COLUMNS for d in stages[1][:-1])


def test_each_stage_does_its_part(stages):
    start, judged, single, cut, clean, packed = ([tuple(r) for r in d.collect()] for d in stages[1])
    assert {r[0] for r in start} - {r[0] for r in judged} >= {6, 7, 8, 9, 10, 11, 16, 17}
    assert {0, 3, 4, 12, 19, 21, None} <= {r[0] for r in judged}
    firsts = {(r[0], r[1]) for r, g in zip(judged, groups(judged, 5), strict=True) if g[3]}
    assert collections.Counter((r[0], r[1]) for r in single) == collections.Counter(firsts)
    left = {r[0]: r[1] - r[2] for r in repeats(single) if r[1] - r[2]}
    assert {r[0]: len(r[1].encode()) for r in cut} == left
    assert all(r[4] == len(r[1]) for r in cut)
    assert {r[0] for r in cut} - {r[0] for r in clean} == {19}
    assert {r[0] for r in packed} == {r[0] for r in clean}


def test_tables_without_rows(spark, stages, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, stages[0]).count() == 0
