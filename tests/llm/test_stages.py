"""The pipeline's stages on rows that the tables lack."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

from .conftest import ODD_ROWS, SF

INSIDE = ("_key", "_whole", "_row", "_later", "_toxicity", "__key", "whole", "later", "place", "part")


@pytest.fixture(scope="module")
def clashing(make_docs):
    rows = [r for r in ODD_ROWS if r[0] not in (11, 14)]
    return make_docs(rows).withColumns({c: F.lit(f"own {c}") for c in INSIDE})


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_odd_rows_and_clashing_names(spark, clashing, name, stage):
    plain = clashing.drop(*INSIDE)
    got, want = stage(spark, clashing, SF), stage(spark, plain, SF)
    shown = want.columns
    key = lambda r: str(tuple(r))
    assert sorted(got.select(*shown).collect(), key=key) == sorted(want.collect(), key=key)
    if name != "mixing_sources":
        assert got.columns == clashing.columns
        assert all(r[c] == f"own {c}" for r in got.collect() for c in INSIDE)
        assert got.where("doc_id = 5").count() == 1 or name == "ngram_jaccard_join"  # clean documents stay


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_empty_table(spark, make_docs, name, stage):
    got = stage(spark, make_docs([]), SF)
    assert got.collect() == [] and (name == "mixing_sources" or got.columns == make_docs([]).columns)


def test_without_labels_all_documents_stay(spark, make_docs, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert p.drop_toxic(spark, make_docs([(1, "a"), (None, None)]), str(tmp_path)).count() == 2


def test_a_run_over_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
