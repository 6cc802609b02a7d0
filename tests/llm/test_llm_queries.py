"""The registered queries and the pipeline over the small tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.session import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_numbers_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_lm_score", "op6_language_id", "op7_ngram_join", "op8_bpe", "op1_pii_surrogates", "op11_tokenizer_alignment", "op13_quality_rules"])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in entry.queries()[name](spark, SF_DIR).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())


def test_languages_held_out_are_predicted(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    found = entry.queries()["op6_language_id"](spark, SF_DIR).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
        if name == "ngram_join":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] and sizes[4] == sizes[5] > 0


def test_stages_stand_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the house of the king", "en", "a", 21),
         (2, "the house of the king", "en", "a", 21), (3, "the house of the king", "en", None, 21),
         (4, "das haus des königs und der königin", "de", "b", 35), (5, "mail a@b.org das haus der leute", "de", "b", 31)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
    assert {r.doc_id for r in docs.collect()} <= {2, 4, 5}
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF_DIR), f"test-{name}")
    assert empty.count() == 0
