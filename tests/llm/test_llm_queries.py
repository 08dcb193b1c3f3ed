"""The registered queries over the smallest provided tables."""

import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as contract  # noqa: E402
from callsift.llm.catalog import QUERIES, SQL  # noqa: E402
from checks import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")
COLUMNS = {
    "op1_source_mix": "doc_id size source_size target taken",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_prefix_targets": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_cross_polytope": "query_id rank vec_id score",
    "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_jaccard_join": "doc_id n_shingles component_id",
    "op7_decision_list": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_virtual_slots": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_contextual_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_shallot_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_pattern_grammar": "doc_id held_out score predicted",
    "op13_skip_list_infill": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS)
    assert set(COLUMNS) | {"pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "SQL", SQL)
    assert compare.differences(spark, compare.connect(FOLDER), FOLDER, name) == []


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_whole_tables(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if "doc_id" in got.columns:
        assert got.select("doc_id").distinct().count() == docs.count()


def test_held_out_fold(spark):
    for r in QUERIES["op2_language_id"](spark, FOLDER).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
