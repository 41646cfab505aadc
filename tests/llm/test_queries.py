"""The registered queries: names, columns, and SQL where there is some."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import pytest

import __spark_entry__ as E
from adlens.llm.queries import ORACLES, QUERIES
from conftest import SF_SMALL
from oracle_check import digest, duck

COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op3_pii": ["doc_id", "text"],
    "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_nearest": ["query_id", "rank", "vec_id", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_line_dedup": ["doc_id", "source", "text"],
    "op11_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op13_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


def test_every_operator_has_its_query():
    assert set(QUERIES) == set(COLUMNS)
    assert {*QUERIES, "pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    if name == "op8_nearest":
        n = 5 * spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").where("vec_id % 50 = 0").count()
    if name != "op12_source_divergence":  # held against its SQL below
        assert df.count() == n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(cols)
    assert digest(sdf.columns, [tuple(r) for r in sdf.collect()])[0] == digest(cols, res.fetchall())[0]
