"""The registered corpus queries: columns, held-out rule, whole tables, SQL twins."""

import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import common, oracles, queries, wordbpe

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bradley_terry_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_gumbel_segmentations": {"doc_id": "bigint"},
    "op3_crf_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_suffix_tree_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5_trie_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_sum_of_squares_packing": dict.fromkeys("doc_id start length ids_crc32 doc_tokens sequence_id offset".split(), "bigint"),
    "op7_secret_ownership": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_iso_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op9_block_pruned_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10_token_dictionary_files": dict.fromkeys("doc_id start n_tokens ids_crc32".split(), "bigint"),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_whole_tables(spark, name):
    got = queries.QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    if "doc_id" in kinds:
        ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in rows} == ids
    if "held_out" in kinds:
        assert len(rows) == len(ids) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(oracles.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, got[order].astype(str).to_numpy())) == sorted(map(tuple, want[order].astype(str).to_numpy()))


def test_packed_and_stored_ids_are_those_of_the_library(spark):
    tk = wordbpe.encoder(common.tokenizer_path()).tokenizer
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: tk.encode(t, add_special_tokens=False).ids for i, t in text.items()}
    at = 0
    for r in sorted(queries.QUERIES["op10_token_dictionary_files"](spark, SF).collect(), key=lambda r: r.doc_id):
        own = np.array(ids[r.doc_id] + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    for r in queries.QUERIES["op6_sum_of_squares_packing"](spark, SF).collect():
        own = np.array(ids[r.doc_id] + [1], "<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
