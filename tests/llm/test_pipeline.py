"""The pipeline: every stage's columns and effect, and whole ids in the last."""

import zlib

import numpy as np

import corpus_pipeline as C
from tessera.llm import common, wordbpe
from tessera.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame(
        [(10_001, "12345 67890", "en", "src1", 11), (10_002, None, "en", "src1", 0), (10_003, docs.first().text, "en", "src2", 1), (10_004, "the password = Zx81mNp4Lk27aa of the and with it", "en", "src9", 1)],
        docs.schema,
    )
    now, sizes = docs.unionAll(planted), {}
    for name, stage in C.STAGES:
        got = materialize(stage(spark, now, SF), name)
        if name != "packing":
            assert got.columns == docs.columns
        sizes[name] = now = got
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in sizes.items()}
    assert {10_001, 10_002} & ids["language_id"] == set() and 10_003 in ids["language_id"]
    assert 10_003 not in ids["ngram_jaccard"]
    assert ids["substring_dedup"] <= ids["ngram_jaccard"] and ids["secret_scan"] == ids["substring_dedup"] == ids["packing"]
    assert "<secret>" in sizes["secret_scan"].where("doc_id = 10004").first().text
    clean = ids["ngram_jaccard"] - {10_003, 10_004}
    assert len(clean) > 0.8 * docs.count()
    enc = wordbpe.encoder(common.tokenizer_path())
    text = {r.doc_id: r.text for r in sizes["secret_scan"].collect()}
    for r in sizes["packing"].collect():
        own = np.append(enc.encode(text[r.doc_id]), 1).astype("<u4")
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_run_gives_rows(spark):
    assert C.run(spark, SF).count() > 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, label int, rank int"


def run_stages(spark, docs):
    for name, stage in C.STAGES:
        got = materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert got.columns == docs.columns
        docs = got
        yield name, got


def test_an_empty_table_gives_none(spark):
    assert [got.count() for _, got in run_stages(spark, spark.createDataFrame([], CLASH))] == [0] * 5


def test_repeats_clashing_columns_and_long_texts(spark):
    words = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60).collect()
    long = " ".join(r.text for r in words) + " "
    rows = [(r.doc_id, r.text, r.lang, r.source, 1, 0.5, "x", 1, 2) for r in words]
    rows += rows[:3] + [(5_000, None, None, None, None, None, None, None, None), (None, words[0].text, "en", "s", 1, 0.5, "x", 1, 2)]
    rows += [(5_001, long * 10, "en", "s", 1, 0.5, "x", 1, 2)]
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    found = dict(run_stages(spark, docs))
    labelled = found["language_id"]
    assert labelled.where("doc_id = 5000").count() == 0 and labelled.where("doc_id IS NULL").count() == 1
    once = [r.doc_id for r in found["ngram_jaccard"].collect()]
    assert len(once) == len(set(once)) and None in once and 5_001 in once
    assert found["packing"].where("doc_id = 5001").count() >= 0


def test_a_table_without_n_chars(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    assert C.cut_repeats(spark, docs, SF).columns == docs.columns == C.hide_secrets(spark, docs, SF).columns
