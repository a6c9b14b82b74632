"""The stages one after the other, each on what the one before kept."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest

from samplekit.llm import packing
from samplekit.llm.common import slices

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.count() == len(left)
            assert docs.where("n_chars <> length(text)").count() == 0
        ids = left
    run = corpus_pipeline.run(spark, DATA)
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(run) == key(docs)


def test_odd_rows_and_empty_tables(spark, docs, nothing, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "some item text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (own, own.limit(0)):
        at = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{frame is own}-{k}")
            stage(spark, at, str(tmp_path)).write.parquet(path)
            at = spark.read.parquet(path)
        assert (at.count() > 0) == (frame is own)


def test_rows_without_or_with_a_repeated_id_are_documents(spark, tmp_path):
    from conftest import words

    item = words(77, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    same = words(5, 80)
    rows = [(None, words(i, 80), "en") for i in range(6)] + [(7, words(20, 80), "en"), (7, words(21, 80), "en"), (7, f"{words(22, 900)} {item}", "en"), (None, same, "en"), (9, same, "en"), (8, same, "en"), (None, f"{words(23, 30)} {item}", "en"), (7, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter({None: 6, 7: 4, 8: 1})
    assert {r.doc_id for r in got if r.text == same} == {8}
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.where("text = 'short'").count() == 0 and kept.where("doc_id = 7").count() == 3
    clean = {(r.doc_id, r.text.strip()) for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert clean == {(i, t.replace(item, "").strip()) for i, t, _ in rows if t != f"{words(23, 30)} {item}"}


NAMES = "row r1 r2 own_id text_key id body node band bands h n fp k1 k2 sketch shingles component first line_stats kept keys of site line hits spans own_key key of_key __r1 __r2 __kept __hits __row __key __of __spans __drop_row words cell start cut bin d2 lead share salt seq".split()


def test_no_column_of_the_caller_is_touched(spark, docs, tmp_path):
    """Each stage gets a table with the names that it uses itself as further columns, and gives them back unchanged."""
    from samplekit.llm import pii
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "some item text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    marked = base.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in NAMES)).cache()
    for name, stage in [*corpus_pipeline.STAGES[:-1], ("pii", lambda spark, docs, _: pii.generalise(docs))]:
        out = stage(spark, marked, str(tmp_path))
        assert out.columns == marked.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES), name
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, base, str(tmp_path)).collect()}
    assert corpus_pipeline.pack(spark, marked, str(tmp_path)).count() >= marked.count()
    marked.unpersist()


def test_workers_forget_what_other_stages_remembered():
    packing.encoder(corpus_pipeline.tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array([b"some words"])], names=["body"])
    assert len(list(slices([batch], own=packing._encoders))) == 1 and packing._encoders
    assert len(list(slices([batch]))) == 1 and not packing._encoders
