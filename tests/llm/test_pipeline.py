"""The pipeline against a plain version: each stage's rows by brute force from the rows before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirespark.llm import common, near_dedup, quality_classifier, quality_rules

from .test_decontaminate import brute as brute_leaks
from .test_near_dedup import brute_fingerprint
from .test_tokens import WORDS
from .test_tokens import brute as brute_ids

pipeline = pytest.importorskip("corpus_pipeline")


def fast_roots(fps):
    roots = np.arange(len(fps))
    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        j = np.flatnonzero(np.bitwise_count(x[: i + 1] ^ x[i]) <= 4)
        near_dedup.merge(roots, np.full(len(j), i), j)
    return roots.tolist()


def test_stages(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rules, classify, dedup, leaks, pack = (f for _, f in pipeline.STAGES)
    kept = rules(spark, documents, small)
    assert kept.columns == documents.columns
    want = {r.doc_id for r in quality_rules.judged(documents).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    kept = classify(spark, kept, small)
    ratings = spark.read.parquet(f"{small}/labels.parquet")
    want &= {r.doc_id for r in quality_classifier.graded(documents, ratings).filter("kept").collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == documents.columns and set(rows) == want
    kept = dedup(spark, kept, small)
    ids = sorted(rows)
    roots = fast_roots([brute_fingerprint(rows[i]) for i in ids])
    want = {ids[r] for r in roots}
    assert {r.doc_id for r in kept.collect()} == want
    kept = leaks(spark, kept, small)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want -= {d for d, _ in brute_leaks([(i, rows[i]) for i in want], items)}
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == want
    got = pack(spark, kept, small).collect()
    lengths = {d: len(x) for d, x in brute_ids(WORDS, [(i, rows[i]) for i in want], 1)}
    assert {r.doc_id for r in got} == want
    assert all(sum(r.length for r in got if r.doc_id == d) == lengths[d] for d in list(lengths)[:50])
    run = pipeline.run(spark, small).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, got))


GOOD = "It was a long way from the old harbour to the small town in the hills and nobody knew how the {} road had been made or by whom it was used in the winter of that {} year"


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keeper string, __p_top int, hash long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 0), (900, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, GOOD.format("leaked", "leaked"))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, a very long text, columns whose names the stages use themselves."""
    other = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, other(i), "en", "s", 1, "k", 2, 3) for i in range(12)] + [(3, other(3), "en", "s", 1, "k", 2, 3)] * 2 + [(40, other(5), None, None, None, None, None, None), (None, other(20), None, "s", None, None, None, None)]
    rows += [(50, None, "en", "s", 0, None, None, None), (51, "", "en", "s", 0, None, None, None), (52, "so it is: " + GOOD.format("leaked", "leaked"), "en", "s", 0, "x", 1, 1), (53, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000)), "en", "s", 0, None, None, None)]
    docs = odd_tables(spark, tmp_path, rows)
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    got = pipeline.run(spark, str(tmp_path)).collect()
    want = {*range(12), None, 53}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got} == want and kept.count() == len(want)
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    texts = {r[0]: r[1] for r in rows}
    assert lengths == {d: len(x) for d, x in brute_ids(WORDS, [(d, texts[d]) for d in want], 1)}


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_broken_texts_and_the_greatest_id(spark, small, tmp_path):
    """Bytes that are no UTF-8 and a rated document whose id has no successor pass all stages, as they are."""
    docs, ratings = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    one = ratings.filter("quality = 1 and toxic = 0").agg(F.min("doc_id")).first()[0]
    moved = lambda t: t.withColumn("doc_id", F.when(F.col("doc_id") == one, F.lit(2**63 - 1)).otherwise(F.col("doc_id")))
    broken = F.when(F.col("doc_id") % 20 == 0, F.expr("cast(concat(cast(text as binary), X'20C320FF') as string)")).otherwise(F.col("text"))
    moved(docs.withColumn("text", broken)).write.parquet(f"{tmp_path}/documents.parquet")
    moved(ratings).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.filter("doc_id % 20 = 0").count() > 0, name
        assert name == "packing" or kept.filter("doc_id % 20 = 0 and right(hex(text), 8) <> '20C320FF'").isEmpty(), name
    assert spark.read.parquet(f"{tmp_path}/quality_classifier").filter(f"doc_id = {2**63 - 1}").count() == 1


def test_stages_send_texts_in_light_batches(spark, small):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('some words ', 300) text")
    for name, stage in pipeline.STAGES:
        spark.conf.unset(limit)
        stage(spark, documents, small)
        assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 1.1 * common.BATCH, name
    spark.conf.set(limit, "1m")
    common.light_batches(spark)
    assert spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)
