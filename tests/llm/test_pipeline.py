from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import decontam, pii, quality, simhash


def test_each_stage_does_its_work(spark, sf_dir, docs):
    labels, benchmark = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, after = now, stage(spark, now, sf_dir)
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "quality classifier":
            assert ids(after) == ids(quality.scores(before, labels).filter("predicted = 1"))
        elif name == "near-duplicates":
            groups = {}
            for r in simhash.near_duplicates(before, 5, simhash.WIDE, checked=True).collect():
                groups.setdefault(r["component_id"], []).append(r["doc_id"])
            assert ids(after) == sorted(min(g) for g in groups.values())
        elif name == "benchmark decontamination":
            assert ids(after) == ids(decontam.contamination(before, benchmark).filter("not contaminated"))
        elif name == "personal data":
            assert ids(after) == ids(before)
            assert pii.spans(after).filter("base <> ''").count() == 0
        else:
            assert after.agg({"taken": "sum"}).first()[0] > 0
            break
        assert after.columns == docs.columns
        now = spark.createDataFrame(after.collect(), docs.schema)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and len(corpus_pipeline.STAGES) in (4, 5)
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_odd_rows_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(None, "word word"), (1, None)], "item_id long, text string")
    clashing = odd_docs.withColumn("own", F.lit(1)).withColumn("x", F.lit("y")).withColumn("__rid", F.lit(2))
    for name, docs, label, items in (("odd", clashing, labels, benchmark), ("none", no_docs, labels.limit(0), benchmark.limit(0))):
        path = str(tmp_path / name)
        for table, df in (("documents", docs), ("labels", label), ("benchmark", items)):
            df.write.parquet(f"{path}/{table}.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = now.columns
            now = spark.createDataFrame(stage(spark, now, path).collect(), now.schema)
            assert now.columns == columns
        # of 12 rows: the copy of doc 1, the empty ones but for one, a repeat and the contaminated one are gone
        kept = {r["doc_id"]: r["text"] for r in now.collect()}
        assert set(kept) == (set() if name == "none" else {1, 3, 6, None, 7, 9, 10})
        rows = corpus_pipeline.run(spark, path).collect()
        sizes = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in kept.values())
        assert sum(r["taken"] for r in rows) == 3 * sizes // 2
        assert all(r["text"] and r["doc_id"] in kept for r in rows)
