from __future__ import annotations

from datetime import datetime

from fieldloom.operators import bmu
from fieldloom.streaming import scoring


def test_stream_scores_like_a_batch(spark, tmp_path):
    fields = spark.createDataFrame([(k, datetime(2020, 1, 1 + k), [float(k % 3), 1.0, 2.0 - k % 2]) for k in range(12)], "t long, at timestamp_ntz, vec array<double>")
    protos = spark.createDataFrame([(0, [0.0, 1.0, 2.0]), (1, [2.0, 1.0, 1.0])], "node int, vec array<double>")
    fields.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields.schema).parquet(str(tmp_path / "in"))
    q = scoring.score_stream(stream, protos, "euclidean").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    want = sorted((r["t"], r["node"]) for r in bmu.assign(fields, protos, "euclidean").collect())
    assert sorted((r["t"], r["node"]) for r in spark.sql("select t, node from scored").collect()) == want
    counts = scoring.occupancy_stream(scoring.score_stream(stream, protos, "euclidean"), "at", "4 days", "1 day")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == 12
