import os

import pytest
from pyspark.sql import functions as F

from genomark.streaming import position_bins as P

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="no test data")
def test_stream_gives_the_batch_rows(spark, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(folder))
    batch = spark.read.parquet(str(folder))
    want = {tuple(r) for r in P.event_windows(batch, "ts", "1 day", "1 hour", ["event_type"], "value").select("start", "event_type", "n").collect()}
    stream = P.event_windows(spark.readStream.schema(batch.schema).parquet(str(folder)), "ts", "1 day", "1 hour", ["event_type"], "value").select("start", "event_type", "n")
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("bins").collect()} == want and want


def test_sessions_and_bins(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 50), ("a", 4000)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["n"] for r in P.event_sessions(rows, "ts", "10 minutes", "1 hour", ["k"]).collect()) == [1, 2]
    g = spark.createDataFrame([("chr1", 5, 1e-9), ("chr1", 15, 0.5)], "chr string, pos int, pvalue double")
    assert sorted(tuple(r) for r in P.position_bins(g, 10, ["chr"]).collect()) == [("chr1", 0, 1e-9, 1, 1), ("chr1", 1, 0.5, 0, 1)]
