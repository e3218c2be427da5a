from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.interactions import item_popularity
from tidemark.plans.fixtures import event_log
from tidemark.streaming.popularity import first_interactions, running_popularity, windowed_popularity


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    log = event_log(spark, sf_dir).select("user_id", "item_id", F.col("ts").cast("timestamp").alias("ts"))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = {r["item_id"]: (r["n"], r["long_tail"]) for r in drained(running_popularity(stream()), "popularity", "complete").collect()}
    assert got == {r["item_id"]: (r["n"], r["n"] == 1) for r in item_popularity(log).collect()}
    pairs = drained(first_interactions(stream(), "100000 days"), "pairs", "append")
    assert pairs.count() == log.select("user_id", "item_id").distinct().count()
    days = drained(windowed_popularity(stream(), delay="100000 days"), "days", "update").groupBy("window", "item_id").agg(F.max("n").alias("n"))
    assert days.agg(F.sum("n")).first()[0] == log.count()
