"""The reduction tree with many sources: nodes are small and spread over all tasks."""

from pyspark.sql import functions as F

from ledgerlens.llm import mixing


def test_many_sources_spread_over_tasks(spark):
    """One open row for each of 20,000 sources and three chunks, as they come to the second level: one chunk, 60,000 rows."""
    rows = spark.range(60_000).select(
        F.col("id").alias("uid"), F.concat(F.lit("s"), (F.col("id") % 20_000).cast("string")).alias("source"), (F.col("id") % 7 + 1).alias("size"), F.lit(0).alias("whole"), F.lit(0.5).alias("p"), F.lit(0).cast("long").alias("chunk"), F.xxhash64("id").alias("dice")
    )
    met = mixing.dealt(rows, 8).select("source", "chunk", F.spark_partition_id().alias("task"))
    tasks = [r["count"] for r in met.groupBy("task").count().collect()]
    assert len(tasks) == 8 and max(tasks) < 1.3 * 60_000 / 8
    nodes = met.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks")).agg(F.max("n"), F.max("tasks")).first()
    assert nodes[0] <= mixing.FAN_IN and nodes[1] == 1


def test_many_sources_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 500)
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), (F.col("id") % 1_500).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"))
    got = mixing.rounded(docs).groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("largest"), F.max(F.col("copies") * F.col("size") - 3 * F.col("size")).alias("over"))
    rows = got.collect()
    assert len(rows) == 1_500 and all(abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1 and r["over"] <= 0 for r in rows)
