"""Streaming ingest: deduplicated events, merged rollups, closed buckets, sessions.

Every sink works on whole micro-batches by their number, so a batch that is run again after a
failure overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meridio.operators.rollups import event_rollup, session_rollup

NAME = r"^[a-zA-Z0-9_.-]+$"
KEYS = ["project_id", "kind", "event_id"]


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with a reason."""
    reason = F.when(F.coalesce(F.col("kind"), F.lit("")) == "", "kind_missing").when(~F.col("kind").rlike(NAME), "kind_invalid").when(F.col("occur_time").isNull(), "time_missing").when(F.coalesce("distinct_id", F.lit("")) == "", "identity_missing")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def unique(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Duplicate deliveries of (project, kind, event_id) within the watermark are dropped."""
    return stream.withWatermark("occur_time", late).dropDuplicatesWithinWatermark(["project_id", "kind", "event_id"])


def delivered_first(rows: DataFrame, folder: str, number: int) -> DataFrame:
    """rows of a batch without repeats of (project, kind, event_id), in it or in the events of earlier batches, however late."""
    spark = rows.sparkSession
    once = rows.where("event_id is not null").dropDuplicates(KEYS).unionByName(rows.where("event_id is null"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return once
    schema = rows.select(*KEYS).schema.add("batch", "long")
    seen = spark.read.schema(schema).parquet(f"{folder}/events").where(F.col("batch") < number).select(*KEYS).alias("seen")
    return once.alias("now").join(seen, F.expr(" and ".join(f"now.{k} {'=' if k == 'event_id' else '<=>'} seen.{k}" for k in KEYS)), "left_anti")


def maintain(stream: DataFrame, folder: str, checkpoint: str, dims: tuple[str, ...]) -> StreamingQuery:
    """Write events, rejected rows and partial rollups of each batch under folder, by batch number; redelivered events are dropped."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        good, bad = accepted(rows)
        good = delivered_first(good, folder, number).persist()
        month = (F.year("occur_time") * 100 + F.month("occur_time")).cast("int")
        good.withColumn("occur_month", month).write.mode("overwrite").partitionBy("occur_month").parquet(f"{folder}/events/batch={number}")
        bad.write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        event_rollup(good, dims).write.mode("overwrite").parquet(f"{folder}/event_rollup/batch={number}")
        session_rollup(good, dims).write.mode("overwrite").parquet(f"{folder}/session_rollup/batch={number}")
        good.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_buckets(stream: DataFrame, late: str = "5 minutes") -> DataFrame:
    """kind, bucket, count of 5-minute buckets, each once it is closed."""
    return stream.withWatermark("occur_time", late).groupBy(F.window("occur_time", "5 minutes"), "kind").agg(F.count("*").alias("count")).select(F.col("window.start").alias("bucket"), "kind", "count")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """distinct_id, start_time, end_time, event_count of sessions of activity."""
    w = F.session_window("occur_time", gap)
    found = stream.withWatermark("occur_time", late).groupBy(w, "distinct_id").agg(F.count("*").alias("event_count"), F.min("occur_time").alias("start_time"), F.max("occur_time").alias("end_time"))
    return found.select("distinct_id", "start_time", "end_time", "event_count")
