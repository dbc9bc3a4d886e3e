"""Streaming upkeep with redelivered events."""

from pyspark.sql import functions as F

from meridio import queries
from meridio.operators import rollups
from meridio.streaming import ingest
from tests.oracle import SF


def test_redelivered_events_count_once(spark, tmp_path):
    events = queries.driver_events(spark, SF, country=True).drop("custom", "auto").orderBy("event_id").limit(400).cache()
    first, again = events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0), events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 0)
    batches = [first.unionByName(again), events, again]  # repeated in one batch, then across batches
    path = f"file://{tmp_path}"
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        ingest.maintain(stream, f"{path}/out", f"{path}/state", queries.DIMS).awaitTermination()
    got = spark.read.parquet(f"{path}/out/events")
    assert got.select("batch").distinct().count() == 2
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in events.collect())
    merged = rollups.merge_event_rollup(spark.read.parquet(f"{path}/out/event_rollup").drop("batch"))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in rollups.event_rollup(events, queries.DIMS).collect()}
    sessions = spark.read.parquet(f"{path}/out/session_rollup").drop("batch")
    assert {tuple(r) for r in rollups.merge_session_rollup(sessions).collect()} == {tuple(r) for r in rollups.session_rollup(events, queries.DIMS).collect()}
