"""Profile and alias logs: versioned rows appended, and the pipelines that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meridio.operators.identity import identify_all
from meridio.sources.tables import Tables

PROFILE = "id string, project_id string, external_id string, properties string, is_deleted int, create_time timestamp, update_time timestamp, insert_time timestamp"
ALIAS = "alias_id string, profile_id string, external_id string, project_id string, insert_time timestamp"


def profile_rows(messages: DataFrame) -> DataFrame:
    """Rows of the profile log from upserts and deletions: no properties are an empty object, a deletion is a tombstone."""
    now = F.coalesce("insert_time", F.current_timestamp()) if "insert_time" in messages.columns else F.current_timestamp()
    return messages.select(
        "id", "project_id", F.coalesce("external_id", F.lit("")).alias("external_id"), F.coalesce("properties", F.lit("{}")).alias("properties"),
        F.coalesce("is_deleted", F.lit(False)).cast("int").alias("is_deleted"), "create_time", "update_time", now.alias("insert_time"),
    )


def append(rows: DataFrame, folder: str, number: int = 0) -> None:
    """A batch of a log under its number: a batch that is written again replaces what it wrote."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def read_profiles(spark, folder: str) -> DataFrame:
    return spark.read.schema(PROFILE).parquet(folder).withColumn("properties", F.parse_json("properties"))


def read_aliases(spark, folder: str) -> DataFrame:
    return spark.read.schema(ALIAS).parquet(folder)


def maintain(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The upsert pipeline: valid messages to the profile log, the others to rejected."""
    valid = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("project_id", F.lit("")) != "")

    def batch(rows: DataFrame, number: int) -> None:
        append(profile_rows(rows.where(valid)), f"{folder}/profiles", number)
        append(rows.where(~valid), f"{folder}/rejected", number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def identify_batch(spark, requests: DataFrame, folder: str, number: int) -> None:
    """The identify pipeline, for one batch: profiles found by external id or made, anonymous ones merged, buried and named."""
    before = lambda log: log.where(F.col("batch") < number).drop("batch")  # noqa: E731  what this batch wrote before is not read
    profiles = before(spark.read.schema(PROFILE + ", batch long").parquet(f"{folder}/profiles")).withColumn("properties", F.parse_json("properties"))
    rows, aliases = identify_all(Tables(None, profiles), requests)
    append(rows.withColumn("properties", F.to_json("properties")), f"{folder}/profiles", number)
    append(aliases, f"{folder}/aliases", number)
