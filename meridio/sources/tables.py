"""Canonical tables, and the adapters of the driver's parquet tables to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridio.functions.props import STRING_COLUMNS

ZERO = "00000000-0000-0000-0000-000000000000"


@dataclass
class Tables:
    events: DataFrame
    profiles: DataFrame | None = None
    aliases: DataFrame | None = None

    def of_project(self, project: str) -> Tables:
        """The rows of one project; all rows where none is named."""
        own = lambda df: df if df is None or not project else df.where(F.col("project_id") == project)
        return Tables(own(self.events), own(self.profiles), own(self.aliases))


def canonical(df: DataFrame) -> DataFrame:
    """df with every canonical column that it lacks, empty."""
    out = df
    have = set(df.columns)
    fill = {"project_id": F.lit("p1"), "session_id": F.lit(ZERO), "insert_time": F.col("occur_time"), "bot_score": F.lit(None).cast("short"), "verified_bot": F.lit(None).cast("boolean"), "mobile": F.lit(False)}
    fill |= {c: F.lit("") for c in STRING_COLUMNS}
    fill |= {m: F.expr("cast(map() as map<string,variant>)") for m in ("auto", "custom")}
    missing = {c: x for c, x in fill.items() if c not in have}
    return out.withColumns(missing) if missing else out


def sessionized(events: DataFrame, gap_seconds: int) -> DataFrame:
    """session_id from gaps of inactivity: the user and the number of the session."""
    w = Window.partitionBy("distinct_id").orderBy("occur_time", "event_id")
    gap = F.unix_micros("occur_time") - F.lag(F.unix_micros("occur_time")).over(w)
    n = F.sum(F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0)).over(w)
    return events.withColumn("session_id", F.concat_ws("-", "distinct_id", n.cast("string")))


def driver_events(spark: SparkSession, sf_dir: str, country: bool = False, session_gap: int | None = None) -> DataFrame:
    """The events table: value and k as custom properties; optionally countries and sessions."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("distinct_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("occur_time"),
        F.map_from_arrays(
            F.array(F.lit("value"), F.lit("k")), F.array(F.col("value").cast("variant"), F.get_json_object("props", "$.k").cast("bigint").cast("variant"))
        ).alias("custom"),
    )
    if country:
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
        where = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").cast("string").alias("distinct_id"), F.col("n_name").alias("country"))
        rows = rows.join(where, "distinct_id", "left").withColumn("country", F.coalesce("country", F.lit("")))
    if session_gap:
        rows = sessionized(rows, session_gap)
    return canonical(rows)


def driver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of a long range: kind is the priority, value the price."""
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return canonical(
        raw.select(
            F.col("o_orderkey").cast("string").alias("event_id"),
            F.col("o_custkey").cast("string").alias("distinct_id"),
            F.col("o_orderpriority").alias("kind"),
            F.col("o_orderdate").cast("timestamp").alias("occur_time"),
            F.map_from_arrays(F.array(F.lit("value")), F.array(F.col("o_totalprice").cast("variant"))).alias("custom"),
        )
    )


def driver_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as profiles; every profile has one alias, 'anon-' and its id."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("c_custkey"))
    profiles = c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.lit("p1").alias("project_id"),
        F.col("c_name").alias("external_id"),
        F.parse_json(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))).alias("properties"),
        F.lit(0).alias("is_deleted"),
        at.alias("create_time"),
        at.alias("update_time"),
        at.alias("insert_time"),
    )
    aliases = c.select(
        F.concat(F.lit("anon-"), F.col("c_custkey").cast("string")).alias("alias_id"), F.col("c_custkey").cast("string").alias("profile_id"), F.col("c_name").alias("external_id"), F.lit("p1").alias("project_id"), at.alias("insert_time")
    )
    return profiles, aliases


def latest(log: DataFrame, key: str) -> DataFrame:
    """The last row of each key of a log; ties by the whole row are of equal rows only in their order."""
    order = F.struct("insert_time", *[c for c in log.columns if c not in ("properties", "insert_time", "project_id", key)])
    return log.groupBy("project_id", key).agg(F.max_by(F.struct(*log.columns), order).alias("__row")).select("__row.*")


def write_events(events: DataFrame, path: str) -> None:
    """Append events without duplicate deliveries, partitioned by month."""
    unique = deduplicated(events)
    out = unique.withColumn("occur_month", (F.year("occur_time") * 100 + F.month("occur_time")).cast("int"))
    out.write.mode("append").partitionBy("occur_month").option("parquet.bloom.filter.enabled#distinct_id", "true").parquet(path)


def deduplicated(events: DataFrame) -> DataFrame:
    """One row for each (project, minute, kind, event_id)."""
    return events.withColumn("__minute", F.date_trunc("minute", "occur_time")).dropDuplicates(["project_id", "__minute", "kind", "event_id"]).drop("__minute")


def delete_ids(events: DataFrame, ids: DataFrame, column: str = "distinct_id") -> DataFrame:
    """events without those of the ids; the caller rewrites the partitions that change."""
    return events.join(ids.select(column).distinct(), column, "left_anti").select(*events.columns)
