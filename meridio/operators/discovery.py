"""Discovery of event names, property keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.operators.rollups import EVENT_DIMS, TOTAL

NAMES_LIMIT, KEYS_LIMIT, VALUES_LIMIT, VALUES_DAYS = 1000, 500, 100, 30
#: The type of a variant's slot, as keys are listed with.
TYPES = {"STRING": "string", "BIGINT": "int", "DOUBLE": "double", "BOOLEAN": "bool", "TIMESTAMP": "timestamp"}


def event_names(tables) -> DataFrame:
    return tables.events.groupBy("kind").agg(F.count("*").alias("count"), F.max("occur_time").alias("last_seen")).orderBy(F.desc("count"), "kind").limit(NAMES_LIMIT)


def value_type(kind):
    out = F.lit("other")
    for k, v in TYPES.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.when(kind.startswith("DECIMAL"), "double").otherwise(out)


def key_buckets(events: DataFrame) -> DataFrame:
    """source, kind, key, value_type, bucket (5 minutes), count, last_seen: the mergeable state of the property keys."""
    def part(column: str, source: str) -> DataFrame:
        rows = events.select("kind", "occur_time", F.explode(column).alias("key", "value"))
        keys = [F.lit(source).alias("source"), "kind", "key", value_type(F.schema_of_variant("value")).alias("value_type"), F.window("occur_time", "5 minutes")["start"].alias("bucket")]
        return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.max("occur_time").alias("last_seen"))

    return part("auto", "auto").unionByName(part("custom", "custom"))


def property_keys(buckets: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """source, key, value_type (of the earliest sight), count, last_seen."""
    rows = buckets.groupBy("source", "key").agg(F.sum("count").alias("count"), F.min_by("value_type", F.struct("last_seen", "value_type")).alias("value_type"), F.max("last_seen").alias("last_seen"))
    rows = rows.where(F.col("value_type").isin(*allowed)) if allowed else rows
    return rows.orderBy(F.desc("count"), "key").limit(KEYS_LIMIT)


def depth(document) -> Column:
    """How deep objects and lists lie within each other, counted on the brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(document), r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def profile_keys(profiles: DataFrame) -> DataFrame:
    """key (dotted path of a leaf), value_type, count, for properties nested to any depth; lists are leaves."""
    level = profiles.select(F.col("properties").alias("v"), F.lit("").alias("path"))
    out = None
    for _ in range(max(1, profiles.agg(F.max(depth(F.col("properties")))).first()[0] or 0)):  # one number of one pass
        each = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).where("key is not null")
        each = each.select(F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("value").alias("v"))
        nested = F.schema_of_variant("v").startswith("OBJECT")
        leaves = each.where(~nested).select(F.col("path").alias("key"), value_type(F.schema_of_variant("v")).alias("value_type"))
        out = leaves if out is None else out.unionByName(leaves)
        level = each.where(nested).select("v", "path")
    return out.groupBy("key", "value_type").agg(F.count("*").alias("count"))


def schema(keys: DataFrame, rollup: DataFrame) -> DataFrame:
    """key, value_type, count: discovered automatic keys, and every promoted string property, which the map no longer holds.

    Those that the rollup has as a dimension are counted there, 0 where it has no row; for the others the count of before
    their promotion stays.
    """
    names = [k for k, (_, kind) in props.PROMOTED.items() if kind == "string"]
    found = keys.where(~F.col("key").isin(names)).select("key", "value_type", "count")
    frozen = keys.where(F.col("key").isin([n for n in names if n not in EVENT_DIMS])).groupBy("key").agg(F.max("count").alias("was"))
    seen = promoted_key_counts(rollup).withColumnRenamed("count", "now")
    every = keys.sparkSession.createDataFrame([(n,) for n in names], "key string")
    counted = every.join(seen, "key", "left").join(frozen, "key", "left").select("key", F.lit("string").alias("value_type"), F.coalesce("now", "was", F.lit(0).cast("long")).alias("count"))
    return found.unionByName(counted).orderBy(F.desc("count"), "key")


def promoted_key_counts(rollup: DataFrame) -> DataFrame:
    """key, count of promoted properties that are set, from the event rollup; keys never seen count 0."""
    seen = rollup.where((F.col("dim") != TOTAL) & (F.col("dim_value") != "")).groupBy(F.col("dim").alias("key")).agg(F.sum("n").alias("count"))
    every = rollup.sparkSession.createDataFrame([(d,) for d in EVENT_DIMS], "key string")
    return every.join(seen, "key", "left").select("key", F.coalesce("count", F.lit(0).cast("long")).alias("count")).orderBy(F.desc("count"), "key")


def property_values(tables, name: str, now, kind: str = "") -> DataFrame:
    """Different values of a property in the last 30 days, the first hundred in order."""
    since = F.lit(now) - F.make_dt_interval(F.lit(VALUES_DAYS))
    rows = tables.events.where((F.col("occur_time") >= since) & (F.col("occur_time") < F.lit(now)))
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.select(props.prop_string(name).alias("value")).where("value <> ''").distinct().orderBy("value").limit(VALUES_LIMIT)
