"""Identity: latest profiles and aliases, the union of a person's ids, merges, erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.sources.shared import new_path
from meridio.sources.tables import ZERO, delete_ids, latest


def live_profiles(tables) -> DataFrame:
    return latest(tables.profiles, "id").where("is_deleted = 0")


def identity_union(tables) -> DataFrame:
    """distinct_id, profile_id: ids and external ids of live profiles and their aliases; one profile for each id, the smallest."""
    live = live_profiles(tables)
    own = live.select(F.explode(F.array_distinct(F.array("id", "external_id"))).alias("distinct_id"), F.col("id").alias("profile_id"))
    aliases = latest(tables.aliases, "alias_id").join(live.select(F.col("id").alias("profile_id")), "profile_id", "left_semi")
    return own.union(aliases.select("alias_id", "profile_id")).where("distinct_id <> ''").groupBy("distinct_id").agg(F.min("profile_id").alias("profile_id"))


def resolve(tables, any_id: str) -> DataFrame:
    """distinct_id: all ids of the person whom an id names: a profile id before an alias before an external id."""
    p, a = latest(tables.profiles, "id"), latest(tables.aliases, "alias_id")
    named = (
        p.where(F.col("id") == any_id).select(F.lit(0).alias("rank"), "id")
        .union(a.where(F.col("alias_id") == any_id).select(F.lit(1), "profile_id"))
        .union(p.where((F.col("external_id") == any_id) & (F.col("external_id") != "")).select(F.lit(2), "id"))
        .orderBy("rank", "id").limit(1).select(F.col("id").alias("profile_id"))
    )
    one = F.broadcast(named)
    own = p.join(one, F.col("id") == F.col("profile_id")).select(F.explode(F.array("id", "external_id")).alias("distinct_id"))
    return own.union(a.join(one, "profile_id").select("alias_id")).union(tables.profiles.sparkSession.createDataFrame([(any_id,)], "distinct_id string")).where("distinct_id <> ''").distinct()


def get_profile(tables, any_id: str, external: bool = False) -> DataFrame:
    """The live profile of an id, or of the alias that it is; by external id, none for an empty one."""
    live = live_profiles(tables)
    if external:
        return live.where((F.col("external_id") == any_id) & F.lit(any_id != ""))
    hop = latest(tables.aliases, "alias_id").where(F.col("alias_id") == any_id).select(F.col("profile_id").alias("id"), F.lit(1).alias("rank"))
    ids = live.where(F.col("id") == any_id).select("id", F.lit(0).alias("rank")).union(hop).orderBy("rank").limit(1)
    return live.join(F.broadcast(ids.select("id")), "id")


def identify_all(tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the logs of profiles and aliases for requests (project_id, external_id, anonymous_id, properties, at).

    The profile of the external id is the live one, or a new one; its properties are those of the anonymous profiles, under its
    own, under those of the requests, the later over the earlier, key by key. Anonymous profiles are buried and become aliases.
    """
    maps = lambda c: F.coalesce(F.col(c).cast("map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    asked = requests.where("coalesce(external_id, '') <> ''").withColumn("who", F.struct("project_id", "external_id"))
    live = latest(tables.profiles, "id").where("is_deleted = 0")
    known = live.where("external_id <> ''").groupBy("project_id", "external_id").agg(F.min("id").alias("id"))
    made = F.concat(F.lit("p-"), F.substring(F.sha2(F.concat_ws("\0", "project_id", "external_id"), 256), 1, 32))
    target = asked.groupBy("project_id", "external_id").agg(F.max("at").alias("at")).join(known, ["project_id", "external_id"], "left").withColumn("target", F.coalesce("id", made)).drop("id")
    named = asked.join(target.drop("at"), ["project_id", "external_id"]).where("coalesce(anonymous_id, '') <> '' and anonymous_id <> target")
    own = live.select("project_id", "id", "properties", "create_time")
    # one row for each source of keys: 0 anonymous, 1 the profile itself, 2 requests
    before = named.select("project_id", "external_id", F.col("anonymous_id").alias("id"), "at").join(own, ["project_id", "id"]).select("project_id", "external_id", F.lit(0).alias("rank"), "at", maps("properties").alias("m"))
    itself = target.select("project_id", "external_id", F.col("target").alias("id"), "at").join(own, ["project_id", "id"]).select("project_id", "external_id", F.lit(1).alias("rank"), "at", maps("properties").alias("m"))
    given = asked.select("project_id", "external_id", F.lit(2).alias("rank"), "at", maps("properties").alias("m"))
    keys = before.union(itself).union(given).select("project_id", "external_id", "rank", "at", F.explode("m").alias("k", "v"))
    merged = keys.groupBy("project_id", "external_id", "k").agg(F.max_by("v", F.struct("rank", "at")).alias("v"))
    merged = merged.groupBy("project_id", "external_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    created = own.select("project_id", F.col("id").alias("target"), "create_time")
    empty = F.expr("cast(map() as map<string,variant>)")
    rows = target.join(merged, ["project_id", "external_id"], "left").join(created, ["project_id", "target"], "left").select(
        F.col("target").alias("id"), "project_id", "external_id", F.to_variant_object(F.coalesce("m", empty)).alias("properties"), F.lit(0).alias("is_deleted"),
        F.coalesce("create_time", "at").alias("create_time"), F.col("at").alias("update_time"), F.col("at").alias("insert_time"),
    )
    once = named.groupBy("project_id", "anonymous_id").agg(F.max_by(F.struct("target", "external_id", "at"), F.struct("at", "external_id")).alias("x"))
    buried = once.select("project_id", F.col("anonymous_id").alias("id"), "x.at").join(live.drop("insert_time"), ["project_id", "id"]).select(
        "id", "project_id", "external_id", "properties", F.lit(1).alias("is_deleted"), "create_time", F.col("at").alias("update_time"), F.col("at").alias("insert_time")
    )
    aliases = once.select(F.col("anonymous_id").alias("alias_id"), F.col("x.target").alias("profile_id"), "x.external_id", "project_id", F.col("x.at").alias("insert_time"))
    return rows.unionByName(buried), aliases


def frozen_scope(tables, any_id: str) -> tuple[DataFrame, DataFrame]:
    """The ids of a person, and (project_id, session_id) of their sessions: written down before anything is deleted, so that a second try deletes the same."""
    ids, path = resolve(tables, any_id), new_path(tables.events.sparkSession, "scope")
    ids.write.parquet(f"{path}/ids")
    spark = tables.events.sparkSession
    ids = spark.read.schema("distinct_id string").parquet(f"{path}/ids")
    own = tables.events.join(F.broadcast(ids), "distinct_id", "left_semi").where(F.col("session_id") != ZERO)
    own.select("project_id", "session_id").distinct().write.parquet(f"{path}/sessions")
    return ids, spark.read.schema("project_id string, session_id string").parquet(f"{path}/sessions")


def erase(tables, any_id: str, sessions: DataFrame | None = None, activity: DataFrame | None = None) -> dict[str, DataFrame]:
    """What stays of each table once a person is erased: the session rollup and activity too, if given; event rollups are exempt."""
    ids, theirs = frozen_scope(tables, any_id)
    out = {
        "events": delete_ids(tables.events, ids),
        "profiles": tables.profiles.join(ids, F.col("id") == F.col("distinct_id"), "left_anti"),
        "aliases": tables.aliases.join(ids, F.col("alias_id") == F.col("distinct_id"), "left_anti").join(ids, F.col("profile_id") == F.col("distinct_id"), "left_anti"),
    }
    if sessions is not None:
        out["sessions"] = sessions.join(theirs, ["project_id", "session_id"], "left_anti").select(*sessions.columns)
    if activity is not None:
        out["activity"] = delete_ids(activity, ids)
    return out
