"""People and activity: segments, explorer, feeds, heatmap, stats, persons, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.functions.filters import any_event, compare, keyset_after, scan
from meridio.operators.identity import identity_union, live_profiles, resolve
from meridio.operators.rollups import activity_states
from meridio.plans.spec import PropertyFilter, Request, SpecError
from meridio.sources.tables import latest

PAGE, MAX_PAGE, HEATMAP_DAYS = 100, 1000, 60
#: Automatic properties that a list of profiles can be filtered by, and their summary columns.
SUMMARY = {
    "$browser": "latest_browser", "$browserVersion": "latest_browser_version", "$os": "latest_os", "$osVersion": "latest_os_version",
    "$device": "latest_device", "$country": "latest_country", "$region": "latest_region", "$city": "latest_city",
}


def segment_users(tables, r: Request, after: str = "", size: int = PAGE) -> DataFrame:
    """distinct_id of a page of users who did one of the events; cookieless ids never."""
    rows = scan(tables, r.spec, r.start, r.end).where(any_event(r.spec.events)).where(props.identified(False))
    return rows.where(F.col("distinct_id") > after).select("distinct_id").distinct().orderBy("distinct_id").limit(size)


def explorer(tables, r: Request, cursor: tuple | None = None, size: int = PAGE) -> DataFrame:
    """A page of events, the latest first."""
    rows = scan(tables, r.spec, r.start, r.end)
    hit = any_event(r.spec.events)
    rows = rows if hit is None else rows.where(hit)
    page = rows.where(keyset_after("occur_time", "event_id", cursor)).orderBy(F.desc("occur_time"), F.desc("event_id"))
    return page.limit(min(size, MAX_PAGE)).select("occur_time", "event_id", "distinct_id", "kind")


def feed(tables, any_id: str, cursor: tuple | None = None, size: int = PAGE) -> DataFrame:
    """A page of the events of all ids of a person."""
    rows = tables.events.join(F.broadcast(resolve(tables, any_id)), "distinct_id", "left_semi")
    page = rows.where(keyset_after("occur_time", "event_id", cursor)).orderBy(F.desc("occur_time"), F.desc("event_id"))
    return page.limit(min(size, MAX_PAGE)).select("occur_time", "event_id", "distinct_id", "kind")


def heatmap(tables, any_id: str, now, days: int = HEATMAP_DAYS) -> DataFrame:
    """Events of a person by UTC day."""
    rows = tables.events.join(F.broadcast(resolve(tables, any_id)), "distinct_id", "left_semi")
    since = F.lit(now) - F.make_dt_interval(F.lit(days))
    return rows.where((F.col("occur_time") >= since) & (F.col("occur_time") < F.lit(now))).groupBy(F.to_date("occur_time").alias("day")).agg(F.count("*").alias("events"))


def stats(tables, any_id: str) -> DataFrame:
    """One row: first and last seen, number of events, and the latest known place and device."""
    rows = tables.events.join(F.broadcast(resolve(tables, any_id)), "distinct_id", "left_semi")
    at = F.struct("occur_time", "event_id")
    last = [F.max_by(c, at).alias(f"latest_{c}") for c in ("browser", "os", "device", "country", "region", "city", "platform")]
    return rows.agg(F.min("occur_time").alias("first_seen"), F.max("occur_time").alias("last_seen"), F.count("*").alias("events"), *last)


def persons(tables) -> DataFrame:
    """id, identified, external_id, create_time: live profiles, and ids of events that no profile has claimed."""
    logs, names = latest(tables.profiles, "id"), latest(tables.aliases, "alias_id")
    claimed = logs.select(F.explode(F.array("id", "external_id")).alias("distinct_id")).union(names.select("alias_id")).where("distinct_id <> ''").distinct()
    free = activity_states(tables.events).join(claimed, "distinct_id", "left_anti")
    anonymous = free.select(F.col("distinct_id").alias("id"), F.lit(False).alias("identified"), F.lit("").alias("external_id"), F.col("first_seen").alias("create_time"))
    return live_profiles(tables).select("id", F.lit(True).alias("identified"), "external_id", "create_time").union(anonymous)


def profile_activity(tables) -> DataFrame:
    """id, first_seen, last_seen, total_events, page_views of each live profile over all its ids; none: zeros."""
    own = identity_union(tables).join(activity_states(tables.events), "distinct_id")
    merged = own.groupBy(F.col("profile_id").alias("id")).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("total_events").alias("total_events"), F.sum("page_views").alias("page_views"),
        *[F.max_by(c, F.struct("last_seen", "distinct_id")).alias(c) for c in SUMMARY.values()],
    )
    zero = F.lit(0).cast("long")
    return live_profiles(tables).select("id").join(merged, "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("total_events", "page_views")})


def list_profiles(tables, filters: tuple[PropertyFilter, ...] = (), cursor: tuple | None = None, size: int = PAGE) -> DataFrame:
    """A page of live profiles, the latest first; filters on profile properties or the latest automatic ones."""
    rows = live_profiles(tables)
    if any(f.property.startswith("$") for f in filters):
        rows = rows.join(profile_activity(tables).select("id", *SUMMARY.values()), "id", "left")
    for f in filters:
        if f.property.startswith("$"):
            if f.property not in SUMMARY or f.op in ("lte", "gte", "lt", "gt", "between", "not_between"):
                raise SpecError(f"{f.property} can't be compared so in a list of profiles")
            text = F.coalesce(SUMMARY[f.property], F.lit(""))
            rows = rows.where(compare(f, text, props.parse_number(text)))
        else:
            rows = rows.where(compare(f, props.path_string(F.col("properties"), f.property), props.path_number(F.col("properties"), f.property)))
    page = rows.where(keyset_after("create_time", "id", cursor)).orderBy(F.desc("create_time"), F.desc("id")).limit(size)
    return page.select("id", "external_id", "create_time")
