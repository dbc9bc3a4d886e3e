"""Rollups: daily events by dimension, sessions, activity of ids; and the queries that they answer.

Partial states merge by plain aggregates. Distinct users are kept exactly, one row for each id of a
cell; `sketched` turns them into HyperLogLog sketches where an estimate is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.operators.trends import breakdown_names, fold_top_n, session_metric, top_values
from meridio.plans.spec import DEFAULT_TOP_N, TOPK_DEFAULT, EventQuery, Request
from meridio.sources.shared import new_path, replace

TOTAL = "$__total__"
#: Promoted properties that the event rollup has, and those of the session rollup.
EVENT_DIMS = (
    "$country", "$region", "$city", "$browser", "$browserVersion", "$os", "$osVersion", "$device", "$platform", "$utmSource", "$utmMedium",
    "$utmCampaign", "$pathname", "$hostname", "$referrerDomain", "$channel", "$locale", "$screenSize", "$utmTerm", "$utmContent",
)
SESSION_DIMS = (
    "$url", "$country", "$region", "$city", "$os", "$browser", "$device", "$platform", "$utmSource", "$utmMedium", "$utmCampaign", "$pathname",
    "$referrerDomain", "$channel", "$utmTerm", "$utmContent",
)


def event_rollup(events: DataFrame, dims: tuple[str, ...] = EVENT_DIMS) -> DataFrame:
    """project_id, kind, day, dim, dim_value, cookieless, distinct_id, n: all dimensions in one pass."""
    cells = F.array(F.struct(F.lit(TOTAL).alias("dim"), F.lit("").alias("dim_value")), *[F.struct(F.lit(d).alias("dim"), props.prop_string(d).alias("dim_value")) for d in dims])
    rows = events.select("project_id", "kind", F.to_date("occur_time").alias("day"), "distinct_id", F.startswith(F.col("distinct_id"), F.lit(props.COOKIELESS)).alias("cookieless"), F.inline(cells))
    return rows.groupBy("project_id", "kind", "day", "dim", "dim_value", "cookieless", "distinct_id").agg(F.count("*").alias("n"))


def merge_event_rollup(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("project_id", "kind", "day", "dim", "dim_value", "cookieless", "distinct_id").agg(F.sum("n").alias("n"))


def store(events: DataFrame, folder: str, event_dims: tuple[str, ...] = EVENT_DIMS, session_dims: tuple[str, ...] = SESSION_DIMS) -> None:
    """Write both rollups: a folder for each dimension of the one, so that a query reads its own; the other sorted by start."""
    event_rollup(events, event_dims).sortWithinPartitions("dim", "kind", "day").write.partitionBy("dim").parquet(f"{folder}/event_rollup")
    session_rollup(events, session_dims).sortWithinPartitions("kind", "start_time").write.parquet(f"{folder}/session_rollup")


def rebuild(events: DataFrame, folder: str, event_dims: tuple[str, ...] = EVENT_DIMS, session_dims: tuple[str, ...] = SESSION_DIMS) -> None:
    """Both rollups and the lists of names and keys anew from all events, in the place of what folder holds."""
    from meridio.operators import discovery

    spark = events.sparkSession
    draft = new_path(spark, "rebuilt")
    store(events, draft, event_dims, session_dims)
    event_names(events).write.parquet(f"{draft}/event_names")
    discovery.key_buckets(events).write.parquet(f"{draft}/property_keys")
    replace(spark, draft, folder)


def sketched(rollup: DataFrame) -> DataFrame:
    """The rollup without ids: n and a sketch of them for each cell."""
    return rollup.groupBy("project_id", "kind", "day", "dim", "dim_value", "cookieless").agg(F.sum("n").alias("n"), F.hll_sketch_agg("distinct_id").alias("users"))


def session_rollup(events: DataFrame, dims: tuple[str, ...] = SESSION_DIMS) -> DataFrame:
    """project_id, kind ('' for all events), session_id, start, end, count, and first and last state of each dimension."""
    states = []
    for d in dims:
        s = F.struct(F.col("occur_time"), F.col("event_id"), props.prop_string(d).alias("value"))
        name = props.PROMOTED[d][0]
        states += [F.min(s).alias(f"entry_{name}_state"), F.max(s).alias(f"exit_{name}_state")]
    rows = events.withColumn("kind", F.explode(F.array_distinct(F.array(F.lit(""), F.col("kind")))))
    return rows.groupBy("project_id", "kind", "session_id").agg(F.min("occur_time").alias("start_time"), F.max("occur_time").alias("end_time"), F.count("*").alias("event_count"), *states)


def merge_session_rollup(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    states = [c for c in out.columns if c.endswith("_state")]
    merged = [(F.min if c.startswith("entry_") else F.max)(c).alias(c) for c in states]
    return out.groupBy("project_id", "kind", "session_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("event_count").alias("event_count"), *merged)


def activity_states(events: DataFrame) -> DataFrame:
    """For each id that isn't cookieless: first and last seen, counts, latest device and place."""
    at = F.struct("occur_time", "event_id")
    rows = events.where(props.identified(False))
    last = [F.max_by(c, at).alias(f"latest_{c}") for c in ("browser", "browser_version", "os", "os_version", "device", "country", "region", "city")]
    return rows.groupBy("project_id", "distinct_id").agg(
        F.min("occur_time").alias("first_seen"), F.max("occur_time").alias("last_seen"), F.count("*").alias("total_events"),
        F.count(F.when(F.col("kind") == "page_view", 1)).alias("page_views"), F.count_distinct("session_id").alias("sessions"), *last,
    )


def event_names(events: DataFrame) -> DataFrame:
    return events.groupBy("project_id", "kind").agg(F.count("*").alias("count"), F.max("occur_time").alias("last_seen"))


def _cells(rollup: DataFrame, r: Request, dim: str) -> DataFrame:
    """Cells of one dimension on the days of the window."""
    last = F.to_date(F.lit(r.end) - F.expr("INTERVAL 1 MICROSECOND"))
    return rollup.where((F.col("dim") == dim) & (F.col("day") >= F.to_date(F.lit(r.start))) & (F.col("day") <= last))


def _aggregate(kind: str, include_cookieless: bool):
    if kind == "total":
        return F.sum("n").cast("double")
    of = F.lit(True) if include_cookieless else ~F.col("cookieless")
    users = F.count_distinct(F.when(of, F.col("distinct_id"))).cast("double")
    if kind == "unique_users":
        return users
    return F.coalesce(F.sum(F.when(of, F.col("n"))) / F.nullif(users, F.lit(0.0)), F.lit(0.0))


def trends(rollup: DataFrame, r: Request) -> DataFrame:
    spec = r.spec
    names = breakdown_names(len(spec.breakdowns))
    cells = _cells(rollup, r, spec.breakdowns[0] if names else TOTAL).withColumn("t", props.bucket(F.col("day").cast("timestamp"), r.granularity))
    keys = ["t", F.col("kind").alias("event_kind"), *[F.col("dim_value").alias(n) for n in names]]
    each, out = [], None
    for i, e in enumerate(spec.events or (EventQuery(),)):
        rows = cells.where(F.col("kind") == e.kind) if e.kind else cells
        if e.aggregation != "total" and not spec.include_cookieless:
            rows = rows.where(~F.col("cookieless"))
        each.append((rows, _aggregate(e.aggregation, spec.include_cookieless).alias("value")))
        part = rows.groupBy(*keys).agg(each[i][1]).withColumn("event_index", F.lit(i))
        out = part if out is None else out.unionByName(part)
    out = out.select("t", "event_index", "event_kind", *names, "value")
    if len(spec.events) > 1:  # a row of 0 for every event in a cell that any event has
        index = F.array(*[F.struct(F.lit(i).alias("event_index"), F.lit(e.kind).alias("event_kind")) for i, e in enumerate(spec.events)])
        grid = out.select("t", *names).distinct().select("t", *names, F.inline(index))
        out = grid.join(out, ["t", "event_index", "event_kind", *names], "left").select("t", "event_index", "event_kind", *names, F.coalesce("value", F.lit(0.0)).alias("value"))
    return merged_others(out, each, keys, spec) if names else out


def merged_others(out: DataFrame, each: list, keys: list, spec) -> DataFrame:
    """The values of highest total of each event, and the rest as one: counted over its rows, so a user of several values of it counts once."""
    top = F.broadcast(top_values(out, spec))  # as many rows as the request's events, kinds and limit allow
    is_top = F.coalesce("__top", F.lit(False))
    name = F.when(is_top, F.col("breakdown_0")).otherwise(F.lit(props.OTHERS)).alias("breakdown_0")
    grid = out.join(top, ["event_index", "event_kind", "breakdown_0"], "left").select("t", "event_index", "event_kind", name, is_top.alias("kept")).distinct()
    found = None
    for i, (rows, value) in enumerate(each):
        marked = rows.select("*", *keys[1:]).join(top.where(F.col("event_index") == i).drop("event_index"), ["event_kind", "breakdown_0"], "left")
        part = marked.groupBy("t", "event_kind", name, is_top.alias("kept")).agg(value).withColumn("event_index", F.lit(i))
        found = part if found is None else found.unionByName(part)
    return grid.join(found, ["t", "event_index", "event_kind", "breakdown_0", "kept"], "left").groupBy("t", "event_index", "event_kind", "breakdown_0").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))


def segmentation(rollup: DataFrame, r: Request) -> DataFrame:
    kinds = [e.kind for e in r.spec.events]
    rows = _cells(rollup, r, TOTAL)
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    agg = _aggregate(r.spec.events[0].aggregation if kinds else "total", r.spec.include_cookieless)
    return rows.agg(F.coalesce(agg, F.lit(0.0)).alias("value"))


def top_k(rollup: DataFrame, r: Request) -> DataFrame:
    k = r.spec.top_k
    cells = _cells(rollup, r, k.property if k.dimension == "property" else TOTAL)
    cells = cells.withColumn("d", F.col("dim_value") if k.dimension == "property" else F.col("kind"))
    if k.kind:
        cells = cells.where(F.col("kind") == k.kind)
    if k.metric != "total" and not r.spec.include_cookieless:
        cells = cells.where(~F.col("cookieless"))
    agg = _aggregate(k.metric, r.spec.include_cookieless).alias("value")
    top = cells.groupBy(F.col("d").alias("dim")).agg(agg).orderBy(F.desc("value"), "dim").limit(k.limit or TOPK_DEFAULT)
    if k.omit_others:
        return top.select("dim", F.lit(False).alias("is_others"), "value")
    marked = cells.drop("dim").join(F.broadcast(top.select(F.col("dim").alias("d"), F.lit(True).alias("__top"))), "d", "left")
    others = F.col("__top").isNull()
    return marked.groupBy(F.when(others, F.lit(props.OTHERS)).otherwise(F.col("d")).alias("dim"), others.alias("is_others")).agg(agg)


def session_rows(rollup: DataFrame, r: Request) -> DataFrame:
    s = r.spec.session
    side = "exit" if s.metric == "exit" else "entry"
    names = breakdown_names(len(r.spec.breakdowns))
    states = [F.col(f"{side}_{props.PROMOTED[p][0]}_state.value").alias(n) for p, n in zip(r.spec.breakdowns, names, strict=True)]
    rows = rollup.where(F.col("kind") == s.kind).where((F.col("start_time") >= F.lit(r.start)) & (F.col("start_time") < F.lit(r.end)))
    return rows.select("start_time", "end_time", "event_count", *states)


def session_trends(rollup: DataFrame, r: Request) -> DataFrame:
    names = breakdown_names(len(r.spec.breakdowns))
    rows = session_rows(rollup, r).withColumn("t", props.bucket(F.col("start_time"), r.granularity, r.timezone))
    out = rows.groupBy("t", *names).agg(session_metric(r.spec.session.metric).alias("value"))
    out = out.select("t", F.lit(0).alias("event_index"), F.lit("$session").alias("event_kind"), *names, "value")
    return fold_top_n(out, r.spec) if names else out


def session_segmentation(rollup: DataFrame, r: Request) -> DataFrame:
    return session_rows(rollup, r).agg(session_metric(r.spec.session.metric).alias("value"))
