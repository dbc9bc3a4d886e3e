"""Trends and segmentation, session metrics, and the top-N fold of breakdowns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.functions.filters import any_event, event_filter, event_property, scan
from meridio.plans.spec import DEFAULT_TOP_N, EventQuery, Request

SESSION_KIND = "$session"


def breakdown_names(n: int) -> list[str]:
    return [f"breakdown_{i}" for i in range(n)]


def breakdowns(spec) -> list[Column]:
    return [props.prop_string(p).alias(n) for p, n in zip(spec.breakdowns, breakdown_names(len(spec.breakdowns)), strict=True)]


def trends(tables, r: Request, fold: bool = True) -> DataFrame:
    """t, event_index, event_kind, breakdown_i, value."""
    spec = r.spec
    if spec.session is not None:
        out = session_trends(tables, r)
    elif len(spec.events) > 1 and all(e.kind for e in spec.events):
        out = multi_event(tables, r)
    else:
        out = reduce(DataFrame.unionByName, [single_event(tables, r, i, e) for i, e in enumerate(spec.events or (EventQuery(),))])
    return fold_top_n(out, spec) if fold and spec.breakdowns else out


def single_event(tables, r: Request, index: int, e: EventQuery) -> DataFrame:
    rows = scan(tables, r.spec, r.start, r.end)
    hit = event_filter(e)
    if hit is not None:
        rows = rows.where(hit)
    if e.aggregation in ("unique_users", "per_user_avg"):
        rows = rows.where(props.identified(r.spec.include_cookieless))
    keys = [props.bucket(F.col("occur_time"), r.granularity, r.timezone).alias("t"), F.col("kind").alias("event_kind"), *breakdowns(r.spec)]
    out = rows.groupBy(*keys).agg(props.aggregation(e.aggregation, e.property, None, r.spec.include_cookieless).alias("value"))
    return out.withColumn("event_index", F.lit(index)).select("t", "event_index", "event_kind", *breakdown_names(len(r.spec.breakdowns)), "value")


def multi_event(tables, r: Request) -> DataFrame:
    """One scan: an aggregate for each event under its own condition, then a row for each event in every cell."""
    spec, names = r.spec, breakdown_names(len(r.spec.breakdowns))
    rows = scan(tables, spec, r.start, r.end).where(any_event(spec.events))
    keys = [props.bucket(F.col("occur_time"), r.granularity, r.timezone).alias("t"), *breakdowns(spec)]
    aggs = [props.aggregation(e.aggregation, e.property, event_filter(e), spec.include_cookieless).alias(f"v{i}") for i, e in enumerate(spec.events)]
    cells = rows.groupBy(*keys).agg(*aggs)
    each = F.array(*[F.struct(F.lit(i).alias("event_index"), F.lit(e.kind).alias("event_kind"), F.col(f"v{i}").alias("value")) for i, e in enumerate(spec.events)])
    return cells.select("t", *names, F.inline(each)).select("t", "event_index", "event_kind", *names, "value")


def top_values(rows: DataFrame, spec, keys: tuple[str, ...] = ("event_index", "event_kind")) -> DataFrame:
    """keys, breakdowns and __top: per series, the N breakdown values of highest total."""
    names, n = breakdown_names(len(spec.breakdowns)), spec.breakdown_limit or DEFAULT_TOP_N
    totals = rows.groupBy(*keys, *names).agg(F.sum("value").alias("__total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__total"), *names))
    return totals.withColumn("__rank", rank).where(F.col("__rank") <= n).select(*keys, *names, F.lit(True).alias("__top"))


def fold_top_n(rows: DataFrame, spec, keys: tuple[str, ...] = ("event_index", "event_kind")) -> DataFrame:
    """Per series, the N breakdown values of highest total stay; the others are summed by bucket as $others."""
    names = breakdown_names(len(spec.breakdowns))
    marked = rows.join(F.broadcast(top_values(rows, spec, keys)), [*keys, *names], "left")  # N rows a series
    folded = [F.when(F.col("__top"), F.col(c)).otherwise(F.lit(props.OTHERS)).alias(c) for c in names]
    return marked.groupBy("t", *keys, *folded).agg(F.sum("value").alias("value"))


def segmentation(tables, r: Request) -> DataFrame:
    """value: the first event's aggregation over the events of any."""
    spec = r.spec
    if spec.session is not None:
        return session_rows(tables, r).agg(session_metric(spec.session.metric).alias("value"))
    rows = scan(tables, spec, r.start, r.end)
    hit = any_event(spec.events)
    if hit is not None:
        rows = rows.where(hit)
    e = spec.events[0] if spec.events else EventQuery()
    return rows.agg(props.aggregation(e.aggregation, e.property, None, spec.include_cookieless).alias("value"))


def session_rows(tables, r: Request) -> DataFrame:
    """One row a session that starts in the window, whole: its events are never clipped."""
    spec, s = r.spec, r.spec.session
    rows = scan(tables, spec)
    for c in ([F.col("kind") == s.kind] if s.kind else []) + [event_property(f) for f in s.filters]:
        rows = rows.where(c)
    order = F.struct("occur_time", "event_id")
    first = F.max_by if s.metric == "exit" else F.min_by
    ends = [first(b, order).alias(n) for b, n in zip([props.prop_string(p) for p in spec.breakdowns], breakdown_names(len(spec.breakdowns)), strict=True)]
    out = rows.groupBy("project_id", "session_id").agg(F.min("occur_time").alias("start_time"), F.max("occur_time").alias("end_time"), F.count("*").alias("event_count"), *ends)
    return out.where((F.col("start_time") >= F.lit(r.start)) & (F.col("start_time") < F.lit(r.end)))


def session_metric(metric: str) -> Column:
    zero = F.lit(0.0)
    if metric == "avg_duration":
        return F.coalesce(F.avg(F.unix_timestamp("end_time") - F.unix_timestamp("start_time")), zero)
    if metric == "bounce_rate":
        return F.coalesce(F.count(F.when(F.col("event_count") == 1, 1)) * 100.0 / F.nullif(F.count("*"), F.lit(0)), zero)
    if metric == "avg_events":
        return F.coalesce(F.avg("event_count"), zero)
    return F.count("*").cast("double")


def session_trends(tables, r: Request) -> DataFrame:
    names = breakdown_names(len(r.spec.breakdowns))
    rows = session_rows(tables, r).withColumn("t", props.bucket(F.col("start_time"), r.granularity, r.timezone))
    out = rows.groupBy("t", *names).agg(session_metric(r.spec.session.metric).alias("value"))
    return out.select("t", F.lit(0).alias("event_index"), F.lit(SESSION_KIND).alias("event_kind"), *names, "value")
