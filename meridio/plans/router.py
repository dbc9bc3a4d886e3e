"""Validate a request, choose rollup or raw events, and build its DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridio.operators import funnel, retention, rollups, topk, trends, user_flow
from meridio.plans.spec import Request, validate
from meridio.sources.tables import Tables


@dataclass
class Rollups:
    events: DataFrame | None = None
    sessions: DataFrame | None = None

    def of_project(self, project: str) -> Rollups:
        own = lambda df: df if df is None or not project else df.where(F.col("project_id") == project)
        return Rollups(own(self.events), own(self.sessions))


def stored(spark: SparkSession, folder: str) -> Rollups:
    """The rollups that rollups.store wrote."""
    return Rollups(spark.read.parquet(f"{folder}/event_rollup"), spark.read.parquet(f"{folder}/session_rollup"))


def aligned(r: Request) -> bool:
    """The window is whole UTC days, or runs to now."""
    midnight = lambda x: x.time() == time(0)
    now = r.now or datetime.now(UTC).replace(tzinfo=r.end.tzinfo)
    return midnight(r.start) and (midnight(r.end) or r.end >= now)


def utc(r: Request) -> bool:
    return r.timezone in ("", "UTC")


def event_rollup_answers(r: Request) -> bool:
    s = r.spec
    if s.groups or s.session is not None or not aligned(r):
        return False
    if s.type == "top_k":
        k = s.top_k
        known = k.dimension == "event_kind" or (k.dimension == "property" and k.property in rollups.EVENT_DIMS)
        return known and not k.filters and k.metric in ("total", "unique_users", "per_user_avg")
    if s.type not in ("trends", "segmentation") or not utc(r):
        return False
    if s.type == "trends" and r.granularity not in ("day", "week", "month"):
        return False
    if len(s.breakdowns) > 1 or any(b not in rollups.EVENT_DIMS for b in s.breakdowns):
        return False
    return bool(s.events) and all(e.kind and not e.filters and e.aggregation in ("total", "unique_users", "per_user_avg") for e in s.events)


def session_rollup_answers(r: Request) -> bool:
    s = r.spec
    if s.session is None or s.groups or s.session.filters or s.type not in ("trends", "segmentation"):
        return False
    return all(b in rollups.SESSION_DIMS for b in s.breakdowns)


def execute(tables: Tables, r: Request, with_rollups: Rollups | None = None) -> DataFrame:
    """The request's result, lazily."""
    validate(r)
    s, have, tables = r.spec, (with_rollups or Rollups()).of_project(r.project), tables.of_project(r.project)
    if have.events is not None and event_rollup_answers(r):
        return {"trends": rollups.trends, "segmentation": rollups.segmentation, "top_k": rollups.top_k}[s.type](have.events, r)
    if have.sessions is not None and session_rollup_answers(r):
        return (rollups.session_trends if s.type == "trends" else rollups.session_segmentation)(have.sessions, r)
    if s.type == "funnel":
        return funnel.with_timing(tables, r) if s.step_timing else funnel.counts(tables, r)
    return {
        "trends": trends.trends, "segmentation": trends.segmentation, "retention": retention.retention, "user_flow": user_flow.graph, "top_k": topk.top_k,
    }[s.type](tables, r)
