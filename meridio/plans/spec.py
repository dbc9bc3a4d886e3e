"""Typed requests and their validation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

INSIGHTS = ("trends", "segmentation", "funnel", "retention", "user_flow", "top_k")
NUMERIC = ("sum", "avg", "min", "max")
AGGREGATIONS = ("total", "unique_users", "per_user_avg", *NUMERIC)
SESSION_METRICS = ("sessions", "entry", "exit", "avg_duration", "bounce_rate", "avg_events")
OPERATORS = ("eq", "ne", "contains", "not_contains", "is_set", "is_not_set", "lte", "gte", "lt", "gt", "in", "not_in", "between", "not_between")
GRANULARITIES = ("minute", "hour", "day", "week", "month")
#: The longest range of each granularity.
RANGE_CAPS = {"minute": timedelta(hours=6), "hour": timedelta(days=14), "day": timedelta(days=365), "week": timedelta(days=1461), "month": timedelta(days=3652)}
#: Limits and defaults.
MAX_BREAKDOWNS, DEFAULT_TOP_N, MAX_STEPS = 5, 10, 20
FLOW_DEFAULTS, FLOW_LIMITS = {"max_hops": 5, "max_nodes": 20, "max_links": 100}, {"max_hops": (1, 10), "max_nodes": (2, 50), "max_links": (1, 500)}
TOPK_DEFAULT, TOPK_MAX = 10, 100


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class PropertyFilter:
    property: str
    op: str
    value: str = ""
    values: tuple[str, ...] = ()
    source: str = "event"  # or "profile"


@dataclass(frozen=True)
class FilterGroup:
    filters: tuple[PropertyFilter, ...]
    any: bool = False


@dataclass(frozen=True)
class EventQuery:
    kind: str = ""
    filters: tuple[PropertyFilter, ...] = ()
    aggregation: str = "total"
    property: str = ""


@dataclass(frozen=True)
class SessionQuery:
    metric: str = "sessions"
    kind: str = ""
    filters: tuple[PropertyFilter, ...] = ()


@dataclass(frozen=True)
class UserFlowQuery:
    node_property: str = ""  # empty: the event kind
    max_hops: int = 0
    max_nodes: int = 0
    max_links: int = 0


@dataclass(frozen=True)
class TopKQuery:
    dimension: str = "property"  # "property", "event_kind" or "user"
    property: str = ""
    metric: str = "total"
    metric_property: str = ""
    limit: int = 0
    kind: str = ""
    filters: tuple[PropertyFilter, ...] = ()
    omit_others: bool = False


@dataclass(frozen=True)
class Spec:
    type: str
    events: tuple[EventQuery, ...] = ()
    breakdowns: tuple[str, ...] = ()
    breakdown_limit: int = 0
    groups: tuple[FilterGroup, ...] = ()
    groups_any: bool = False
    conversion_window: float | None = None  # seconds
    step_timing: bool = False
    session: SessionQuery | None = None
    user_flow: UserFlowQuery | None = None
    top_k: TopKQuery | None = None
    include_cookieless: bool = False


@dataclass(frozen=True)
class Request:
    spec: Spec
    start: datetime
    end: datetime
    granularity: str = "day"
    timezone: str = ""
    now: datetime | None = field(default=None)
    project: str = ""  # empty: the tables are of one project

    def with_window(self, start: datetime, end: datetime) -> Request:
        return replace(self, start=start, end=end)


def need(ok: bool, why: str) -> None:
    if not ok:
        raise SpecError(why)


def number(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) and text == text.strip() else None


def validate_filter(f: PropertyFilter) -> None:
    need(bool(f.property), "a filter names a property")
    need(f.op in OPERATORS, f"unknown operator {f.op}")
    need(f.source in ("event", "profile"), f"unknown filter source {f.source}")
    ranged, listed, presence = f.op in ("between", "not_between"), f.op in ("in", "not_in"), f.op in ("is_set", "is_not_set")
    if presence:
        need(not f.value, "is_set and is_not_set take no value")
    if ranged or listed:
        need(bool(f.values), f"{f.op} needs values")
    else:
        need(not f.values, f"{f.op} takes no list of values")
        need(presence or bool(f.value), f"{f.op} needs a value")
    if ranged:
        need(len(f.values) == 2, f"{f.op} needs exactly 2 values")
    numbers = f.values if ranged else (f.value,) if f.op in ("lte", "gte", "lt", "gt") else ()
    need(all(number(x) is not None for x in numbers), f"{f.op} needs valid numbers")
    if ranged:
        need(float(f.values[0]) <= float(f.values[1]), f"{f.op}: its first value is over its second")


def validate_event(e: EventQuery) -> None:
    need(e.aggregation in AGGREGATIONS, f"unknown aggregation {e.aggregation}")
    need(e.aggregation not in NUMERIC or bool(e.property), f"{e.aggregation} needs an aggregation property")
    for f in e.filters:
        validate_filter(f)


def validate_spec(s: Spec) -> None:
    need(s.type in INSIGHTS, f"unknown insight type {s.type}")
    need(s.type not in ("funnel", "retention") or len(s.events) >= 1, f"{s.type} needs at least one event")
    need(s.conversion_window is None or s.type == "funnel", "conversion_window is for funnels only")
    need(not s.step_timing or s.type == "funnel", "step timing is for funnels only")
    if s.conversion_window is not None:
        need(s.conversion_window >= 1 and float(s.conversion_window).is_integer(), "conversion_window is whole seconds, at least one")
    if s.session is not None:
        need(s.type in ("trends", "segmentation"), "session is for trends and segmentation only")
        need(not s.events, "session excludes events")
        need(s.session.metric in SESSION_METRICS, f"unknown session metric {s.session.metric}")
        need(s.session.metric not in ("entry", "exit") or (s.type == "trends" and len(s.breakdowns) == 1), "entry and exit need trends and exactly one breakdown")
    need(s.type != "segmentation" or not s.breakdowns, "segmentation has no breakdowns")
    need(len(s.breakdowns) <= MAX_BREAKDOWNS and all(s.breakdowns), f"at most {MAX_BREAKDOWNS} breakdowns, none empty")
    need(len(set(s.breakdowns)) == len(s.breakdowns), "breakdowns are unique")
    need(not s.breakdown_limit or (s.breakdown_limit > 0 and bool(s.breakdowns)), "breakdown_limit needs breakdowns")
    need(s.type != "retention" or len(s.events) <= 2, "retention has at most 2 events")
    need(s.type != "funnel" or len(s.events) <= MAX_STEPS, f"a funnel has at most {MAX_STEPS} steps")
    if s.type in ("funnel", "retention"):
        need(all(e.kind or e.filters for e in s.events), "a step is not empty")
    for e in s.events:
        validate_event(e)
        need(e.aggregation not in NUMERIC or s.type in ("trends", "segmentation"), "numeric aggregations are for trends and segmentation only")
    for g in s.groups:
        need(bool(g.filters), "a filter group is not empty")
        for f in g.filters:
            validate_filter(f)
    need((s.user_flow is not None) == (s.type == "user_flow"), "user_flow goes with the user flow type, and only with it")
    need((s.top_k is not None) == (s.type == "top_k"), "top_k goes with the top k type, and only with it")
    if s.type in ("user_flow", "top_k"):
        need(not s.events and s.session is None and not s.breakdowns and not s.breakdown_limit, f"{s.type} has no events, session or breakdowns")
    if s.user_flow is not None:
        for name, (low, high) in FLOW_LIMITS.items():
            x = getattr(s.user_flow, name)
            need(not x or low <= x <= high, f"{name} is between {low} and {high}")
    if s.top_k is not None:
        k = s.top_k
        need(k.dimension in ("property", "event_kind", "user"), f"unknown dimension {k.dimension}")
        need((k.dimension == "property") == bool(k.property), "a property goes with the property dimension, and only with it")
        need(k.metric in AGGREGATIONS, f"unknown metric {k.metric}")
        need(k.metric not in NUMERIC or bool(k.metric_property), f"{k.metric} needs a metric property")
        need(k.dimension != "user" or k.metric not in ("unique_users", "per_user_avg"), "users are not ranked by counts of users")
        need(0 <= k.limit <= TOPK_MAX, f"limit is {TOPK_MAX} at most")
        for f in k.filters:
            validate_filter(f)


def validate(r: Request) -> Request:
    validate_spec(r.spec)
    need(r.start < r.end, "the range's start is before its end")
    need(r.granularity in GRANULARITIES, f"unknown granularity {r.granularity}")
    need(r.end - r.start <= RANGE_CAPS[r.granularity], f"the range is too long for {r.granularity}")
    if r.timezone:
        from zoneinfo import ZoneInfo

        try:
            ZoneInfo(r.timezone)
        except Exception as e:
            raise SpecError(f"unknown time zone {r.timezone}") from e
    return r
