"""Predicates: property filters, event filters, filter groups, identity filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.plans.spec import EventQuery, FilterGroup, PropertyFilter, Spec, SpecError

NUMERIC_OPS = ("lte", "gte", "lt", "gt", "between", "not_between")


def compare(f: PropertyFilter, text: Column, numeric: Column) -> Column:
    """Strings are never null, so negations match absent properties; a missing number matches nothing."""
    if f.op in NUMERIC_OPS:
        if f.op in ("between", "not_between"):
            low, high = map(float, f.values)
            hit = (numeric >= low) & (numeric <= high) if f.op == "between" else (numeric < low) | (numeric > high)
        else:
            x = float(f.value)
            hit = {"lte": numeric <= x, "gte": numeric >= x, "lt": numeric < x, "gt": numeric > x}[f.op]
        return F.coalesce(hit, F.lit(False))
    return {
        "eq": lambda: text == f.value,
        "ne": lambda: text != f.value,
        "contains": lambda: text.contains(f.value),
        "not_contains": lambda: ~text.contains(f.value),
        "is_set": lambda: text != "",
        "is_not_set": lambda: text == "",
        "in": lambda: text.isin(*f.values),
        "not_in": lambda: ~text.isin(*f.values),
    }[f.op]()


def event_property(f: PropertyFilter) -> Column:
    return compare(f, props.prop_string(f.property), props.prop_number(f.property))


def event_filter(e: EventQuery) -> Column | None:
    """Kind and all property filters; None if the filter is empty."""
    parts = ([F.col("kind") == e.kind] if e.kind else []) + [event_property(f) for f in e.filters]
    return reduce(lambda a, b: a & b, parts) if parts else None


def any_event(events: tuple[EventQuery, ...]) -> Column | None:
    """One of the events; a single empty one is no filter, an empty one among several is an error."""
    parts = [event_filter(e) for e in events]
    if len(parts) > 1 and any(p is None for p in parts):
        raise SpecError("an empty event filter among several")
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a | b, parts) if parts else None


def profile_ids(profiles: DataFrame, aliases: DataFrame, f: PropertyFilter) -> DataFrame:
    """distinct_id: ids of the matching profiles with an external id, and their aliases."""
    hit = compare(f, props.path_string(F.col("properties"), f.property), props.path_number(F.col("properties"), f.property))
    found = profiles.where((F.col("external_id") != "") & hit).select(F.col("id").alias("distinct_id"))
    named = aliases.join(found.withColumnRenamed("distinct_id", "profile_id"), "profile_id", "left_semi").select(F.col("alias_id").alias("distinct_id"))
    return found.union(named).distinct()


def apply_groups(events: DataFrame, groups: tuple[FilterGroup, ...], any_group: bool, profiles: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
    """Filters within a group joined by its own operator, groups by any_group; profile filters become flags by join."""
    parts, out = [], events
    for i, g in enumerate(groups):
        if not g.filters:
            raise SpecError("an empty filter group")
        hits = []
        for j, f in enumerate(g.filters):
            if f.source == "profile":
                if profiles is None or aliases is None:
                    raise SpecError("a profile filter needs profiles and aliases")
                flag = f"__in_{i}_{j}"
                out = out.join(profile_ids(profiles, aliases, f).withColumn(flag, F.lit(True)), "distinct_id", "left")
                hits.append(F.coalesce(F.col(flag), F.lit(False)))
            else:
                hits.append(event_property(f))
        parts.append(reduce((lambda a, b: a | b) if g.any else (lambda a, b: a & b), hits))
    if not parts:
        return events
    hit = reduce((lambda a, b: a | b) if any_group else (lambda a, b: a & b), parts)
    return out.where(hit).select(*events.columns)


def scan(tables, spec: Spec, start=None, end=None) -> DataFrame:
    """Events of the half-open window that pass the spec's filter groups."""
    rows = tables.events
    if start is not None:
        rows = rows.where((F.col("occur_time") >= F.lit(start)) & (F.col("occur_time") < F.lit(end)))
        if "occur_month" in rows.columns:  # the partition column of stored events
            rows = rows.where(F.col("occur_month").between(start.year * 100 + start.month, end.year * 100 + end.month))
    return apply_groups(rows, spec.groups, spec.groups_any, tables.profiles, tables.aliases)


def keyset_after(first: str, second: str, cursor: tuple | None, descending: bool = True) -> Column:
    """Rows after a cursor in the order (first, second)."""
    if cursor is None:
        return F.lit(True)
    a, b = F.col(first), F.col(second)
    x, y = F.lit(cursor[0]), F.lit(cursor[1])
    return (a < x) | ((a == x) & (b < y)) if descending else (a > x) | ((a == x) & (b > y))
