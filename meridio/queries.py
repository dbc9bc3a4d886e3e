"""Named queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridio.functions import enrich, promoted, props
from meridio.operators import discovery, identity, people, rollups, topk
from meridio.plans.router import Rollups, execute, stored
from meridio.plans.spec import EventQuery as E
from meridio.plans.spec import FilterGroup as G
from meridio.plans.spec import PropertyFilter as P
from meridio.plans.spec import Request, SessionQuery, Spec, TopKQuery, UserFlowQuery
from meridio.sources.shared import new_path
from meridio.sources.tables import Tables, canonical, driver_events, driver_orders, driver_profiles
from meridio.streaming import profiles, stitch

FROM, TO = datetime(2024, 1, 1), datetime(2024, 2, 1)
#: Sessions of the test events end after a day without any, since users are rarely active twice in an hour.
GAP = 86400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WINDOW = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"
#: The canonical events as SQL.
EV = "ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS uid, event_type AS kind, ts, value, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, user_id FROM events)"
CO = EV + ", co AS (SELECT ev.*, coalesce(n_name, '') AS country FROM ev LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey)"
SE = CO + f""", gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts, event_id) > {GAP}000000 THEN 1 ELSE 0 END AS g FROM co),
    se AS (SELECT *, uid || '-' || CAST(sum(g) OVER (PARTITION BY uid ORDER BY ts, event_id) AS VARCHAR) AS sid FROM gaps),
    ses AS (SELECT sid, min(ts) AS s, max(ts) AS e, count(*) AS n, arg_min(kind, ts) AS first_kind, arg_max(kind, ts) AS last_kind, arg_min(country, ts) AS country FROM se GROUP BY sid)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def insight(name: str, spec: Spec, sql: str | None, granularity: str = "day", start=FROM, end=TO, timezone: str = "", country=False, gap=None, profiles=False, orders=False, drop=("event_index",), rounded=False):
    """Register a request as a query; sums and means are compared to six places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = driver_orders(spark, sf_dir) if orders else driver_events(spark, sf_dir, country, gap)
        tables = Tables(events, *driver_profiles(spark, sf_dir)) if profiles else Tables(events)
        out = execute(tables, Request(spec, start, end, granularity, timezone)).drop(*drop)
        return out.withColumn("value", F.round("value", 6)) if rounded else out

    query(name, sql)(run)


def day(x: str = "ts") -> str:
    return f"CAST(date_trunc('day', {x}) AS TIMESTAMP)"


def series(value: str, where: str = "true", t: str | None = None, rounded: bool = False) -> str:
    v = f"round({value}, 6)" if rounded else value
    return f"WITH {EV} SELECT {t or day()} AS t, kind AS event_kind, {v} AS value FROM ev WHERE {WINDOW} AND {where} GROUP BY 1, 2"


# trends and aggregations
view = E("view")
insight("trends_total_day", Spec("trends", (view,)), series("CAST(count(*) AS DOUBLE)", "kind = 'view'"))
insight("trends_total_hour", Spec("trends", (view,)), f"WITH {EV} SELECT date_trunc('hour', ts) AS t, kind AS event_kind, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND kind = 'view' GROUP BY 1, 2", "hour", datetime(2024, 1, 5), datetime(2024, 1, 12))
insight("trends_total_minute", Spec("trends"), f"WITH {EV} SELECT date_trunc('minute', ts) AS t, kind AS event_kind, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05 06:00:00' GROUP BY 1, 2", "minute", datetime(2024, 1, 5), datetime(2024, 1, 5, 6))
insight("trends_total_week_sunday", Spec("trends", (view,)), series("CAST(count(*) AS DOUBLE)", "kind = 'view'", "CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP)"), "week")
insight("trends_total_month_orders", Spec("trends"), "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, o_orderpriority AS event_kind, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2002-01-01' GROUP BY 1, 2", "month", datetime(1995, 1, 1), datetime(2002, 1, 1), orders=True)
insight("trends_default_all_kinds", Spec("trends"), series("CAST(count(*) AS DOUBLE)"))
insight("trends_unique_users_day", Spec("trends", (E("purchase", aggregation="unique_users"),)), series("CAST(count(DISTINCT uid) AS DOUBLE)", "kind = 'purchase'"))
insight("trends_per_user_avg_day", Spec("trends", (E("purchase", aggregation="per_user_avg"),)), series("count(*) / CAST(count(DISTINCT uid) AS DOUBLE)", "kind = 'purchase'", rounded=True), rounded=True)
for agg in ("sum", "avg", "min", "max"):
    insight(f"trends_{agg}_value", Spec("trends", (E("purchase", aggregation=agg, property="value"),)), series(f"{agg}(value)", "kind = 'purchase'", rounded=True), rounded=True)
insight("trends_tz_kolkata_day", Spec("trends", (view,)), series("CAST(count(*) AS DOUBLE)", "kind = 'view'", "CAST(date_trunc('day', ts + INTERVAL 330 MINUTE) - INTERVAL 330 MINUTE AS TIMESTAMP)"), timezone="Asia/Kolkata")
MULTI = f"""WITH {EV}, c AS (SELECT {day()} AS t, CAST(count(*) FILTER (WHERE kind = 'view') AS DOUBLE) AS a, CAST(count(DISTINCT uid) FILTER (WHERE kind = 'purchase') AS DOUBLE) AS b,
    coalesce(sum(value) FILTER (WHERE kind = 'signup' AND k >= 50), 0.0) AS s FROM ev WHERE {WINDOW} AND (kind IN ('view', 'purchase') OR (kind = 'signup' AND k >= 50)) GROUP BY 1)
    SELECT t, 0 AS event_index, 'view' AS event_kind, a AS value FROM c UNION ALL SELECT t, 1, 'purchase', b FROM c UNION ALL SELECT t, 2, 'signup', round(s, 6) FROM c"""
insight("trends_multi_event", Spec("trends", (view, E("purchase", aggregation="unique_users"), E("signup", (P("k", "gte", "50"),), "sum", "value"))), MULTI, drop=(), rounded=True)
insight("trends_union_fallback", Spec("trends", (view, E("", (P("k", "lt", "10"),)))), f"WITH {EV} SELECT {day()} AS t, 0 AS event_index, kind AS event_kind, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE {WINDOW} AND kind = 'view' GROUP BY 1, 3 UNION ALL SELECT {day()}, 1, kind, CAST(count(*) AS DOUBLE) FROM ev WHERE {WINDOW} AND k < 10 GROUP BY 1, 3", drop=())


def folded(cells: str, keys: str, n: int) -> str:
    return f"""{cells}, tot AS (SELECT {keys}, b, sum(value) AS x FROM cells GROUP BY {keys}, b), top AS (SELECT {keys}, b, row_number() OVER (PARTITION BY {keys} ORDER BY x DESC, b) AS r FROM tot)
        SELECT t, event_kind, CASE WHEN r <= {n} THEN b ELSE '$others' END AS breakdown_0, sum(value) AS value FROM cells JOIN top USING ({keys}, b) GROUP BY 1, 2, 3"""


insight("trends_breakdown_topn_others", Spec("trends", (view,), ("$country",), 3), folded(f"WITH {CO}, cells AS (SELECT {day()} AS t, kind AS event_kind, country AS b, CAST(count(*) AS DOUBLE) AS value FROM co WHERE {WINDOW} AND kind = 'view' GROUP BY 1, 2, 3)", "event_kind", 3), country=True)
insight("trends_two_breakdowns", Spec("trends", (E("purchase", aggregation="unique_users"),), ("$country", "k"), 100), f"""WITH {CO}, cells AS (SELECT {day()} AS t, kind AS event_kind, country AS b, CAST(k AS VARCHAR) AS c, CAST(count(DISTINCT uid) AS DOUBLE) AS value FROM co WHERE {WINDOW} AND kind = 'purchase' GROUP BY 1, 2, 3, 4),
    top AS (SELECT b, c, row_number() OVER (ORDER BY sum(value) DESC, b, c) AS r FROM cells GROUP BY b, c)
    SELECT t, event_kind, CASE WHEN r <= 100 THEN b ELSE '$others' END AS breakdown_0, CASE WHEN r <= 100 THEN c ELSE '$others' END AS breakdown_1, sum(value) AS value FROM cells JOIN top USING (b, c) GROUP BY 1, 2, 3, 4""", country=True)  # fmt: skip

# segmentation
seg = lambda v, where="true": f"WITH {EV} SELECT {v} AS value FROM ev WHERE {WINDOW} AND {where}"
insight("segmentation_total", Spec("segmentation", (view,)), seg("CAST(count(*) AS DOUBLE)", "kind = 'view'"))
insight("segmentation_unique_or_events", Spec("segmentation", (E("view", aggregation="unique_users"), E("purchase"))), seg("CAST(count(DISTINCT uid) AS DOUBLE)", "kind IN ('view', 'purchase')"))
insight("segmentation_per_user_avg", Spec("segmentation", (E("view", aggregation="per_user_avg"),)), seg("round(count(*) / CAST(count(DISTINCT uid) AS DOUBLE), 6)", "kind = 'view'"), rounded=True)
insight("segmentation_empty_sum", Spec("segmentation", (E("nothing", aggregation="sum", property="value"),)), "SELECT CAST(0 AS DOUBLE) AS value")

# filters
FILTERS = {
    "equals": (P("k", "eq", "7"), "k = 7"),
    "not_equals_absent": (P("missing", "ne", "x"), "true"),
    "contains": (P("k", "contains", "9"), "CAST(k AS VARCHAR) LIKE '%9%'"),
    "not_contains": (P("k", "not_contains", "9"), "CAST(k AS VARCHAR) NOT LIKE '%9%'"),
    "is_set": (P("k", "is_set"), "k IS NOT NULL"),
    "is_not_set": (P("missing", "is_not_set"), "true"),
    "in": (P("k", "in", values=("1", "2", "30")), "k IN (1, 2, 30)"),
    "not_in": (P("k", "not_in", values=("1", "2", "30")), "k NOT IN (1, 2, 30)"),
    "numeric_cmp": (P("value", "gt", "50.5"), "value > 50.5"),
    "between": (P("value", "between", values=("10", "20")), "value >= 10 AND value <= 20"),
    "not_between": (P("value", "not_between", values=("10", "20")), "(value < 10 OR value > 20)"),
}
for name, (f, sql) in FILTERS.items():
    insight(f"filter_{name}", Spec("trends", (E("", (f,)),)), series("CAST(count(*) AS DOUBLE)", sql))
insight("filter_groups_and_or", Spec("trends", groups=(G((P("k", "lt", "10"), P("k", "gt", "90")), any=True), G((P("value", "gte", "5"), P("k", "ne", "95"))))), series("CAST(count(*) AS DOUBLE)", "(k < 10 OR k > 90) AND value >= 5 AND k <> 95"))
insight("filter_profile_source", Spec("trends", groups=(G((P("segment", "eq", "BUILDING", source="profile"),)),)), series("CAST(count(*) AS DOUBLE)", "user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"), profiles=True)
insight("filter_profile_or_event", Spec("trends", groups=(G((P("balance", "gt", "5000", source="profile"), P("k", "eq", "3")), any=True),)), series("CAST(count(*) AS DOUBLE)", "(user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR k = 3)"), profiles=True)

# sessions
st = lambda v: f"WITH {SE} SELECT {day('s')} AS t, '$session' AS event_kind, {v} AS value FROM ses WHERE s >= TIMESTAMP '2024-01-01' AND s < TIMESTAMP '2024-02-01' GROUP BY 1"
insight("sessions_count_day", Spec("trends", session=SessionQuery()), st("CAST(count(*) AS DOUBLE)"), gap=GAP, country=True)
insight("sessions_avg_duration", Spec("trends", session=SessionQuery("avg_duration")), st("round(avg(CAST(floor(epoch_us(e) / 1000000) - floor(epoch_us(s) / 1000000) AS DOUBLE)), 6)"), gap=GAP, country=True, rounded=True)
insight("sessions_bounce_rate", Spec("trends", session=SessionQuery("bounce_rate")), st("round(count(*) FILTER (WHERE n = 1) * 100.0 / count(*), 6)"), gap=GAP, country=True, rounded=True)
insight("sessions_events_per_session", Spec("trends", session=SessionQuery("avg_events")), st("round(avg(n), 6)"), gap=GAP, country=True, rounded=True)
insight("sessions_segmentation", Spec("segmentation", session=SessionQuery("avg_events")), f"WITH {SE} SELECT round(avg(n), 6) AS value FROM ses WHERE s >= TIMESTAMP '2024-01-01' AND s < TIMESTAMP '2024-02-01'", gap=GAP, country=True, rounded=True)
insight("sessions_boundary_straddle", Spec("segmentation", session=SessionQuery("avg_events")), f"WITH {SE} SELECT round(avg(n), 6) AS value FROM ses WHERE s >= TIMESTAMP '2024-01-10' AND s < TIMESTAMP '2024-01-12'", start=datetime(2024, 1, 10), end=datetime(2024, 1, 12), gap=GAP, country=True, rounded=True)
insight("sessions_scoped_kind", Spec("segmentation", session=SessionQuery(kind="purchase")), f"WITH {SE} SELECT CAST(count(*) AS DOUBLE) AS value FROM (SELECT sid, min(ts) AS s FROM se WHERE kind = 'purchase' GROUP BY sid) WHERE s >= TIMESTAMP '2024-01-01' AND s < TIMESTAMP '2024-02-01'", gap=GAP, country=True)
insight("sessions_entry_country", Spec("trends", breakdowns=("$country",), breakdown_limit=5, session=SessionQuery("entry")), folded(f"WITH {SE}, cells AS (SELECT {day('s')} AS t, '$session' AS event_kind, country AS b, CAST(count(*) AS DOUBLE) AS value FROM ses WHERE s >= TIMESTAMP '2024-01-01' AND s < TIMESTAMP '2024-02-01' GROUP BY 1, 3)", "event_kind", 5), gap=GAP, country=True)

# funnels
STEPS = ("view", "signup", "purchase")


def funnel_sql(w: int, extra: str = "", by: str = "''") -> str:
    return f"""{CO}, r AS (SELECT uid, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, ts, event_id, country, CASE kind WHEN 'view' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS step FROM co WHERE {WINDOW} AND kind IN ('view', 'signup', 'purchase') {extra}),
    a AS (SELECT *, CASE WHEN step = 0 THEN sec END AS s0 FROM r),
    b AS (SELECT *, max(s0) OVER (PARTITION BY uid ORDER BY sec, step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r0 FROM a),
    c AS (SELECT *, CASE WHEN step = 1 AND sec - r0 <= {w} THEN r0 END AS s1 FROM b),
    d AS (SELECT *, max(s1) OVER (PARTITION BY uid ORDER BY sec, step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r1 FROM c),
    l AS (SELECT uid, arg_min({by}, ts) AS b, CASE WHEN count(CASE WHEN step = 2 AND sec - r1 <= {w} THEN 1 END) > 0 THEN 3 WHEN count(s1) > 0 THEN 2 WHEN count(s0) > 0 THEN 1 ELSE 0 END AS level FROM d GROUP BY uid),
    st AS (SELECT * FROM (VALUES (0, 'view'), (1, 'signup'), (2, 'purchase')) x(step, event_kind)),
    counted AS (SELECT st.step, st.event_kind, l.b, CAST(count(CASE WHEN level > st.step THEN 1 END) AS DOUBLE) AS value FROM l CROSS JOIN st WHERE level > 0 GROUP BY 1, 2, 3)"""


steps = tuple(E(k) for k in STEPS)
insight("funnel_counts_3step", Spec("funnel", steps), f"WITH {funnel_sql(2678400)} SELECT step, event_kind, value FROM counted")
insight("funnel_window_1h", Spec("funnel", steps, conversion_window=3600), f"WITH {funnel_sql(3600)} SELECT step, event_kind, value FROM counted")
insight("funnel_breakdown_first_touch", Spec("funnel", steps, ("$country",), 50, conversion_window=86400), f"WITH {funnel_sql(86400, by='country')} SELECT step, event_kind, b AS breakdown_0, value FROM counted", country=True)
insight("funnel_topn", Spec("funnel", steps, ("$country",), 3, conversion_window=86400), f"""WITH {funnel_sql(86400, by='country')}, top AS (SELECT b FROM counted WHERE step = 0 ORDER BY value DESC, b LIMIT 3)
    SELECT step, event_kind, CASE WHEN b IN (SELECT b FROM top) THEN b ELSE '$others' END AS breakdown_0, sum(value) AS value FROM counted GROUP BY 1, 2, 3""", country=True)  # fmt: skip


def timing_sql(w: int, by: str = "''", last: str = "") -> str:
    """Counts as funnel_sql, with the times between the steps of each user's first chain."""
    bars = ["sec < 30", "sec >= 30 AND sec < 120", "sec >= 120 AND sec < 300", "sec >= 300 AND sec < 900", "sec >= 900 AND sec < 3600", "sec >= 3600 AND sec < 21600", "sec >= 21600 AND sec < 86400", "sec >= 86400"]
    histogram = "'[' || concat_ws(',', " + ", ".join(f"count(*) FILTER (WHERE {b})" for b in bars) + ") || ']'"
    return f"""{funnel_sql(w, by=by)}, tm AS (SELECT uid, step, event_id, country, epoch_us(date_trunc('millisecond', ts)) AS us FROM r),
    nn AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY us, event_id) AS n FROM tm),
    f0 AS (SELECT uid, min(n) AS n0, arg_min(us, n) AS u0 FROM nn WHERE step = 0 GROUP BY uid),
    f1 AS (SELECT * FROM (SELECT f0.uid, n0, u0, min(n) AS n1, arg_min(us, n) AS u1 FROM f0 JOIN nn ON nn.uid = f0.uid AND nn.step = 1 AND n > n0 GROUP BY 1, 2, 3) WHERE u1 - u0 <= {w}000000),
    f2 AS (SELECT * FROM (SELECT f1.uid, n0, u0, n1, u1, min(n) AS n2, arg_min(us, n) AS u2 FROM f1 JOIN nn ON nn.uid = f1.uid AND nn.step = 2 AND n > n1 GROUP BY 1, 2, 3, 4, 5) WHERE u2 - u0 <= {w}000000),
    gp AS (SELECT uid, 1 AS step, (u1 - u0) / 1e6 AS sec FROM f1 UNION ALL SELECT uid, 2, (u2 - u1) / 1e6 FROM f2),
    ti AS (SELECT l.b, gp.step, avg(sec) AS a, quantile_cont(sec, 0.5) AS m, quantile_disc(sec, 0.95) AS p, {histogram} AS h FROM gp JOIN l USING (uid) GROUP BY 1, 2),
    al AS (SELECT c.step, c.event_kind, c.b, c.value, CASE WHEN c.step > 0 THEN round(coalesce(a, 0), 6) END AS avg_seconds, CASE WHEN c.step > 0 THEN round(coalesce(m, 0), 6) END AS median_seconds,
        CASE WHEN c.step > 0 THEN round(coalesce(p, 0), 6) END AS p95_seconds, CASE WHEN c.step > 0 THEN coalesce(h, '[0,0,0,0,0,0,0,0]') END AS histogram FROM counted c LEFT JOIN ti ON ti.b = c.b AND ti.step = c.step)"""


def timed(spark: SparkSession, sf_dir: str, breakdowns=(), limit=0) -> DataFrame:
    r = Request(Spec("funnel", steps, breakdowns, limit, conversion_window=7 * 86400, step_timing=True), FROM, TO)
    out = execute(Tables(driver_events(spark, sf_dir, country=bool(breakdowns))), r).withColumn("histogram", F.to_json("histogram"))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_seconds", "median_seconds", "p95_seconds")})


query("funnel_step_timing", f"WITH {timing_sql(7 * 86400)} SELECT * EXCLUDE (b) FROM al")(timed)
query("funnel_timing_topn", f"""WITH {timing_sql(7 * 86400, "country")}, top AS (SELECT b FROM counted WHERE step = 0 ORDER BY value DESC, b LIMIT 3)
    SELECT step, event_kind, b AS breakdown_0, value, avg_seconds, median_seconds, p95_seconds, histogram FROM al WHERE b IN (SELECT b FROM top)
    UNION ALL SELECT step, event_kind, '$others', sum(value), NULL, NULL, NULL, NULL FROM al WHERE b NOT IN (SELECT b FROM top) GROUP BY 1, 2""")(lambda spark, sf_dir: timed(spark, sf_dir, ("$country",), 3))  # fmt: skip


@query("project_isolation", f"WITH {funnel_sql(86400, 'AND value < 50')} SELECT step, event_kind, value FROM counted")
def project_isolation(spark, sf_dir):
    """Users with events in two projects: those of one only are matched."""
    events = driver_events(spark, sf_dir).withColumn("project_id", F.when(props.prop_number("value") < 50, "low").otherwise("high"))
    return execute(Tables(events), Request(Spec("funnel", steps, conversion_window=86400), FROM, TO, project="low"))


# retention
def retention_sql(unit: str, first: str, back: str, by: str = "''", t=None) -> str:
    b = t or f"CAST(date_trunc('{unit}', ts) AS TIMESTAMP)"
    return f"""WITH {CO}, w AS (SELECT *, {b} AS t FROM co WHERE {WINDOW}), c AS (SELECT uid, min(t) AS cohort_time, min(ts) AS f, arg_min({by}, ts) AS b FROM w WHERE {first} GROUP BY uid),
    z AS (SELECT cohort_time, b, CAST(count(*) AS DOUBLE) AS cohort_size FROM c GROUP BY 1, 2),
    k AS (SELECT c.cohort_time, w.t, c.b, CAST(count(DISTINCT c.uid) AS DOUBLE) AS users FROM c JOIN w ON w.uid = c.uid AND w.ts >= c.f WHERE {back.replace('kind', 'w.kind')} AND w.t >= c.cohort_time GROUP BY 1, 2, 3),
    o AS (SELECT cohort_time, t, b, users * 100.0 / cohort_size AS value, cohort_size FROM k JOIN z USING (cohort_time, b))"""


WEEK = "CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP)"
plain = " SELECT cohort_time, t, round(value, 6) AS value, cohort_size FROM o"
insight("retention_day", Spec("retention", (E("signup"),)), retention_sql("day", "kind = 'signup'", "kind = 'signup'") + plain, rounded=True)
insight("retention_week", Spec("retention", (E("signup"), E("view"))), retention_sql("week", "kind = 'signup'", "kind = 'view'", t=WEEK) + plain, "week", rounded=True)
insight("retention_return_event", Spec("retention", (E("signup"), E("purchase"))), retention_sql("day", "kind = 'signup'", "kind = 'purchase'") + plain, rounded=True)
insight("retention_breakdown", Spec("retention", (E("signup"), E("view")), ("$country",), 3), retention_sql("week", "kind = 'signup'", "kind = 'view'", "country", WEEK) + """, top AS (SELECT b FROM o GROUP BY b ORDER BY sum(cohort_size) DESC, b LIMIT 3)
    SELECT cohort_time, t, CASE WHEN b IN (SELECT b FROM top) THEN b ELSE '$others' END AS breakdown_0, round(sum(value / 100.0 * cohort_size) * 100.0 / sum(cohort_size), 6) AS value, sum(cohort_size) AS cohort_size FROM o GROUP BY 1, 2, 3""", "week", country=True, rounded=True)  # fmt: skip

# user flow
FLOW = f"""{SE}, f AS (SELECT sid, kind AS node, ts, event_id, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) AS n FROM se WHERE {WINDOW}),
    p AS (SELECT sid, node AS source, lead(node) OVER (PARTITION BY sid ORDER BY ts, event_id) AS target FROM f WHERE n <= 6),
    ed AS (SELECT source, target, CAST(count(DISTINCT sid) AS BIGINT) AS value FROM p WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2)"""
insight("user_flow_edges", Spec("user_flow", user_flow=UserFlowQuery()), f"WITH {FLOW} SELECT source, target, false AS source_others, false AS target_others, value FROM ed", gap=GAP, country=True)
insight("user_flow_pruned", Spec("user_flow", user_flow=UserFlowQuery(max_nodes=3)), f"""WITH {FLOW}, top AS (SELECT id FROM (SELECT source AS id, value FROM ed UNION ALL SELECT target, value FROM ed) GROUP BY id ORDER BY sum(value) DESC, id LIMIT 3)
    SELECT CASE WHEN s THEN source ELSE '$others' END AS source, CASE WHEN d THEN target ELSE '$others' END AS target, NOT s AS source_others, NOT d AS target_others, CAST(sum(value) AS BIGINT) AS value
    FROM (SELECT *, source IN (SELECT id FROM top) AS s, target IN (SELECT id FROM top) AS d FROM ed) WHERE s OR d GROUP BY 1, 2, 3, 4""", gap=GAP, country=True)  # fmt: skip


# top-K
def topk_sql(base: str, dim: str, agg: str, n: int) -> str:
    return f"""WITH {base}, g AS (SELECT *, {dim} AS d FROM co WHERE {WINDOW}), top AS (SELECT d FROM g GROUP BY d ORDER BY {agg} DESC, d LIMIT {n})
        SELECT CASE WHEN d IN (SELECT d FROM top) THEN d ELSE '$others' END AS dim, d NOT IN (SELECT d FROM top) AS is_others, round({agg}, 6) AS value FROM g GROUP BY 1, 2"""


topq = lambda **k: Spec("top_k", top_k=TopKQuery(**k))
insight("topk_property_others", topq(property="$country", limit=5), topk_sql(CO, "country", "CAST(count(*) AS DOUBLE)", 5), country=True)
insight("topk_event_kind", topq(dimension="event_kind", limit=2), topk_sql(CO, "kind", "CAST(count(*) AS DOUBLE)", 2), country=True)
insight("topk_unique_users_others", topq(property="k", metric="unique_users", limit=4), topk_sql(CO, "CAST(k AS VARCHAR)", "CAST(count(DISTINCT uid) AS DOUBLE)", 4), country=True)
insight("topk_user_sum", topq(dimension="user", metric="sum", metric_property="value", limit=7), topk_sql(CO, "uid", "sum(value)", 7), profiles=True, rounded=True)
insight("topk_user_avg_remerge", topq(dimension="user", metric="avg", metric_property="value", limit=7), topk_sql(CO, "uid", "sum(value) / count(value)", 7), profiles=True, rounded=True)
insight("topk_omit_others", topq(property="$country", limit=5, omit_others=True), f"WITH {CO} SELECT country AS dim, false AS is_others, CAST(count(*) AS DOUBLE) AS value FROM co WHERE {WINDOW} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5", country=True)


@query("topk_user_enriched", f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS dim, CAST(count(*) AS DOUBLE) AS value, c_name AS external_id FROM ev JOIN customer ON c_custkey = user_id WHERE {WINDOW} GROUP BY 1, 3 ORDER BY 2 DESC, 1 LIMIT 10")
def topk_user_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(driver_events(spark, sf_dir), *driver_profiles(spark, sf_dir))
    return topk.enriched(tables, Request(topq(dimension="user", omit_others=True), FROM, TO)).select("dim", "value", "external_id")


# people and activity
@query("segment_users_page", f"WITH {EV} SELECT DISTINCT uid AS distinct_id FROM ev WHERE {WINDOW} AND kind = 'purchase' AND uid > '2' ORDER BY 1 LIMIT 20")
def segment_users_page(spark, sf_dir):
    return people.segment_users(Tables(driver_events(spark, sf_dir)), Request(Spec("trends", (E("purchase"),)), FROM, TO), "2", 20)


@query("event_explorer_page", f"WITH {EV} SELECT ts AS occur_time, event_id, uid AS distinct_id, kind FROM ev WHERE {WINDOW} AND k = 5 ORDER BY ts DESC, event_id DESC LIMIT 50")
def event_explorer_page(spark, sf_dir):
    return people.explorer(Tables(driver_events(spark, sf_dir)), Request(Spec("trends", (E("", (P("k", "eq", "5"),)),)), FROM, TO), size=50)


def people_tables(spark, sf_dir):
    return Tables(driver_events(spark, sf_dir, country=True), *driver_profiles(spark, sf_dir))


@query("activity_feed", f"WITH {EV} SELECT ts AS occur_time, event_id, uid AS distinct_id, kind FROM ev WHERE uid = '7' ORDER BY ts DESC, event_id DESC LIMIT 40")
def activity_feed(spark, sf_dir):
    return people.feed(people_tables(spark, sf_dir), "anon-7", size=40)


@query("activity_heatmap", f"WITH {EV} SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM ev WHERE uid = '7' AND ts >= TIMESTAMP '2023-12-03' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1")
def activity_heatmap(spark, sf_dir):
    return people.heatmap(people_tables(spark, sf_dir), "7", TO)


@query("profile_stats", f"WITH {CO} SELECT min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events, arg_max(country, ts) AS latest_country FROM co WHERE uid = '7'")
def profile_stats(spark, sf_dir):
    return people.stats(people_tables(spark, sf_dir), "7").select("first_seen", "last_seen", "events", "latest_country")


@query("persons_union_anon", f"WITH {EV} SELECT CAST(c_custkey AS VARCHAR) AS id, true AS identified FROM customer UNION ALL SELECT DISTINCT CASE WHEN k < 10 THEN 'device-' || uid ELSE uid END, false FROM ev WHERE k < 10 OR user_id NOT IN (SELECT c_custkey FROM customer)")
def persons_union_anon(spark, sf_dir):
    """Events of small k come from devices that nobody was identified on."""
    t = people_tables(spark, sf_dir)
    device = F.when(props.prop_number("k") < 10, F.concat(F.lit("device-"), "distinct_id")).otherwise(F.col("distinct_id"))
    return people.persons(Tables(t.events.withColumn("distinct_id", device), t.profiles, t.aliases)).select("id", "identified")


@query("profile_activity", f"WITH {EV} SELECT CAST(c_custkey AS VARCHAR) AS id, min(ts) AS first_seen, max(ts) AS last_seen, count(ts) AS total_events FROM customer LEFT JOIN ev ON user_id = c_custkey GROUP BY 1")
def profile_activity(spark, sf_dir):
    return people.profile_activity(people_tables(spark, sf_dir)).select("id", "first_seen", "last_seen", "total_events")


@query("profile_list_page", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS external_id FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey DESC LIMIT 25")
def profile_list_page(spark, sf_dir):
    return people.list_profiles(people_tables(spark, sf_dir), (P("segment", "eq", "MACHINERY"),), size=25).select("id", "external_id")


# discovery
@query("event_names", f"WITH {EV} SELECT kind, count(*) AS count, max(ts) AS last_seen FROM ev GROUP BY 1")
def event_names(spark, sf_dir):
    return discovery.event_names(Tables(driver_events(spark, sf_dir)))


@query("property_keys", "SELECT 'custom' AS source, 'value' AS key, 'double' AS value_type, count(value) AS count FROM events UNION ALL SELECT 'custom', 'k', 'int', count(*) FROM events")
def property_keys(spark, sf_dir):
    return discovery.property_keys(discovery.key_buckets(driver_events(spark, sf_dir))).select("source", "key", "value_type", "count")


@query("property_values", f"WITH {EV} SELECT DISTINCT CAST(k AS VARCHAR) AS value FROM ev WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-02-01' ORDER BY 1 LIMIT 100")
def property_values(spark, sf_dir):
    return discovery.property_values(Tables(driver_events(spark, sf_dir)), "k", TO)


@query("profile_keys", "SELECT 'segment' AS key, 'string' AS value_type, count(c_mktsegment) AS count FROM customer UNION ALL SELECT 'balance', 'double', count(c_acctbal) FROM customer")
def profile_keys(spark, sf_dir):
    return discovery.profile_keys(driver_profiles(spark, sf_dir)[0])


DEEP = 6


@query("profile_keys_deep", f"SELECT '{'a.' * DEEP}segment' AS key, 'string' AS value_type, count(c_mktsegment) AS count FROM customer UNION ALL SELECT 'tags', 'other', count(*) FROM customer")
def profile_keys_deep(spark, sf_dir):
    profiles = driver_profiles(spark, sf_dir)[0]
    inner = F.concat(F.lit('{"a":' * DEEP + '{"segment":'), F.to_json(F.array(F.get_json_object(F.to_json("properties"), "$.segment"))).substr(F.lit(2), F.lit(1000)))
    document = F.concat(F.regexp_replace(inner, r"\]$", ""), F.lit("}" * (DEEP + 1)))
    return discovery.profile_keys(profiles.withColumn("properties", F.parse_json(F.concat(F.regexp_replace(document, r"\}$", ""), F.lit(',"tags":[{"b":"}"}]}')))))


@query("schema_keys", f"""WITH {CO}, pk(key) AS (VALUES ('$country'), ('$region'), ('$city'), ('$browser'), ('$browserVersion'), ('$os'), ('$osVersion'), ('$device'), ('$platform'), ('$url'), ('$utmSource'),
    ('$utmMedium'), ('$utmCampaign'), ('$pathname'), ('$hostname'), ('$referrer'), ('$referrerDomain'), ('$channel'), ('$locale'), ('$screenSize'), ('$utmTerm'), ('$utmContent'), ('$pageTitle'))
    SELECT key, 'string' AS value_type, CASE WHEN key = '$country' THEN (SELECT count(*) FROM co WHERE country <> '') WHEN key = '$browser' THEN (SELECT count(k) FROM ev) ELSE 0 END AS count FROM pk
    UNION ALL SELECT 'value', 'double', count(value) FROM events UNION ALL SELECT 'k', 'int', count(*) FROM events""")  # fmt: skip
def schema_keys(spark, sf_dir):
    keys = discovery.property_keys(discovery.key_buckets(driver_events(spark, sf_dir)))
    return discovery.schema(keys, stored_rollups(spark, sf_dir).events)


# rollups
DIMS = ("$country",)


def event_cells(spark, sf_dir):
    return rollups.event_rollup(driver_events(spark, sf_dir, country=True), DIMS)


_folders: dict[tuple, str] = {}


def rollup_events(spark, sf_dir):
    """Events with countries, sessions, and k as the browser: a dimension of which users have several values."""
    return driver_events(spark, sf_dir, country=True, session_gap=GAP).withColumn("browser", props.prop_string("k"))


def stored_rollups(spark, sf_dir) -> Rollups:
    """The rollups, written once in a session and read by every query."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _folders:
        folder = new_path(spark, "rollups")
        rollups.store(rollup_events(spark, sf_dir), folder, (*DIMS, "$browser"), DIMS)
        _folders[at] = folder
    return stored(spark, _folders[at])


def on_rollup(spec: Spec, granularity: str = "day"):
    def run(spark, sf_dir):
        tables = Tables(driver_events(spark, sf_dir, country=True))
        r = Request(spec, FROM, TO, granularity, now=datetime(2024, 3, 1))
        return execute(tables, r, stored_rollups(spark, sf_dir)).drop("event_index")

    return run


query("rollup_event_daily_build", f"""WITH {CO} SELECT kind, CAST(ts AS DATE) AS day, '$__total__' AS dim, '' AS dim_value, count(*) AS n, count(DISTINCT uid) AS users FROM co GROUP BY 1, 2
    UNION ALL SELECT kind, CAST(ts AS DATE), '$country', country, count(*), count(DISTINCT uid) FROM co GROUP BY 1, 2, 4""")(
    lambda spark, sf_dir: event_cells(spark, sf_dir).groupBy("kind", "day", "dim", "dim_value").agg(F.sum("n").alias("n"), F.count("*").alias("users"))
)
query("rollup_trends", SQL["trends_breakdown_topn_others"])(on_rollup(Spec("trends", (view,), ("$country",), 3)))
query("rollup_trends_unique_week", series("CAST(count(DISTINCT uid) AS DOUBLE)", "kind = 'purchase'", WEEK))(on_rollup(Spec("trends", (E("purchase", aggregation="unique_users"),)), "week"))
query("rollup_segmentation", SQL["segmentation_unique_or_events"])(on_rollup(Spec("segmentation", (E("view", aggregation="unique_users"), E("purchase")))))
query("rollup_topk", SQL["topk_property_others"])(on_rollup(topq(property="$country", limit=5)))
query("rollup_unique_users_others", f"""WITH {EV}, cells AS (SELECT {day()} AS t, CAST(k AS VARCHAR) AS b, count(DISTINCT uid) AS n FROM ev WHERE {WINDOW} AND kind = 'purchase' GROUP BY 1, 2),
    top AS (SELECT b FROM cells GROUP BY b ORDER BY sum(n) DESC, b LIMIT 4)
    SELECT {day()} AS t, kind AS event_kind, CASE WHEN CAST(k AS VARCHAR) IN (SELECT b FROM top) THEN CAST(k AS VARCHAR) ELSE '$others' END AS breakdown_0, CAST(count(DISTINCT uid) AS DOUBLE) AS value
    FROM ev WHERE {WINDOW} AND kind = 'purchase' GROUP BY 1, 2, 3""")(on_rollup(Spec("trends", (E("purchase", aggregation="unique_users"),), ("$browser",), 4)))  # fmt: skip


def sessions_of(spark, sf_dir):
    return rollups.session_rollup(driver_events(spark, sf_dir, True, GAP), DIMS)


query("rollup_session_build", f"WITH {SE} SELECT sid AS session_id, s AS start_time, e AS end_time, n AS event_count, country AS entry_country FROM ses")(
    lambda spark, sf_dir: sessions_of(spark, sf_dir).where("kind = ''").select("session_id", "start_time", "end_time", "event_count", F.col("entry_country_state.value").alias("entry_country"))
)


@query("rollup_session_trends", SQL["sessions_entry_country"])
def rollup_session_trends(spark, sf_dir):
    r = Request(Spec("trends", breakdowns=("$country",), breakdown_limit=5, session=SessionQuery("entry")), FROM, TO)
    return execute(Tables(driver_events(spark, sf_dir, True, GAP)), r, stored_rollups(spark, sf_dir)).drop("event_index")


@query("cookieless_exclusion", f"WITH {EV} SELECT {day()} AS t, 0 AS event_index, 'view' AS event_kind, CAST(count(DISTINCT uid) FILTER (WHERE kind = 'view' AND user_id % 3 <> 0) AS DOUBLE) AS value FROM ev WHERE {WINDOW} AND kind IN ('view', 'purchase') GROUP BY 1 UNION ALL SELECT {day()}, 1, 'purchase', CAST(count(*) FILTER (WHERE kind = 'purchase') AS DOUBLE) FROM ev WHERE {WINDOW} AND kind IN ('view', 'purchase') GROUP BY 1")
def cookieless_exclusion(spark, sf_dir):
    events = driver_events(spark, sf_dir)
    mixed = events.withColumn("distinct_id", F.when(F.col("distinct_id").cast("long") % 3 == 0, F.concat(F.lit(props.COOKIELESS), "distinct_id")).otherwise(F.col("distinct_id")))
    return execute(Tables(mixed), Request(Spec("trends", (E("view", aggregation="unique_users"), E("purchase"))), FROM, TO))


# enrichment
CHANNEL_SQL = """SELECT event_id, CASE WHEN k % 5 = 0 THEN 'Paid Search' WHEN k % 5 = 1 THEN 'Organic Social' WHEN k % 5 = 2 THEN 'Email' WHEN k % 5 = 3 THEN 'Referral' ELSE 'Direct' END AS channel
    FROM (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


@query("channel_classify", CHANNEL_SQL)
def channel_classify(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long") % 5
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    found = enrich.channel(pick("www.google.de", "m.facebook.com", "", "blog.example.org", ""), pick("", "", "newsletter", "", ""), pick("cpc", "", "", "", ""), F.lit(False))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", found.alias("channel"))


URL_SQL = """SELECT *, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS source FROM pages"""


@query("attribution_derive", f"SELECT page_id, CASE WHEN path = '' THEN '/' ELSE url_decode(path) END AS pathname, lower(host) AS hostname, source AS utm_source, 'google.com' AS referrer_domain, 'Organic Search' AS channel FROM ({URL_SQL})")
def attribution_derive(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit("https://www.google.com/search").alias("referrer"))
    return enrich.derive(pages).select("page_id", "pathname", "hostname", "utm_source", "referrer_domain", "channel")


def client_events(spark, sf_dir):
    """Pages as events, of whose automatic properties a client has sent some that only the server sets."""
    sent = {"$url": F.col("url"), "$referrer": F.lit("https://www.google.com/search"), "$channel": F.lit("Forged"), "$referrerDomain": F.lit("forged.example"), "$hostname": F.lit(""), "$locale": F.lit(" en_us "), "$plan": F.lit("pro")}
    auto = F.map_from_arrays(F.array(*map(F.lit, [*sent, "$screenWidth", "$screenHeight", "$city"])), F.array(*[c.cast("variant") for c in sent.values()], *[F.lit(n).cast("bigint").cast("variant") for n in (640, 480, 7)]))
    return canonical(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("event_id"), F.lit("u").alias("distinct_id"), F.lit("page_view").alias("kind"), F.lit(FROM).cast("timestamp").alias("occur_time"), auto.alias("auto")))


@query("attribution_policy", f"SELECT CAST(page_id AS VARCHAR) AS event_id, lower(host) AS hostname, 'Organic Search' AS channel, 'google.com' AS referrer_domain, 'en-US' AS locale, '640x480' AS screen_size, 4 AS kept, 'pro' AS plan, '7' AS city FROM ({URL_SQL})")
def attribution_policy(spark, sf_dir):
    """Derived at ingest, then promoted: the wrong-typed city, the plan and the screen's sides stay in the map."""
    done = promoted.split(enrich.attribute(client_events(spark, sf_dir)))
    return done.select("event_id", "hostname", "channel", "referrer_domain", "locale", "screen_size", F.size("auto").alias("kept"), props.prop_string("$plan").alias("plan"), props.variant_string(F.col("auto")["$city"]).alias("city"))


@query("promoted_remerge", f"SELECT CAST(page_id AS VARCHAR) AS event_id, url, lower(host) AS hostname, 'en-US' AS locale, 14 + CAST(source <> '' AS INTEGER) + CAST(regexp_matches(url, '[?&]utm_medium=[^&#]') AS INTEGER) + CAST(regexp_matches(url, '[?&]utm_campaign=[^&#]') AS INTEGER) AS n FROM ({URL_SQL})")
def promoted_remerge(spark, sf_dir):
    """What an explorer shows of a stored event: the columns back in the map."""
    done = promoted.split(enrich.attribute(client_events(spark, sf_dir).withColumn("mobile", F.lit(True)))).withColumn("bot_score", F.lit(7).cast("short"))
    text = lambda k: props.variant_string(F.col("auto")[k])
    return done.withColumn("auto", promoted.merged(done)).select("event_id", text("$url").alias("url"), text("$hostname").alias("hostname"), text("$locale").alias("locale"), F.size("auto").alias("n"))


# identity at ingest
@query("session_stitch", f"""WITH {EV}, gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY uid ORDER BY ts, event_id) > {GAP}000000 THEN 1 ELSE 0 END AS g FROM ev),
    num AS (SELECT *, sum(g) OVER (PARTITION BY uid ORDER BY ts, event_id) AS s FROM gaps) SELECT 'cookieless-' || uid AS distinct_id, min(ts) AS start_time, count(*) AS events FROM num GROUP BY uid, s""")  # fmt: skip
def session_stitch(spark, sf_dir):
    events = driver_events(spark, sf_dir).withColumn("distinct_id", F.concat(F.lit(props.COOKIELESS), "distinct_id"))
    return stitch.sessions(events, GAP).groupBy("distinct_id", "session_id").agg(F.min("occur_time").alias("start_time"), F.count("*").alias("events")).drop("session_id")


@query("identify_profiles", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS external_id, c_mktsegment AS segment, 'yes' AS asked, 'x' AS was, 0 AS is_deleted FROM customer
    UNION ALL SELECT 'a-' || c_custkey, '', NULL, NULL, 'x', 1 FROM customer""")
def identify_profiles(spark, sf_dir):
    """Every customer is identified on a device that had a profile of its own."""
    known, _ = driver_profiles(spark, sf_dir)
    device = known.withColumns({"id": F.concat(F.lit("a-"), "id"), "external_id": F.lit(""), "properties": F.parse_json(F.lit('{"was":"x","segment":"device"}'))})
    asked = known.select("project_id", "external_id", F.concat(F.lit("a-"), "id").alias("anonymous_id"), F.parse_json(F.lit('{"asked":"yes"}')).alias("properties"), F.lit(TO).cast("timestamp").alias("at"))
    rows, _ = identity.identify_all(Tables(None, known.unionByName(device)), asked)
    text = lambda k: F.nullif(F.try_variant_get("properties", f"$.{k}", "string"), F.lit("device")).alias(k)
    return rows.select("id", "external_id", text("segment"), text("asked"), text("was"), "is_deleted")


@query("erase_person", f"""WITH {SE} SELECT 'events' AS name, count(*) AS n FROM ev WHERE uid <> '7' UNION ALL SELECT 'profiles', count(*) FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'aliases', count(*) FROM customer WHERE c_custkey <> 7
    UNION ALL SELECT 'sessions', count(DISTINCT sid) FROM se WHERE uid <> '7' UNION ALL SELECT 'activity', count(DISTINCT uid) FROM ev WHERE uid <> '7'""")  # fmt: skip
def erase_person(spark, sf_dir):
    t = Tables(driver_events(spark, sf_dir, True, GAP), *driver_profiles(spark, sf_dir))
    left = identity.erase(t, "anon-7", sessions_of(spark, sf_dir).where("kind = ''"), rollups.activity_states(t.events))
    out = None
    for name, rows in left.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("profile_pipeline", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS external_id, c_mktsegment AS segment FROM customer")
def profile_pipeline(spark, sf_dir):
    """Customers as upsert messages through the stream to the log, and the latest profiles read back."""
    path = new_path(spark, "profiles")
    at = F.lit(FROM).cast("timestamp")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sent = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("p1").alias("project_id"), F.col("c_name").alias("external_id"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("properties"), F.lit(False).alias("is_deleted"), at.alias("create_time"), at.alias("update_time"))
    sent.write.parquet(f"{path}/in")
    profiles.maintain(spark.readStream.schema(sent.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    live = identity.live_profiles(Tables(None, profiles.read_profiles(spark, f"{path}/out/profiles")))
    return live.select("id", "external_id", F.try_variant_get("properties", "$.segment", "string").alias("segment"))


@query("locale_normalize", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'zh-Hans-CN' ELSE '' END AS locale FROM customer")
def locale_normalize(spark, sf_dir):
    raw = F.element_at(F.array(F.lit(" EN_us "), F.lit("zh-hANS_cn"), F.lit("  ")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", enrich.locale(raw).alias("locale"))


# streaming
def stream_of(spark, sf_dir):
    """The events table as a stream: a copy of its rows in the shared folder is read once."""
    path = new_path(spark, "stream")
    rows = driver_events(spark, sf_dir, country=True).drop("custom", "auto")
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


@query("stream_rollup_equals_batch", SQL["rollup_event_daily_build"])
def stream_rollup_equals_batch(spark, sf_dir):
    from meridio.streaming import ingest

    stream, path = stream_of(spark, sf_dir)
    ingest.maintain(stream, f"{path}/out", f"{path}/state", DIMS).awaitTermination()
    merged = rollups.merge_event_rollup(spark.read.parquet(f"{path}/out/event_rollup").drop("batch"))
    return merged.groupBy("kind", "day", "dim", "dim_value").agg(F.sum("n").alias("n"), F.count("*").alias("users"))


@query("stream_closed_buckets", f"WITH {EV} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, kind, count(*) AS count FROM ev GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, min(ts)) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 5 MINUTE")
def stream_closed_buckets(spark, sf_dir):
    from meridio.streaming import ingest

    stream, path = stream_of(spark, sf_dir)
    out = ingest.closed_buckets(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("bucket timestamp, kind string, count long").parquet(f"{path}/out")


@query("dashboard_render", f"WITH {EV} SELECT 'views' AS tile, CAST(count(DISTINCT {day()}) AS BIGINT) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM ev WHERE {WINDOW} AND kind = 'view' UNION ALL SELECT 'funnel', CAST(CASE WHEN count(*) > 0 THEN 3 ELSE 0 END AS BIGINT), NULL FROM ev WHERE {WINDOW} AND kind = 'view' UNION ALL SELECT 'broken', NULL, 'SpecError: funnel needs at least one event'")
def dashboard_render(spark, sf_dir):
    from meridio.operators import dashboards

    tiles = [dashboards.Tile("views", Spec("trends", (view,))), dashboards.Tile("funnel", Spec("funnel", steps)), dashboards.Tile("broken", Spec("funnel"))]
    done = dashboards.render(Tables(driver_events(spark, sf_dir)), tiles, FROM, TO, TO)
    return spark.createDataFrame([(d.tile.name, len(d.rows) if d.rows is not None else None, d.error) for d in done], "tile string, n_rows long, error string")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
