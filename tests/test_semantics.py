"""Small fixtures with known answers, parity of rollups, validation, enrichment."""

from datetime import datetime, timedelta

import pytest

from meridio.functions import enrich
from meridio.operators import dashboards, rollups
from meridio.plans.router import Rollups, event_rollup_answers, execute
from meridio.plans.spec import EventQuery as E
from meridio.plans.spec import FilterGroup, PropertyFilter, Request, SessionQuery, Spec, SpecError, TopKQuery, UserFlowQuery, validate
from meridio.sources.tables import Tables, canonical, deduplicated

JAN = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: id, kind, time, country, session."""
    data = [(f"e{i:03d}", who, kind, at, country, session) for i, (who, kind, at, country, session) in enumerate(rows)]
    return Tables(canonical(spark.createDataFrame(data, "event_id string, distinct_id string, kind string, occur_time timestamp, country string, session_id string")))


def at(day, hour=12, minute=0, second=0):
    return JAN + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second)


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def views(spark):
    return events(spark, [("alice", "page_view", at(1), "US", "s"), ("bob", "page_view", at(1), "GB", "s"), ("charlie", "page_view", at(1), "US", "s"), ("alice", "page_view", at(2), "US", "s"), ("bob", "page_view", at(2), "GB", "s"), ("alice", "page_view", at(3), "US", "s")])


def test_daily_views_and_rollup_parity(views):
    have = Rollups(rollups.event_rollup(views.events, ("$country",)))
    for agg in ("total", "unique_users", "per_user_avg"):
        for granularity in ("day", "week", "month"):
            for by in ((), ("$country",)):
                r = Request(Spec("trends", (E("page_view", aggregation=agg),), by), JAN, at(4, 0), granularity, now=at(30))
                assert event_rollup_answers(r)
                names = ("t", "event_kind", *(["breakdown_0"] if by else []), "value")
                assert rows_of(execute(views, r), *names) == rows_of(execute(views, r, have), *names)
    r = Request(Spec("trends", (E("page_view"),)), JAN, at(4, 0))
    assert [v for _, v in rows_of(execute(views, r), "t", "value")] == [3, 2, 1]


def test_funnel_and_timing(spark):
    t = events(spark, [("alice", "sign_up", at(1, 10), "", ""), ("alice", "add_to_cart", at(1, 11), "", ""), ("alice", "purchase", at(1, 12), "", ""), ("bob", "sign_up", at(1, 10), "", ""), ("bob", "add_to_cart", at(1, 14), "", ""), ("charlie", "sign_up", at(1, 10), "", "")])
    steps = (E("sign_up"), E("add_to_cart"), E("purchase"))
    r = Request(Spec("funnel", steps, step_timing=True), JAN, at(2, 0))
    got = {x.step: x for x in execute(t, r).collect()}
    assert [got[i].value for i in range(3)] == [3, 2, 1]
    assert got[0].avg_seconds is None and got[1].avg_seconds == 9000 and got[1].p95_seconds == 14400 and sum(got[1].histogram) == 2
    assert execute(t, Request(Spec("funnel", (E("nobody"),)), JAN, at(2, 0))).count() == 0


def test_retention(spark):
    rows = [(u, "sign_up", at(1, 10), "", "") for u in ("alice", "bob", "charlie")] + [(u, "login", at(d), "", "") for d, us in ((1, ("alice", "bob", "charlie")), (2, ("alice", "bob")), (3, ("alice",))) for u in us]
    got = rows_of(execute(events(spark, rows), Request(Spec("retention", (E("sign_up"), E("login"))), JAN, at(5, 0))), "t", "value", "cohort_size")
    assert [(round(v, 1), n) for _, v, n in got] == [(100.0, 3), (66.7, 3), (33.3, 3)]


def test_user_flow(spark):
    paths = {"A": ["login", "dashboard", "settings", "logout"], "B": ["login", "dashboard", "logout"], "C": ["login", "logout"], "D": ["login"]}
    t = events(spark, [(s, k, at(1, 10, i), "", s) for s, p in paths.items() for i, k in enumerate(p)])
    got = rows_of(execute(t, Request(Spec("user_flow", user_flow=UserFlowQuery()), JAN, at(2, 0))), "source", "target", "value")
    assert got == [("dashboard", "logout", 1), ("dashboard", "settings", 1), ("login", "dashboard", 2), ("login", "logout", 1), ("settings", "logout", 1)]
    hub = events(spark, [(f"u{i}", k, at(1, 10, j), "", f"s{i}") for i, x in enumerate("abcd") for j, k in enumerate(("hub", x))])
    got = rows_of(execute(hub, Request(Spec("user_flow", user_flow=UserFlowQuery(max_nodes=2)), JAN, at(2, 0))), "source", "target", "value", "target_others")
    assert got == [("hub", "$others", 3, True), ("hub", "a", 1, False)]


def test_topk_overlap_and_literal_others(spark):
    rows = [(u, "v", at(1), c, "") for c, us in (("chrome", ("u1", "u2", "u3")), ("safari", ("u4", "u5")), ("opera", ("dup",)), ("brave", ("dup",))) for u in us]
    r = Request(Spec("top_k", top_k=TopKQuery(property="$country", metric="unique_users", limit=2)), JAN, at(2, 0))
    assert rows_of(execute(events(spark, rows), r), "is_others", "dim", "value") == [(False, "chrome", 3), (False, "safari", 2), (True, "$others", 1)]
    rows = [("u", "v", at(1), c, "") for c in ["big"] * 3 + ["$others"] * 2 + ["small"]]
    r = Request(Spec("top_k", top_k=TopKQuery(property="$country", limit=2)), JAN, at(2, 0))
    assert rows_of(execute(events(spark, rows), r), "dim", "is_others", "value") == [("$others", False, 2), ("$others", True, 1), ("big", False, 3)]


def test_sessions_start_in_the_window(spark):
    t = events(spark, [("c", "v", at(2, 9), "", "C"), ("c", "v", at(2, 9, 30), "", "C"), ("d", "v", at(1, 23, 30), "", "D"), ("d", "v", at(2, 0, 30), "", "D")])
    for metric, value in (("sessions", 1), ("avg_events", 2), ("avg_duration", 1800), ("bounce_rate", 0)):
        r = Request(Spec("segmentation", session=SessionQuery(metric)), at(2, 0), at(3, 0))
        assert execute(t, r).first().value == value
        assert execute(t, r, Rollups(sessions=rollups.session_rollup(t.events, ("$country",)))).first().value == value
        assert execute(t, Request(Spec("segmentation", session=SessionQuery(metric)), at(9, 0), at(10, 0))).first().value == 0


def test_duplicate_deliveries(views):
    assert deduplicated(views.events.union(views.events)).count() == views.events.count()


@pytest.mark.parametrize(
    "spec",
    [
        Spec("funnel"), Spec("trends", conversion_window=5), Spec("segmentation", breakdowns=("a",)), Spec("trends", breakdowns=("a", "a")), Spec("trends", breakdown_limit=3),
        Spec("retention", (E("a"),) * 3), Spec("funnel", (E("a"),) * 21), Spec("funnel", (E("a", aggregation="sum", property="x"),)), Spec("trends", (E("a", aggregation="sum"),)),
        Spec("funnel", (E("a"),), conversion_window=0.5), Spec("user_flow"), Spec("trends", user_flow=UserFlowQuery()), Spec("user_flow", user_flow=UserFlowQuery(max_hops=11)),
        Spec("top_k", top_k=TopKQuery()), Spec("top_k", top_k=TopKQuery(dimension="user", metric="unique_users")), Spec("trends", groups=(FilterGroup(()),)),
        Spec("trends", (E("a", (PropertyFilter("x", "between", values=("2", "1")),)),)), Spec("trends", (E("a", (PropertyFilter("x", "gt", "b"),)),)), Spec("trends", session=SessionQuery("entry")),
    ],
)
def test_invalid_specs(spec):
    with pytest.raises(SpecError):
        validate(Request(spec, JAN, at(2)))


def test_range_caps():
    with pytest.raises(SpecError):
        validate(Request(Spec("trends"), JAN, JAN + timedelta(hours=7), "minute"))
    with pytest.raises(SpecError):
        validate(Request(Spec("trends"), at(2), JAN))


def test_attribution():
    got = enrich.attribution("https://WWW.Shop.com/a%20b?utm_source=x&utm_medium=cpc&bad=%zz", "https://www.shop.com/")
    assert got == ("/a b", "www.shop.com", "x", "cpc", "", "", "", "", False, True)
    assert enrich.attribution("ftp://a/b", "not a url")[-3:] == ("", True, False)
    assert enrich.attribution("http://a", "https://news.example.org/x")[-3:] == ("news.example.org", False, True)
    a = enrich.cookieless_id(b"salt", "p", "1.2.3.4", "ua")
    assert a.startswith("cookieless-") and a == enrich.cookieless_id(b"salt", "p", "1.2.3.4", "ua") != enrich.cookieless_id(b"other", "p", "1.2.3.4", "ua")


def test_user_agents(spark):
    from pyspark.sql import functions as F

    ua = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Version/17.0 Mobile/15E148 Safari/604.1"
    r = spark.createDataFrame([(ua,)], "ua string").select(enrich.user_agent(F.col("ua")).alias("x")).first().x
    assert (r.browser, r.browser_version, r.os, r.device, r.mobile) == ("Safari", "17", "iOS", "iPhone", True)


def test_dashboard_windows(views):
    now = datetime(2024, 3, 10, 15)
    assert dashboards.preset("24h", now) == (now - timedelta(hours=24), now)
    assert dashboards.preset("7d", now, "Asia/Kolkata")[0] == datetime(2024, 3, 3, 18, 30)
    assert dashboards.prior(*dashboards.preset("24h", now)) == (now - timedelta(hours=48), now - timedelta(hours=24))
    got = dashboards.render(views, [dashboards.Tile("a", Spec("trends", (E("page_view"),))), dashboards.Tile("b", Spec("funnel"))], JAN, at(4, 0), now)
    assert len(got[0].rows) == 3 and got[1].error.startswith("SpecError")
