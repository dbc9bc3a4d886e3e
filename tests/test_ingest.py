"""Ingest: promotion, sessions of cookieless visitors, salts, profile logs, rebuilds, paging."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridio.functions import enrich, promoted, props, salts
from meridio.operators import identity, people, rollups
from meridio.plans.router import execute, stored
from meridio.plans.spec import EventQuery as E
from meridio.plans.spec import Request, Spec
from meridio.sources.tables import Tables, canonical, write_events
from meridio.streaming import profiles, stitch
from tests.test_semantics import JAN, at, events

V = "cookieless-v"


def times(*minutes):
    return [pd.Timestamp(JAN) + pd.Timedelta(minutes=m) for m in minutes]


def test_stitch_keeps_one_session_out_of_order():
    ids, state = stitch.assign(V, times(0, 20, 10, 45), None)
    assert len(set(ids)) == 1 and state == (ids[0], int(times(45)[0].value // 1_000_000))
    more, _ = stitch.assign(V, times(74, 200), state)
    assert more[0] == ids[0] != more[1]


def test_stitch_never_rewinds():
    ids, state = stitch.assign(V, times(600), None)
    late, after = stitch.assign(V, times(61, 62, 200), state)
    assert after == state and late[0] == late[1] != late[2] and ids[0] not in late
    again, _ = stitch.assign(V, times(61, 62, 200), state)
    assert again == late  # a batch that is sent again
    live, _ = stitch.assign(V, times(610), after)
    assert live == ids


def cookieless(spark, minutes, who=V):
    rows = [(f"e{i:03d}", who, "v", JAN + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    return canonical(spark.createDataFrame(rows, "event_id string, distinct_id string, kind string, occur_time timestamp"))


def test_stitch_in_batch_and_stream(spark, tmp_path):
    df = cookieless(spark, (0, 10, 39, 80, 81, 300)).drop("auto", "custom")
    other = cookieless(spark, (5, 50), "known").drop("auto", "custom")
    batch = {r.event_id: r.session_id for r in stitch.sessions(df.union(other)).where(F.col("distinct_id") == V).collect()}
    assert len(set(batch.values())) == 3 and batch["e000"] == batch["e002"] != batch["e003"] == batch["e004"]
    assert all(r.session_id == "00000000-0000-0000-0000-000000000000" for r in stitch.sessions(other).collect())
    path = f"file://{tmp_path}"
    for part in ("event_id < 'e003'", "event_id >= 'e003'"):
        df.union(other).where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        found = stitch.stream_sessions(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id: r.session_id for r in spark.read.parquet(f"{path}/out").collect()} == batch


def test_salts_live_two_days(spark, tmp_path):
    folder, now = f"file://{tmp_path}/salts", datetime(2024, 3, 2, 10)
    first = salts.rotate(spark, folder, now)
    assert set(first) == {"2024-03-01", "2024-03-02"} and all(len(s) == 32 for s in first.values())
    assert salts.rotate(spark, folder, now + timedelta(hours=5)) == first
    later = salts.rotate(spark, folder, now + timedelta(days=1))
    assert set(later) == {"2024-03-02", "2024-03-03"} and later["2024-03-02"] == first["2024-03-02"]
    rows = [("p", None, datetime(2024, 3, d, 5), "ip", "ua") for d in (1, 2, 3)] + [("p", "own", datetime(2024, 1, 1), "ip", "ua")]
    df = spark.createDataFrame(rows, "project_id string, distinct_id string, occur_time timestamp, ip string, user_agent string")
    got = [(r.distinct_id, r.drop_reason) for r in enrich.cookieless_ids(df, later, "2024-03-03", "2024-03-02").orderBy("occur_time").collect()]
    assert got[0] == ("own", None) and got[1] == (None, "salt_unavailable")
    assert [g[0] for g in got[2:]] == [enrich.cookieless_id(later[f"2024-03-0{d}"], "p", "ip", "ua") for d in (2, 3)]


def test_promotion_by_type(spark):
    auto = {"$country": "'US'", "$city": "7", "$mobile": "true", "$verified_bot": "'no'", "$bot_score": "300", "$plan": "'pro'"}
    df = canonical(cookieless(spark, (0,)).drop("auto")).drop("auto").withColumn("auto", F.expr("map(" + ", ".join(f"'{k}', cast({v} as variant)" for k, v in auto.items()) + ")"))
    r = promoted.split(df).select("country", "city", "mobile", "verified_bot", "bot_score", F.array_sort(F.map_keys("auto")).alias("rest")).first()
    assert tuple(r) == ("US", "", True, None, None, ["$bot_score", "$city", "$plan", "$verified_bot"])
    done = promoted.split(df).withColumn("bot_score", F.lit(9).cast("short"))
    back = done.withColumn("auto", promoted.merged(done)).select(*[props.variant_string(F.col("auto")[k]).alias(k[1:]) for k in ("$country", "$city", "$mobile", "$bot_score", "$plan")]).first()
    assert tuple(back) == ("US", "7", "true", "9", "pro")


def test_places_scores_and_types(spark):
    df = spark.createDataFrame([("US", "CA", "Unknown", "12"), ("XX", None, "Paris", "999"), ("T1", "r", None, "x")], "c string, r string, t string, s string")
    got = [(tuple(r.g), r.b) for r in df.select(enrich.geo(F.col("c"), F.col("r"), F.col("t")).alias("g"), enrich.bot_score(F.col("s")).alias("b")).collect()]
    assert got == [(("US", "CA", ""), 12), (("", "", "Paris"), None), (("", "r", ""), None)]
    typed = df.limit(1).select(enrich.coerce(F.expr("map('$bot_score', '5', '$mobile', 'true', 'x', '5')")).alias("m"))
    assert tuple(typed.select(*[F.schema_of_variant(F.col("m")[k]) for k in ("$bot_score", "$mobile", "x")]).first()) == ("BIGINT", "BOOLEAN", "STRING")


def log(spark, rows):
    return spark.createDataFrame([(i, "p", x, json.dumps(m), d, JAN, JAN, t) for i, x, m, d, t in rows], profiles.PROFILE)


def test_identify_merges_and_buries(spark):
    known = log(spark, [("t", "ann", {"a": 1, "b": 1}, 0, JAN), ("x", "", {"b": 2, "c": 2}, 0, JAN), ("y", "", {"d": 3}, 0, JAN)]).withColumn("properties", F.parse_json("properties"))
    rows = [("p", "ann", "x", '{"e":5}', at(2)), ("p", "ann", "y", '{"e":6}', at(3)), ("p", "new", "z", "{}", at(2)), ("p", "ann", "t", "{}", at(1)), ("p", "", "y", "{}", at(4))]
    asked = spark.createDataFrame(rows, "project_id string, external_id string, anonymous_id string, properties string, at timestamp").withColumn("properties", F.parse_json("properties"))
    out, aliases = identity.identify_all(Tables(None, known), asked)
    got = {r.id: (r.external_id, json.loads(r.p), r.is_deleted) for r in out.withColumn("p", F.to_json("properties")).collect()}
    assert got.pop("t") == ("ann", {"a": 1, "b": 1, "c": 2, "d": 3, "e": 6}, 0)
    assert {i: d for i, (_, _, d) in got.items() if i in "xy"} == {"x": 1, "y": 1}
    new = next(i for i in got if i.startswith("p-"))
    assert got[new] == ("new", {}, 0)
    assert sorted((r.alias_id, r.profile_id) for r in aliases.collect()) == [("x", "t"), ("y", "t"), ("z", new)]


def test_profile_pipelines_write_batches_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    sent = "id string, project_id string, external_id string, properties string, is_deleted boolean, create_time timestamp, update_time timestamp"
    spark.createDataFrame([("a", "p", "ann", None, None, JAN, JAN), ("x", "p", None, '{"k":1}', False, JAN, JAN), ("", "p", "", "{}", False, JAN, JAN)], sent).write.parquet(f"{path}/in")
    profiles.maintain(spark.readStream.schema(sent).parquet(f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    assert spark.read.parquet(f"{path}/out/rejected").count() == 1
    asked = spark.createDataFrame([("p", "ann", "x", at(2))], "project_id string, external_id string, anonymous_id string, at timestamp").withColumn("properties", F.parse_json(F.lit("{}")))
    later = asked.withColumn("at", F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    for _ in range(2):  # a batch that is run again
        profiles.identify_batch(spark, later, f"{path}/out", 1)
    t = Tables(None, profiles.read_profiles(spark, f"{path}/out/profiles"), profiles.read_aliases(spark, f"{path}/out/aliases"))
    assert t.profiles.count() == 4 and [(r.id, json.loads(r.p)) for r in identity.live_profiles(t).select("id", F.to_json("properties").alias("p")).collect()] == [("a", {"k": 1})]
    assert [r.id for r in identity.get_profile(t, "x").collect()] == ["a"] and [r.id for r in identity.get_profile(t, "ann", external=True).collect()] == ["a"]
    assert identity.get_profile(t, "", external=True).count() == 0


def test_rebuild_takes_the_place_of_what_was(spark, tmp_path):
    folder = f"file://{tmp_path}/rollups"
    t = events(spark, [("a", "v", at(1), "US", "s"), ("b", "v", at(1), "GB", "t")])
    r = Request(Spec("trends", (E("v", aggregation="unique_users"),), ("$country",)), JAN, at(4, 0), now=at(30))
    for rows in (t.events.limit(1), t.events):
        rollups.rebuild(rows, folder, ("$country",), ("$country",))
    assert execute(t, r, stored(spark, folder)).count() == 2
    assert spark.read.parquet(f"{folder}/event_names").first()["count"] == 2


def test_pages_go_on_from_a_cursor(spark):
    t = events(spark, [(f"u{i}", "v", at(1 + i // 3), "", "") for i in range(10)])
    r, seen, cursor = Request(Spec("trends"), JAN, at(9)), [], None
    while page := people.explorer(t, r, cursor, 4).collect():
        seen += [x.event_id for x in page]
        cursor = page[-1].occur_time, page[-1].event_id
    assert seen == [f"e{i:03d}" for i in sorted(range(10), reverse=True)]


def test_events_are_written_once_by_month(spark, tmp_path):
    t = events(spark, [("a", "v", at(1), "", ""), ("b", "v", at(40), "", "")])
    rows = t.events.drop("auto", "custom")
    write_events(rows.union(rows), f"file://{tmp_path}/events")
    got = spark.read.parquet(f"file://{tmp_path}/events")
    assert sorted((r.event_id, r.occur_month) for r in got.collect()) == [("e000", 202401), ("e001", 202402)]


def test_projects_do_not_mix(spark):
    t = events(spark, [("a", "x", at(1), "", "s"), ("a", "y", at(2), "", "s")])
    both = Tables(t.events.withColumn("project_id", F.when(F.col("kind") == "x", "one").otherwise("two")))
    for project, n in (("one", 0), ("two", 0), ("", 1)):
        got = {r.step: r.value for r in execute(both, Request(Spec("funnel", (E("x"), E("y"))), JAN, at(5), project=project)).collect()}
        assert got.get(1, 0) == n
    assert execute(both, Request(Spec("segmentation", (E("x"),)), JAN, at(5), project="one")).first().value == 1


@pytest.mark.parametrize("agg", ["total", "unique_users"])
def test_several_events_with_breakdowns_on_the_rollup(spark, agg):
    t = events(spark, [("a", "x", at(1), "US", ""), ("b", "x", at(1), "GB", ""), ("c", "y", at(2), "FR", ""), ("d", "x", at(2), "FR", "")])
    r = Request(Spec("trends", (E("x", aggregation=agg), E("y", aggregation=agg)), ("$country",), 1), JAN, at(4, 0), now=at(30))
    from meridio.plans.router import Rollups

    have = Rollups(rollups.event_rollup(t.events, ("$country",)))
    rows = lambda df: sorted((x.t, x.event_index, x.event_kind, x.breakdown_0, x.value) for x in df.collect())
    assert rows(execute(t, r)) == rows(execute(t, r, have))
