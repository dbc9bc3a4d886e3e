"""Funnels: step counts, and timing between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.functions.filters import any_event, event_filter, scan
from meridio.operators.trends import breakdown_names
from meridio.plans.spec import DEFAULT_TOP_N, Request, SpecError

#: Upper bounds, in seconds, of the histogram of step times; the last is open.
BOUNDS = (30, 120, 300, 900, 3600, 21600, 86400)


def window_seconds(r: Request) -> int:
    return int(r.spec.conversion_window) if r.spec.conversion_window else int((r.end - r.start).total_seconds())


def step_events(tables, r: Request) -> DataFrame:
    conditions = [event_filter(e) for e in r.spec.events]
    if any(c is None for c in conditions):
        raise SpecError("a step is not empty")
    rows = scan(tables, r.spec, r.start, r.end).where(any_event(r.spec.events)).where(props.identified(r.spec.include_cookieless))
    touch = [props.prop_string(p).alias(n) for p, n in zip(r.spec.breakdowns, breakdown_names(len(r.spec.breakdowns)), strict=True)]
    hits = F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])
    return rows.select("distinct_id", "occur_time", "event_id", F.array_compact(hits).alias("steps"), *touch)


def levels(tables, r: Request) -> DataFrame:
    """distinct_id, level (steps reached within the window of a chain's start), first-touch breakdowns.

    For each step, the latest start of a chain that has come that far is a running maximum over the
    user's rows; every step uses the same partitioning and order, so users are shuffled once.
    """
    n, names, w = len(r.spec.events), breakdown_names(len(r.spec.breakdowns)), window_seconds(r)
    rows = step_events(tables, r).withColumn("step", F.explode("steps")).withColumn("sec", F.unix_seconds("occur_time"))
    # rows of one second and step are alike here: a user of very many events has a row for each second and step at most
    touch = F.min(F.struct("occur_time", "event_id", *names)).alias("touch")
    rows = rows.groupBy("distinct_id", "sec", "step").agg(touch) if names else rows.select("distinct_id", "sec", "step").distinct()
    before = Window.partitionBy("distinct_id").orderBy("sec", "step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s0", F.when(F.col("step") == 0, F.col("sec")))
    for k in range(1, n):
        run = F.max(f"s{k - 1}").over(before)
        rows = rows.withColumn(f"s{k}", F.when((F.col("step") == k) & (F.col("sec") - run <= w), run))
    reached = [F.when(F.max(f"s{k}").isNotNull(), k + 1).otherwise(0) for k in range(n)]
    level = F.greatest(*reached) if n > 1 else reached[0]
    out = rows.groupBy("distinct_id").agg(level.alias("level"), *([F.min("touch").alias("touch")] if names else []))
    return out.select("distinct_id", "level", *[F.col(f"touch.{c}").alias(c) for c in names])


def counts(tables, r: Request) -> DataFrame:
    """step, event_kind, breakdown_i, value; no rows without matching users."""
    return folded(tables, r).drop("kept")


def folded(tables, r: Request) -> DataFrame:
    """counts, with kept: false for the rest of the breakdowns."""
    spec, names = r.spec, breakdown_names(len(r.spec.breakdowns))
    at = [F.count(F.when(F.col("level") >= i + 1, 1)).cast("double").alias(f"v{i}") for i in range(len(spec.events))]
    cells = levels(tables, r).where("level > 0").groupBy(*names).agg(*at) if names else levels(tables, r).where("level > 0").groupBy().agg(*at).where("v0 > 0")
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(e.kind).alias("event_kind"), F.col(f"v{i}").alias("value")) for i, e in enumerate(spec.events)])
    out = cells.select(*names, F.inline(each)).select("step", "event_kind", *names, "value", F.lit(True).alias("kept"))
    if not names:
        return out
    top = out.where("step = 0").orderBy(F.desc("value"), *names).limit(spec.breakdown_limit or DEFAULT_TOP_N).select(*names, F.lit(True).alias("__top"))
    kept = F.coalesce("__top", F.lit(False))
    named = [F.when(kept, F.col(c)).otherwise(F.lit(props.OTHERS)).alias(c) for c in names]
    return out.drop("kept").join(F.broadcast(top), names, "left").groupBy("step", "event_kind", *named, kept.alias("kept")).agg(F.sum("value").alias("value"))


def matched_times(tables, r: Request) -> DataFrame:
    """distinct_id, times: occur_time (microseconds) of each matched step, from the first event of step 0 on.

    A greedy matcher of its own: a user's rows in order, each taking the first step that it matches;
    a row that matches the next step later than the window after the anchor ends the match. The row
    of each step is the least one after that of the step before: windows over one partitioning,
    which spill, so that no user's rows need fit in memory.
    """
    n, names, w = len(r.spec.events), breakdown_names(len(r.spec.breakdowns)), window_seconds(r) * 1_000_000
    timed = levels(tables, r).where("level > 1").select("distinct_id")  # the others have no time between steps
    rows = step_events(tables, r).join(timed, "distinct_id", "left_semi").withColumn("step", F.element_at("steps", 1))
    rows = rows.withColumn("at", F.struct(F.unix_micros(F.date_trunc("millisecond", "occur_time")).alias("us"), "event_id", "step"))
    user, step = Window.partitionBy("distinct_id"), F.col("step")
    rows = rows.withColumn("m0", F.min(F.when(step == 0, F.col("at"))).over(user))
    for k in range(1, n):
        next_ = F.min(F.when((step == k) & (F.col("at") > F.col(f"m{k - 1}")), F.col("at"))).over(user)
        rows = rows.withColumn("m", next_)
        late = (F.lit(w) > 0) & (F.col("m.us") - F.col("m0.us") > w)
        rows = rows.withColumn(f"m{k}", F.when(~late, F.col("m")))
    touch = F.min(F.struct("occur_time", "event_id", *names)).alias("touch")  # as in levels(), ties too
    users = rows.groupBy("distinct_id").agg(*[F.any_value(f"m{k}.us").alias(f"u{k}") for k in range(n)], touch)
    return users.select("distinct_id", *[F.col(f"touch.{c}").alias(c) for c in names], F.array_compact(F.array(*[f"u{k}" for k in range(n)])).alias("times"))


def bucket_of(seconds: Column) -> Column:
    out = F.when(seconds < BOUNDS[0], 0)
    for i, b in enumerate(BOUNDS[1:], 1):
        out = out.when(seconds < b, i)
    return out.otherwise(len(BOUNDS))


def timing(tables, r: Request) -> DataFrame:
    """step, breakdown_i, converted, avg_seconds, median_seconds, p95_seconds, histogram: for steps after the first."""
    names = breakdown_names(len(r.spec.breakdowns))
    steps = matched_times(tables, r).select(*names, F.posexplode("times").alias("step", "us"), "times").where("step > 0")
    gap = steps.withColumn("sec", (F.col("us") - F.element_at("times", F.col("step"))) / 1e6)
    bars = F.array(*[F.count(F.when(bucket_of(F.col("sec")) == i, 1)) for i in range(len(BOUNDS) + 1)])
    return gap.groupBy("step", *names).agg(
        F.count("*").alias("converted"), F.avg("sec").alias("avg_seconds"), F.expr("percentile(sec, 0.5)").alias("median_seconds"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY sec)").alias("p95_seconds"), bars.alias("histogram"),
    )


def with_timing(tables, r: Request) -> DataFrame:
    """Counts with timing attached; step 0 and the rest of the breakdowns have none, steps nobody reached have zeros."""
    names = breakdown_names(len(r.spec.breakdowns))
    out = folded(tables, r).join(timing(tables, r).withColumn("kept", F.lit(True)), ["step", *names, "kept"], "left")
    zero = F.array(*[F.lit(0).cast("long")] * (len(BOUNDS) + 1))
    later = (F.col("step") > 0) & F.col("kept")
    return out.withColumns(
        {c: F.when(later, F.coalesce(c, F.lit(0.0))) for c in ("avg_seconds", "median_seconds", "p95_seconds")} | {"histogram": F.when(later, F.coalesce("histogram", zero))}
    ).drop("converted", "kept")
