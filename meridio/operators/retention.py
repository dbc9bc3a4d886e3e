"""Retention of cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.functions.filters import event_filter, scan
from meridio.operators.trends import breakdown_names
from meridio.plans.spec import DEFAULT_TOP_N, Request, SpecError


def retention(tables, r: Request, fold: bool = True) -> DataFrame:
    """cohort_time, t, breakdown_i, value (percent), cohort_size; cells without returning users have no row."""
    spec, names = r.spec, breakdown_names(len(r.spec.breakdowns))
    start, back = event_filter(spec.events[0]), event_filter(spec.events[-1])
    if start is None or back is None:
        raise SpecError("an event of retention is not empty")
    rows = scan(tables, spec, r.start, r.end).where(props.identified(spec.include_cookieless))
    at = props.bucket(F.col("occur_time"), r.granularity, r.timezone)
    touch = [F.min_by(props.prop_string(p), F.struct("occur_time", "event_id")).alias(n) for p, n in zip(spec.breakdowns, names, strict=True)]
    cohorts = rows.where(start).groupBy("distinct_id").agg(F.min(at).alias("cohort_time"), F.min("occur_time").alias("first_time"), *touch)
    sizes = cohorts.groupBy("cohort_time", *names).agg(F.count("*").cast("double").alias("cohort_size"))
    # one row for each user and bucket, at its last event, before the join
    returns = rows.where(back).groupBy("distinct_id", at.alias("t")).agg(F.max("occur_time").alias("last_time"))
    kept = (
        cohorts.join(returns, "distinct_id")
        .where((F.col("last_time") >= F.col("first_time")) & (F.col("t") >= F.col("cohort_time")))
        .groupBy("cohort_time", "t", *names)
        .agg(F.count("*").cast("double").alias("users"))
    )
    out = kept.join(sizes, ["cohort_time", *names]).select("cohort_time", "t", *names, (F.col("users") * 100.0 / F.col("cohort_size")).alias("value"), "cohort_size")
    return fold_others(out, names, spec.breakdown_limit or DEFAULT_TOP_N) if fold and names else out


def fold_others(rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """The N values of the largest sum of cohort sizes over their rows stay; the rest is averaged by cohort size."""
    top = rows.groupBy(*names).agg(F.sum("cohort_size").alias("__total")).orderBy(F.desc("__total"), *names).limit(n).select(*names, F.lit(True).alias("__top"))
    marked = rows.join(F.broadcast(top), names, "left")
    folded = [F.when(F.col("__top"), F.col(c)).otherwise(F.lit(props.OTHERS)).alias(c) for c in names]
    users = F.sum(F.col("value") / 100.0 * F.col("cohort_size"))
    size = F.sum("cohort_size")
    return marked.groupBy("cohort_time", "t", *folded).agg(F.when(size > 0, users * 100.0 / size).otherwise(0.0).alias("value"), size.alias("cohort_size"))
