"""Top-K of properties, event kinds and users, with an exact rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.functions.filters import event_property, scan
from meridio.operators.identity import identity_union, live_profiles
from meridio.plans.spec import TOPK_DEFAULT, Request


def base_rows(tables, r: Request) -> DataFrame:
    k = r.spec.top_k
    rows = scan(tables, r.spec, r.start, r.end)
    for c in ([F.col("kind") == k.kind] if k.kind else []) + [event_property(f) for f in k.filters]:
        rows = rows.where(c)
    if k.dimension == "user" or k.metric in ("unique_users", "per_user_avg"):
        rows = rows.where(props.identified(r.spec.include_cookieless))
    return rows


def top_k(tables, r: Request) -> DataFrame:
    """dim, is_others, value."""
    return by_user(tables, r) if r.spec.top_k.dimension == "user" else by_dimension(tables, r)


def by_dimension(tables, r: Request) -> DataFrame:
    """Values are ranked, then the rows aggregated again with the rest as one value, so counts of users stay exact."""
    k = r.spec.top_k
    dim = props.prop_string(k.property) if k.dimension == "property" else F.col("kind")
    rows = base_rows(tables, r).withColumn("dim", dim)
    agg = props.aggregation(k.metric, k.metric_property, None, r.spec.include_cookieless).alias("value")
    top = rows.groupBy("dim").agg(agg).orderBy(F.desc("value"), "dim").limit(k.limit or TOPK_DEFAULT)
    if k.omit_others:
        return top.select("dim", F.lit(False).alias("is_others"), "value")
    marked = rows.join(F.broadcast(top.select("dim", F.lit(True).alias("__top"))), "dim", "left")  # TOPK_MAX rows at most
    others = F.col("__top").isNull()
    return marked.groupBy(F.when(others, F.lit(props.OTHERS)).otherwise(F.col("dim")).alias("dim"), others.alias("is_others")).agg(agg)


def by_user(tables, r: Request) -> DataFrame:
    """Users by their profile where they have one; one pass of partial aggregates, merged again for the rest."""
    k = r.spec.top_k
    rows = base_rows(tables, r)
    if tables.profiles is not None:
        rows = rows.join(identity_union(tables), "distinct_id", "left").withColumn("dim", F.coalesce("profile_id", "distinct_id"))
    else:
        rows = rows.withColumn("dim", F.col("distinct_id"))
    x = props.parse_number(props.prop_string(k.metric_property)) if k.metric_property else F.lit(None).cast("double")
    users = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.count(x).alias("m"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    zero = F.lit(0.0)
    one = {"total": F.col("n").cast("double"), "sum": F.coalesce("s", zero), "avg": F.coalesce(F.col("s") / F.nullif(F.col("m"), F.lit(0)), zero), "min": F.coalesce("lo", zero), "max": F.coalesce("hi", zero)}
    again = {"total": F.sum("n").cast("double"), "sum": F.coalesce(F.sum("s"), zero), "avg": F.coalesce(F.sum("s") / F.nullif(F.sum("m"), F.lit(0)), zero), "min": F.coalesce(F.min("lo"), zero), "max": F.coalesce(F.max("hi"), zero)}
    top = users.withColumn("value", one[k.metric]).orderBy(F.desc("value"), "dim").limit(k.limit or TOPK_DEFAULT)
    if k.omit_others:
        return top.select("dim", F.lit(False).alias("is_others"), "value")
    marked = users.join(F.broadcast(top.select("dim", F.lit(True).alias("__top"))), "dim", "left")
    others = F.col("__top").isNull()
    return marked.groupBy(F.when(others, F.lit(props.OTHERS)).otherwise(F.col("dim")).alias("dim"), others.alias("is_others")).agg(again[k.metric].alias("value"))


def enriched(tables, r: Request) -> DataFrame:
    """Top users with external id and properties of their live profile."""
    p = live_profiles(tables).select(F.col("id").alias("dim"), "external_id", F.to_json("properties").alias("properties"))
    return top_k(tables, r).join(p, "dim", "left")
