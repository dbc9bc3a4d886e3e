"""User flow: transitions within sessions, and the pruned graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.functions import props
from meridio.functions.filters import scan
from meridio.plans.spec import FLOW_DEFAULTS, Request
from meridio.sources.tables import ZERO


def edges(tables, r: Request) -> DataFrame:
    """source, target, value: sessions with that transition among their first max_hops + 1 nodes."""
    flow = r.spec.user_flow
    hops = flow.max_hops or FLOW_DEFAULTS["max_hops"]
    node = props.prop_string(flow.node_property) if flow.node_property else F.col("kind")
    rows = scan(tables, r.spec, r.start, r.end).where(F.col("session_id") != ZERO).select("project_id", "session_id", "occur_time", "event_id", node.alias("source"))
    w = Window.partitionBy("project_id", "session_id").orderBy("occur_time", "event_id")
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= hops + 1)
    pairs = first.withColumn("target", F.lead("source").over(w)).where("target is not null and source <> '' and target <> '' and source <> target")
    return pairs.select("project_id", "session_id", "source", "target").distinct().groupBy("source", "target").agg(F.count("*").alias("value"))


def graph(tables, r: Request) -> DataFrame:
    """source, target, source_others, target_others, value: at most max_links links of at most max_nodes nodes and a rest."""
    flow, found = r.spec.user_flow, edges(tables, r)
    nodes, links = flow.max_nodes or FLOW_DEFAULTS["max_nodes"], flow.max_links or FLOW_DEFAULTS["max_links"]
    ends = found.select(F.col("source").alias("id"), "value").union(found.select("target", "value"))
    top = F.broadcast(ends.groupBy("id").agg(F.sum("value").alias("w")).orderBy(F.desc("w"), "id").limit(nodes).select("id"))  # max_nodes rows
    marked = found.join(top.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(top.select(F.col("id").alias("target"), F.lit(True).alias("d")), "target", "left")
    name = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(F.lit(props.OTHERS))
    out = (
        marked.where("s or d")
        .groupBy(name("s", "source").alias("source"), F.col("s").isNull().alias("source_others"), name("d", "target").alias("target"), F.col("d").isNull().alias("target_others"))
        .agg(F.sum("value").alias("value"))
    )
    kept = out.orderBy(F.desc("value"), "source", "source_others", "target", "target_others").limit(links)
    # the rest's name gets underscores while a real node of the result has it
    real = kept.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("source_others").alias("o")), F.struct(F.col("target").alias("id"), F.col("target_others").alias("o")))).alias("x"))
    clash = real.where("not x.o and x.id rlike '^[$]others_*$'").agg(F.collect_set("x.id").alias("taken"))
    free = F.array_min(F.array_except(F.transform(F.sequence(F.lit(0), F.lit(nodes + 1)), lambda i: F.concat(F.lit(props.OTHERS), F.repeat(F.lit("_"), i))), F.col("taken")))
    rest = F.broadcast(clash.select(free.alias("rest")))
    named = kept.crossJoin(rest)
    return named.select(
        F.when(F.col("source_others"), F.col("rest")).otherwise(F.col("source")).alias("source"), F.when(F.col("target_others"), F.col("rest")).otherwise(F.col("target")).alias("target"), "source_others", "target_others", "value"
    )
