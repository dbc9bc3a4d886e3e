"""Shared helpers: the cluster's shared folder, written tables, models fitted by a worker, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are kept small because one document may be very long.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("meridio.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} share no other folder")
        base = "file://" + tempfile.mkdtemp(prefix="meridio-shared-")
        spark.conf.set("meridio.shared.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, emptied at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/meridio-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{path}/{name}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p.getParent(), True)


def fitted_apart(sample: DataFrame, fit: Callable[[list[tuple]], object], *columns: str):
    """What fit makes of a bounded sample's rows in order, one for each value of the first column. A worker gathers and fits: the driver's
    memory also holds Spark's own, which grows with a session's plans, so it takes the outcome alone."""

    def run(batches):
        import pandas as pd

        once = {}
        for batch in batches:
            for row in batch[list(columns)].itertuples(index=False, name=None):
                once[row[0]] = max(row, once.get(row[0], row))
        yield pd.DataFrame({"model": [pickle.dumps(fit([row for _, row in sorted(once.items())]))]})

    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row.model) if row else fit([])  # an empty table may have no task


def free_name(columns: Iterable[str], name: str) -> str:
    """The name, with as many underscores at its end as it takes not to be among the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def train_rows(column: str, modulus: int, left_out: int):
    """Rows outside the held-out remainder of crc32(id as text); null ids count as id ''."""
    return remainder(column, modulus) != left_out


def remainder(column: str, modulus: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long -> (node, component): the smallest node reachable, for every node on an edge.

    Alternating large-star and small-star steps on minima found by map-side combined
    aggregates; neighbour lists are never collected. Each round is a written table.
    """
    spark = edges.sparkSession

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    oriented = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct()
    current, path = write_table(oriented, "edges")
    seen = digest(current)
    while seen[0]:
        both = current.select(F.col("a").alias("x"), F.col("b").alias("y")).union(current.select("b", "a"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after, new = write_table(small, "edges")
        now = digest(after)
        drop_path(spark, path)
        current, path = after, new
        if now == seen:
            break
        seen = now
    return current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
