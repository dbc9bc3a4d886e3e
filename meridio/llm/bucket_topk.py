"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped into buckets by length (norm), queries into blocks. A first pass over the bucket of
longest vectors gives each query a lower bound of its k-th score. By the bound, a query needs no vector
under a length of its own; blocks are of queries with like needs, and a vector goes only to the blocks
that need its length. Then, for a query and a bucket, the bound divided by both lengths is a local
cosine threshold: over 1, the whole bucket is left out; if high, coordinates prune it (each coordinate
of a unit vector within the threshold lies in a range around the query's); else the bucket's vectors of
too small a length are cut off. What remains is verified by exact integer products.

Defined results: vectors that are null or hold null or non-finite components take no part, as query
or candidate; components of any size are exact, and a score that 64 bits can't hold is an error; a
shorter vector counts as filled up with zeros; repeated rows of a vec_id count once; ties go to the
smaller vec_id; a table of fewer candidates than k gives all of them; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.llm.common import drop_path, write_table
from meridio.llm.vectors import clean_vectors, from_bytes

#: Vectors of a bucket, and queries of a block, about: the bounds of what a task holds.
BUCKET, BLOCK = 8192, 4096
#: A local cosine threshold from which coordinates prune, and how many coordinates.
STEEP, FOCUS = 0.8, 6
#: Under any score: the bound of a query that has none.
NO_BOUND = -(2**63)


def quantised(table: DataFrame, scale: int = 64, vector: str = "embedding") -> DataFrame:
    """vec_id, q (bytes of doubles floor(scale * x): a double holds them exactly), norm."""

    def floor(batches):
        for batch in batches:
            rows = [np.floor(scale * np.asarray(x, np.float64)) for x in batch["v"]]
            yield batch[["vec_id"]].assign(q=[r.astype("<f8").tobytes() for r in rows], norm=[length(r) for r in rows])

    return clean_vectors(table, vector).mapInPandas(floor, "vec_id long, q binary, norm double")


def length(v: np.ndarray) -> float:
    most = float(np.abs(v).max(initial=0))
    return most * float(np.sqrt(((v / most) ** 2).sum())) if most else 0.0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where all sums stay under 2^53, in 64 bits under 2^63, else in integers of any size."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    big = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    whole = big(a) @ big(b).T
    if any(not -(2**63) <= x < 2**63 for x in whole.ravel().tolist()):
        raise OverflowError("a score is over 64 bits")
    return whole.astype(np.int64)


def same_width(a: np.ndarray, b: np.ndarray):
    w = max(a.shape[1], b.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, w - x.shape[1])))
    return pad(a), pad(b)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], ~scores[keep]))[:k]]


def needed(bounds: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The length under which no vector's product with a query reaches its bound, rounded down by far more than an error of division."""
    return np.where(bounds <= 0, 0.0, bounds / np.maximum(norms, 1e-300)) * (1 - 1e-9)


def search(queries, bounds, ids, vectors, k: int):
    """One block of queries against one bucket: (query id, candidate id, score) of up to k for each query.

    queries: (ids, matrix, norms); bounds: for each a score that its k-th best reaches; ids, vectors: the bucket.
    """
    qid, q, qn = queries
    q, vectors, bounds = np.asarray(q, np.float64), np.asarray(vectors, np.float64), np.asarray(bounds, np.int64)
    vn = np.array([length(v) for v in vectors])
    order = np.lexsort((ids, -vn))
    ids, vectors, vn = ids[order], vectors[order], vn[order]
    q, vectors = same_width(q, vectors)
    longest = vn[0] if len(vn) else 0.0
    out = []

    def emit(i, cand, scores):
        other = (ids[cand] != qid[i]) & (scores >= bounds[i])
        cand, scores = cand[other], scores[other]
        top = best(ids[cand], scores, k)
        out.append((np.full(len(top), qid[i]), ids[cand[top]], scores[top]))

    local = np.where(bounds <= 0, -1.0, bounds / np.maximum(qn * longest, 1e-300)) - 1e-9
    need = needed(bounds, qn)
    whole = np.flatnonzero(local < STEEP)
    for at in range(0, len(whole), 256):
        part = whole[at : at + 256]
        # length pruning: the longest prefix that any query of the part needs
        n = int(np.searchsorted(-vn, -need[part].min(), side="right"))
        cand = np.arange(n)
        for i, scores in zip(part, products(q[part], vectors[:n]), strict=True):
            emit(i, cand, scores)
    steep = np.flatnonzero((local >= STEEP) & (local <= 1))
    if len(steep):
        flat = vectors / np.maximum(vn, 1e-300)[:, None]
        for i in steep:  # coordinate pruning: feasible ranges on the query's largest coordinates
            u, t = q[i] / max(qn[i], 1e-300), local[i]
            live = np.arange(len(ids))
            for f in np.argsort(-np.abs(u), kind="stable")[:FOCUS]:
                room = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t * t))) + 1e-7
                x = flat[live, f]
                # angles within acos(t) of the query's take in the axis itself where |u| > t: the range ends at -1 or 1 then
                low = -np.inf if u[f] <= -t else u[f] * t - room
                high = np.inf if u[f] >= t else u[f] * t + room
                live = live[(x >= low) & (x <= high)]
            emit(i, live, products(q[i : i + 1], vectors[live])[0])
    if not out:
        return [np.zeros(0, np.int64)] * 3
    return [np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(3)]


def meet(key, asked, bucket, k: int):
    """One block of queries and the vectors of one bucket that it needs."""
    import pandas as pd

    got = [np.zeros(0, np.int64)] * 3
    if len(asked) and len(bucket):
        queries = asked["vec_id"].to_numpy(np.int64), from_bytes(asked["q"], "<f8"), asked["norm"].to_numpy()
        got = search(queries, asked["bound"].to_numpy(np.int64), bucket["id"].to_numpy(np.int64), from_bytes(bucket["v"], "<f8"), k)
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))


def results(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """asked and vectors, each with the (bucket, block) that it goes to: up to k rows for each query and bucket."""
    left = asked.select("bucket", "block", "vec_id", "q", "norm", "bound").groupBy("bucket", "block")
    right = vectors.select(F.col("bucket").alias("in_bucket"), F.col("block").alias("for_block"), F.col("vec_id").alias("id"), F.col("q").alias("v")).groupBy("in_bucket", "for_block")
    return left.cogroup(right).applyInPandas(lambda key, a, b: meet(key, a, b, k), "query_id long, vec_id long, score long")


def places(spark, cuts: list[float]):
    """A function of a column: how many of the sorted cuts are not over a value."""
    held = spark.sparkContext.broadcast(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def place(values):
        import pandas as pd

        return pd.Series(np.searchsorted(held.value, values.to_numpy(np.float64), "right").astype(np.int32))

    return place


def top_k(table: DataFrame, k: int = 20, query_step: int = 20, scale: int = 64, vector: str = "embedding", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of every query, vec_id divisible by query_step."""
    spark = table.sparkSession
    rows, rows_path = write_table(quantised(table, scale, vector), "quantised")
    n = rows.count()
    # buckets of equal counts from the longest vectors down, ties of length dealt by a hash; written, so that they stay
    spread = rows.repartitionByRange(max(1, -(-n // bucket)), F.desc("norm"), F.xxhash64("vec_id"))
    vectors, _ = write_table(spread.withColumn("bucket", F.spark_partition_id()), "buckets")
    asked = vectors.where(F.col("vec_id") % query_step == 0).drop("bucket")
    blocks = max(1, -(-n // (query_step * block)))
    first = vectors.agg(F.min("bucket")).first()[0] or 0

    # the first pass: every block meets the longest vectors
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    ahead = results(
        asked.select("*", F.lit(first).alias("bucket"), deal.alias("block"), F.lit(NO_BOUND).alias("bound")),
        vectors.where(F.col("bucket") == first).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
        k,
    )
    kth = ahead.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(NO_BOUND)).alias("bound"))
    bounded = asked.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(NO_BOUND)))

    # blocks of queries with like needs; ties of need are dealt by a hash, so that no block is too large
    need = F.when(F.col("bound") > 0, F.col("bound") / F.greatest("norm", F.lit(1e-300)) * (1 - 1e-9)).otherwise(0.0)
    queries, _ = write_table(bounded.withColumn("need", need), "queries")
    cuts = sorted(set(queries.approxQuantile("need", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []
    placed = queries.withColumn("part", places(spark, cuts)("need"))
    sizes = placed.groupBy("part").agg(F.min("need").alias("need"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each BLOCK queries
    least, names = [], []
    for r in sizes:
        names.append((r.part, len(least), -(-r.n // block)))
        least += [r.need] * -(-r.n // block)
    parts = spark.createDataFrame(names, "part int, first int, parts int")
    dealt = placed.join(F.broadcast(parts), "part").withColumn("block", (F.col("first") + F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.col("parts"))).cast("int"))

    reaches = places(spark, least)  # how many blocks, by rising need, a length of vector is enough for
    wide = vectors.withColumn("reach", reaches("norm")).where("reach > 0")
    each = wide.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)))
    # a row for each bucket: a block goes to those that hold a vector for it
    going = wide.groupBy("bucket").agg(F.max("reach").alias("reach")).select("bucket", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("block"))
    sent = dealt.join(going, "block")
    found = results(sent, each, k)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    drop_path(spark, rows_path)
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
