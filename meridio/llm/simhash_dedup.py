"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two link at REACH or fewer differing bits. Bits that vary together are
grouped into partitions. If the thresholds of the partitions add up to REACH - partitions + 1
(-1: not probed), any linked pair agrees within the threshold of some partition. For each
fingerprint a dynamic programme picks the thresholds with the fewest estimated candidates, from
histograms of the partitions; it probes its partitions and all meetings are verified. Rows that
meet under a hot key are dealt out in cells, every two blocks of the key meeting in one of them.
Only a spanning forest of the links of a key is passed on: the components are those of all links.

Defined results: a null text is an empty one, whose fingerprint is 0 and links like any other;
fewer words than a shingle are one shingle; equal fingerprints are one class, never expanded;
rows of a null doc_id get a fingerprint and no component; repeated rows come back as they are;
an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.llm import similar_sets
from meridio.llm.common import connected_components, drop_path, free_name, small_batches, write_table

REACH = 3
BITS = 64
#: Rows of one key that a task compares as one block; a key with more is dealt out in cells.
BLOCK = 2048
#: Estimates use histograms over this many bits of a partition.
HIST_BITS = 16
PROBE_COST = 4.0


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    return majority(similar_sets.hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its fingerprint fp as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", of(F.col("text")).alias("fp"))


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often every two bits are set together: 65 x 64 sums, whatever the input."""

    def sums(batches):
        import pandas as pd

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"i": np.r_[np.arange(BITS * BITS), -1], "x": np.r_[total.ravel(), n]})

    rows = distinct.select("fp").mapInPandas(sums, "i long, x double").groupBy("i").agg(F.sum("x")).collect()
    got = dict(rows)
    return int(got.get(-1, 0)), np.array([got.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)


def partitions(n: int, together: np.ndarray, reach: int = REACH) -> list[list[int]]:
    """Bits grouped by correlation, in so many partitions that a partition's values are about as many as fingerprints."""
    m = int(np.clip(round(BITS / np.log2(max(n, 4))), 2, reach + 1))
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        rest = sorted(free)
        of = [max(rest, key=lambda b: (like[b, rest].sum(), -b))]
        while len(of) < size:
            left = sorted(free - set(of))
            of.append(max(left, key=lambda b: (like[b, of].mean(), -b)))
        out.append(sorted(of))
        free -= set(of)
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The partition's bits of each fingerprint as one integer."""
    u, out = fp.view(np.uint64), np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= (((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64)) << j
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """For each distance up to most, the values that differ from 0 in exactly so many bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], np.int64) for k in range(most + 1)]


def cost_tables(distinct: DataFrame, groups: list[list[int]], reach: int) -> list[np.ndarray]:
    """For each partition, estimated candidates by threshold (0 to 2 at most) and histogram value."""

    def fold(batches):
        import pandas as pd

        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            parts = [values(fp, g[:HIST_BITS]) + (k << 32) for k, g in enumerate(groups)]
            v, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"v": v, "c": c})

    # 2^16 counts for each of four partitions at most
    got = distinct.select("fp").mapInPandas(fold, "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).collect()
    out = []
    for k, g in enumerate(groups):
        width = min(len(g), HIST_BITS)
        d0 = np.zeros(1 << width)
        for v, c in got:
            if v >> 32 == k:
                d0[v & 0xFFFFFFFF] = c
        at = np.arange(1 << width)
        d1 = sum(d0[at ^ (1 << b)] for b in range(width))
        d2 = (sum(d1[at ^ (1 << b)] for b in range(width)) - width * d0) / 2
        scale = 2.0 ** (width - len(g))
        balls = np.cumsum((d0, d1, d2)[: min(reach, 2) + 1], 0)
        sizes = np.cumsum([len(m) for m in masks(len(g), len(balls) - 1)])
        out.append(np.stack([b * scale + PROBE_COST * s for b, s in zip(balls, sizes, strict=True)]))
    return out


def thresholds(index: list[np.ndarray], tables: list[np.ndarray], reach: int) -> np.ndarray:
    """By dynamic programming for every row: thresholds (-1: not probed) that add up to reach - m + 1 at the least cost.

    index[k]: the row's value in partition k's histogram.
    """
    m, n = len(index), len(index[0])
    budget = reach + 1  # each partition takes threshold + 1 of it
    best = np.full((m + 1, budget + 1, n), np.inf)
    best[0, 0] = 0
    take = np.zeros((m, budget + 1, n), np.int8)
    for k in range(m):
        for used in range(budget + 1):
            for t in range(-1, min(len(tables[k]) - 1, used - 1) + 1):
                price = best[k, used - t - 1] + (tables[k][t][index[k]] if t >= 0 else 0)
                better = price < best[k + 1, used]
                best[k + 1, used] = np.where(better, price, best[k + 1, used])
                take[k, used] = np.where(better, t, take[k, used])
    out, used = np.zeros((m, n), np.int8), np.full(n, budget)
    for k in reversed(range(m)):
        out[k] = take[k, used, np.arange(n)]
        used = used - out[k] - 1
    return out


def probes(groups: list[list[int]], tables: list[np.ndarray], reach: int = REACH):
    """A mapInPandas function: (fp, node) -> a row for each partition and probed value.

    role 0: to be found only; 1: probes its own value and is found; 2: probes another value.
    """
    near = [masks(len(g), 2) for g in groups]

    def run(batches):
        import pandas as pd

        for batch in batches:
            fp, node = batch["fp"].to_numpy(np.int64), batch["node"].to_numpy(np.int64)
            full = [values(fp, g) for g in groups]
            t = thresholds([v & ((1 << min(len(g), HIST_BITS)) - 1) for v, g in zip(full, groups, strict=True)], tables, reach)
            frames = []
            for k, v in enumerate(full):
                frames.append((np.arange(len(fp)), v, (t[k] >= 0).astype(np.int8), k))
                for e in (1, 2):
                    rows = np.flatnonzero(t[k] >= e)
                    if len(rows):
                        m = near[k][e]
                        frames.append((np.repeat(rows, len(m)), (v[rows][:, None] ^ m).ravel(), np.full(len(rows) * len(m), 2, np.int8), k))
            row = np.concatenate([f[0] for f in frames])
            yield pd.DataFrame({
                "key": np.concatenate([f[1] | (f[3] << 48) for f in frames]),
                "role": np.concatenate([f[2] for f in frames]),
                "fp": fp[row],
                "node": node[row],
            })

    return run


def forest(reach: int = REACH):
    """A mapInPandas function over rows sorted by (key, cell): a spanning forest of each run's verified links."""

    def links(key, cell, block, role, fp, node):
        n = len(key)
        parent = np.arange(n)
        live = np.arange(n - 1)
        u, found = fp.view(np.uint64), []
        d = 0

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        while len(live):
            d += 1
            live = live[live + d < n]
            live = live[(key[live] == key[live + d]) & (cell[live] == cell[live + d])]
            a, b = live, live + d
            ok = (role[a] + role[b] > 0) & ~((role[a] == 2) & (role[b] == 2)) & (parent[a] != parent[b])
            a, b = a[ok], b[ok]
            ok = (block[a] != block[b]) | (cell[a] // 65536 == cell[a] % 65536)
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(u[a] ^ u[b]) <= reach
            for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                p, q = root(i), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((i, j))
            if ok.any():
                while True:
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent[:] = up
        i = np.array(found, np.int64).reshape(-1, 2)
        return node[i[:, 0]], node[i[:, 1]]

    names = ("key", "cell", "block", "role", "fp", "node")

    def run(batches):
        import pandas as pd

        held = None
        for batch in batches:
            now = [batch[c].to_numpy(np.int64) for c in names]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            whole = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            if whole:
                u, v = links(*[x[:whole] for x in held])
                yield pd.DataFrame({"u": u, "v": v})
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            u, v = links(*held)
            yield pd.DataFrame({"u": u, "v": v})

    return run


def near_links(distinct: DataFrame, reach: int = REACH) -> DataFrame:
    """distinct (fp, node) -> (u, v): links whose components are those of all pairs within reach bits."""
    spark = distinct.sparkSession
    n, together = bit_statistics(distinct)
    groups = partitions(n, together, reach)
    tables = cost_tables(distinct, groups, reach)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = distinct.mapInPandas(probes(groups, tables, reach), "key long, role byte, fp long, node long")
    hot = rows.groupBy("key").count().where(F.col("count") > 2 * BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    dealt = (
        rows.join(hot, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("fp", "role"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", (F.least("block", "other") * 65536 + F.greatest("block", "other")).alias("cell"), "block", F.col("role").cast("long").alias("role"), "fp", "node")
    )
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return dealt.repartition(width, "key", "cell").sortWithinPartitions("key", "cell").mapInPandas(forest(reach), "u long, v long")


def components(fps: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, fp) -> the same rows with component_id, the smallest doc_id reachable by links."""
    distinct, path = write_table(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprints")
    found = connected_components(near_links(distinct, reach))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = REACH) -> DataFrame:
    """A row for each row of docs: doc_id, fp (signed), component_id."""
    fps, _ = write_table(fingerprints(docs, words), "simhash")
    return components(fps, reach).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, reach: int = REACH) -> DataFrame:
    """docs without all but one of each component of near duplicates: its smallest doc_id, once.

    Near duplicates are sets of word shingles of Jaccard similarity 0.8 or more. Links of the fingerprints are verified on the
    texts; what differs in more bits than reach, as most pairs of 0.8 do, is found by similar_sets. Rows of a null doc_id
    stay; rows of one doc_id are one document, with the links of all.
    """
    spark = docs.sparkSession
    sets, _ = write_table(similar_sets.classes(docs, words, lambda h: majority(h) - (majority(h) >> 63 << 64)), "sets")
    distinct, path = write_table(sets.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near, _ = write_table(near_links(distinct, reach), "candidates")
    equal = sets.select("fp", F.col("node").alias("u")).join(distinct.withColumnRenamed("node", "v"), "fp").where("u <> v").select("u", "v")
    found = connected_components(similar_sets.links(docs, sets, near.union(equal), words))
    drop_path(spark, path)
    kept = sets.select(F.col("node").alias("doc_id")).distinct().join(found.where("node <> component").select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    nth = free_name(docs.columns, "nth")
    once = docs.join(kept, "doc_id", "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(docs.where("doc_id is null"))
