"""Sharding by histogram sort.

The sort key of a row is (hash of its text, doc_id), so equal texts lie together. Splitters are
found without moving rows: candidate keys are sent to all partitions, the exact bytes below each
are counted and added up, and the probes between the two that enclose a target are refined until
every splitter meets its tolerance or cannot be refined. The same counts cut shards into ranges of
bounded bytes. Then rows are exchanged once, and sorted in these ranges, whose row counts are known
exactly, which gives gapless slots.

Defined results: a null text has no bytes but its row counts; equal texts fall into one shard
unless a boundary has to cut a group; rows equal in text and doc_id stay together; an empty table
gives no rows; shards that nothing falls into stay empty. All columns of the input come back as they
are: where one is named size, shard or slot, the result's column has an underscore at its end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.llm.common import free_name, write_table

#: Probes of a round, shared by the splitters that are still open, and how far from its target, in shares of a shard's
#: bytes, a splitter may stay.
PROBES, TOLERANCE = 8192, 0.0005
#: Bytes of a range that is sorted by itself; more only where the table has over RANGES times as many.
RANGE_BYTES, RANGES = 8 << 20, 1 << 18
LOW, HIGH = -(2**63), 2**63 - 1


def place(probes: tuple[np.ndarray, np.ndarray], k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """For each key, how many of the sorted probes are not over it."""
    p1, p2 = probes
    lo, at = np.searchsorted(p1, k1, "left"), np.searchsorted(p1, k1, "right")
    within = np.flatnonzero(lo != at)  # probes among the doc_ids of one hash
    for h in np.unique(k1[within]):
        rows = within[k1[within] == h]
        i, j = lo[rows[0]], at[rows[0]]
        at[rows] = i + np.searchsorted(p2[i:j], k2[rows], "right")
    return at


def bytes_below(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) of the rows with (k1, k2) under each probe; probes are sorted."""
    p = np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)

    def count(batches):
        import pandas as pd

        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            k1, k2, s = (batch[c].to_numpy(np.int64) for c in ("k1", "k2", "size"))
            at = place(p, k1, k2)
            size += np.bincount(at, s, len(size)).astype(np.int64)
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"at": some, "size": size[some], "n": rows[some]})

    got = {r["at"]: (r["size"], r["n"]) for r in keys.mapInPandas(count, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()}
    total = np.cumsum([got.get(i, (0, 0)) for i in range(len(probes))], axis=0)
    return [(int(a), int(b)) for a, b in total]


def between(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys strictly between two: over the hash as long as it leaves room, then over doc_id."""
    if high[0] - low[0] > 1:
        step = (high[0] - low[0]) / (n + 1)
        return sorted({(x, LOW) for i in range(1, n + 1) if low[0] < (x := low[0] + max(1, int(i * step))) < high[0]} | {(low[0] + 1, LOW)})
    bottom = low[1]
    # between the last hash's doc_ids: low[0] itself, up to the next hash
    top = high[1] if high[0] == low[0] else HIGH
    if top - bottom <= 1:
        return [(high[0], LOW)] if high[0] > low[0] and low < (high[0], LOW) < high else []
    step = (top - bottom) / (n + 1)
    return sorted({(low[0], y) for i in range(1, n + 1) if bottom < (y := bottom + max(1, int(i * step))) < top})


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES, range_bytes: int = RANGE_BYTES):
    """parts - 1 keys, the bytes below each as near its share as the keys allow, or within the tolerance; finer keys, those
    among them, with at most range_bytes between two unless no key parts them; and the rows below each of the finer keys."""
    top = keys.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("k2").alias("a"), F.max("k2").alias("b")).first()
    total = top.s or 0
    targets = [total * i / parts for i in range(1, parts)]
    slack = tolerance * total / parts
    known = {(LOW, LOW): (0, 0), (HIGH, HIGH): (total, top.n)}
    bounds = [((LOW, LOW), (HIGH, HIGH)) for _ in targets]
    done: list[tuple[int, int] | None] = [None] * len(targets)
    while any(d is None for d in done):
        open_ = {b for d, b in zip(done, bounds, strict=True) if d is None}
        want = {b: probe(b, top.a, top.b, max(2, probes // len(open_))) for b in open_}
        asked = sorted({p for x in want.values() for p in x} - known.keys())
        if asked:
            known |= dict(zip(asked, bytes_below(keys, asked), strict=True))
        for i, target in enumerate(targets):
            if done[i] is not None:
                continue
            low, high = bounds[i]
            inner = want[bounds[i]]
            low = max([low, *(p for p in inner if known[p][0] <= target)])
            high = min([high, *(p for p in inner if known[p][0] > target and p > low)])
            near = min((low, high), key=lambda p: abs(known[p][0] - target))
            # within the tolerance, or at most one row is left between the bounds, or no key is
            if abs(known[near][0] - target) <= slack or known[high][1] - known[low][1] <= 1 or not inner:
                done[i] = near
            bounds[i] = (low, high)
    cuts = sorted(done)
    limit = max(range_bytes, total // RANGES)
    while True:
        at = sorted(known)
        wide = [(a, b) for a, b in zip(at, at[1:], strict=False) if known[b][0] - known[a][0] > limit and known[b][1] - known[a][1] > 1]
        each = {x: probe(x, top.a, top.b, max(2 * int((known[x[1]][0] - known[x[0]][0]) // limit), probes // len(wide))) for x in wide}
        asked = sorted({p for x in each.values() for p in x} - known.keys())
        if not asked:
            break
        known |= dict(zip(asked, bytes_below(keys, asked), strict=True))
    fine, last = [], 0
    for a, b in zip(at[1:], at[2:], strict=False):
        if a in cuts or known[b][0] - last > limit:
            fine.append(a)
            last = known[a][0]
    return cuts, fine, [known[f][1] for f in fine]


def probe(bound, least: int, most: int, n: int) -> list[tuple[int, int]]:
    low, high = bound
    if high[0] - low[0] <= 1:  # one hash value is left: its doc_ids lie between the least and the most of the table
        low = (low[0], max(low[1], least - 1))
        if high[0] == low[0]:
            high = (high[0], min(high[1], most + 1))
        elif high[1] == LOW:
            high = (low[0], most + 1)
    return between(low, high, n)


def shard(docs: DataFrame, shards: int = 24, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with size, shard and slot; sizes of shards are near equal in bytes."""
    spark = docs.sparkSession
    keyed = docs.select(
        F.struct("*").alias("row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW + 1)).alias("k2"),
    )
    keys, _ = write_table(keyed.select("k1", "k2", "size"), "keys")
    cuts, fine, below = splitters(keys, shards, range_bytes=range_bytes)
    rows_below = np.array([0, *below], np.int64)
    # a splitter may stand for several shards, where one group holds more than a shard's bytes: those between stay empty
    shard_of = np.array([0, *[sum(c <= f for c in cuts) for f in fine]], np.int64)
    start = {int(s): int(rows_below[shard_of == s].min()) for s in np.unique(shard_of)}
    before = rows_below - np.array([start[int(s)] for s in shard_of], np.int64)
    held = spark.sparkContext.broadcast(((np.array([f[0] for f in fine], np.int64), np.array([f[1] for f in fine], np.int64)), shard_of, before))

    @F.pandas_udf("bin int, shard int, before long")
    def placed(k1, k2):
        import pandas as pd

        probes, shard_of, before = held.value
        at = place(probes, k1.to_numpy(np.int64), k2.to_numpy(np.int64))
        return pd.DataFrame({"bin": at, "shard": shard_of[at], "before": before[at]})

    order = Window.partitionBy("bin").orderBy("k1", "k2")
    each = keyed.withColumn("at", placed("k1", "k2")).withColumn("bin", F.col("at.bin"))
    # one exchange, a task for each range: a partitioning by ranges of bin is one that the window can use
    dealt = each.repartitionByRange(len(fine) + 1, "bin").withColumn("nth", F.row_number().over(order))
    name = lambda x: free_name(docs.columns, x)
    return dealt.select("row.*", F.col("size").alias(name("size")), F.col("at.shard").alias(name("shard")), (F.col("at.before") + F.col("nth") - 1).alias(name("slot")))
