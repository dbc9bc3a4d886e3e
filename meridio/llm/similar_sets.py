"""Links between sets of word shingles of Jaccard similarity 4/5 or more: what SimHash near-dedup holds its candidates against.

A set has, besides its size, a parity bitmap of twice as many bits: two bitmaps differ in no more bits
than the sets in members, so a pair whose bitmaps differ too much is given up without its texts. Sets
that share a band of min-hashes are candidates: each is held against one hub of each of its bands, and
then, of the bands whose sets still are in different components, those outside the largest component
against all. Candidates that pass the bitmaps are verified on whole texts. A band has ROWS of BANDS *
ROWS min-hashes: a pair of similarity 0.8 shares none with a probability of (1 - 0.8^4)^25, 2 in a million.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.llm.common import connected_components, small_batches, write_table

BANDS, ROWS = 25, 4
#: Candidates of a set that a round verifies, and such rounds, before all that are left between components are.
FIRST, ROUNDS = 2, 2
#: Texts whose shingles a task holds while it verifies.
HELD = 64
_RNG = np.random.default_rng(42)
_SALT, _ODD = (_RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] for _ in range(2))
_ODD = _ODD * np.uint64(2) + np.uint64(1)


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; words are parted by ASCII white space, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(w) - words + 1)
    last = ends[np.minimum(np.arange(n) + words - 1, len(w) - 1)]
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def bitmap(members: np.ndarray) -> np.ndarray:
    """For each value of the members' lowest bits, whether an odd number of them has it."""
    width = max(64, 1 << int(2 * len(members) - 1).bit_length()) if len(members) else 64
    odd = np.bincount((members & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def bands(members: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(members):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(members), 4096):
        least = np.minimum(least, ((members[None, at : at + 4096] ^ _SALT) * _ODD).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of 4/5 or more: 9 common >= 4 (n + m)."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def classes(docs: DataFrame, words: int, fingerprint) -> DataFrame:
    """A row for each distinct shingle set: node (its smallest doc_id), fp, n, bits, bands."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                every = hashes(text, words)
                members = np.unique(every)
                rows.append((doc, xxhash.xxh64_intdigest(members.tobytes()) - 2**63, fingerprint(every), len(members), bitmap(members), bands(members)))
            yield pd.DataFrame(rows, columns=["doc_id", "set_id", "fp", "n", "bits", "bands"])

    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = found.mapInPandas(run, "doc_id long, set_id long, fp long, n int, bits array<long>, bands array<long>")
    return rows.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("n", "bits", "bands")]).drop("set_id")


def difference(x: str, y: str) -> str:
    """SQL: in how many bits two bitmaps differ; the wider one is folded, since sets of like sizes are one step apart at most."""

    def folded(a: str, b: str) -> str:
        half = f"size({b}.bits)"
        return f"if(size({a}.bits) > {half}, zip_with(slice({a}.bits, 1, {half}), slice({a}.bits, {half} + 1, {half}), (p, q) -> p ^ q), {a}.bits)"

    return f"aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (t, e) -> t + e)"


def may_be_similar(x: str, y: str) -> str:
    """SQL: sizes and bitmaps leave room for 4/5: the sets differ in (n + m) / 9 members at most."""
    return f"5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n) and 9 * {difference(x, y)} <= {x}.n + {y}.n"


def verified(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(u, v) of doc_ids -> those whose texts are similar."""
    small_batches(pairs.sparkSession)
    members = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id", "left_semi")
    texts = found.groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text"))  # repeated rows once
    left, right = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("s")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("t"))

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def of(i, text):
            key = i, hash(text)
            if key not in held:
                if len(held) >= HELD:
                    held.clear()
                held[key] = np.unique(hashes(text, words))
            return held[key]

        for batch in batches:
            ok = [similar(of(u, s), of(v, t)) for u, s, v, t in zip(batch["u"], batch["s"], batch["v"], batch["t"], strict=True)]
            yield batch.loc[ok, ["u", "v"]]

    return pairs.join(left, "u").join(right, "v").select("u", "v", "s", "t").mapInPandas(run, "u long, v long").distinct()


def pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def links(docs: DataFrame, sets: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """(u, v) of nodes, whose components are those of all pairs of similar sets. candidates: (u, v) to begin with, a few for each set."""
    keys = sets.select("node", F.explode("bands").alias("key"))
    hub = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))["node"].alias("hub")
    met = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), hub).where("low < high").select("key", "hub")
    shared, _ = write_table(keys.join(met, "key"), "keys")

    digest = sets.select("node", "n", "bits")
    toward = shared.where("node <> hub").select("node", "hub").union(candidates.select(F.greatest("u", "v"), F.least("u", "v"))).distinct()
    x, y = digest.select("node", F.struct("n", "bits").alias("x")), digest.select(F.col("node").alias("hub"), F.struct("n", "bits").alias("y"))
    held = toward.join(x, "node").join(y, "hub").where(may_be_similar("x", "y"))
    near, _ = write_table(held.select("node", "hub", F.expr(difference("x", "y")).alias("d")).groupBy("node", "hub").agg(F.min("d").alias("d")), "near")

    found, tried, placed = None, None, sets.select("node", F.col("node").alias("component"))
    for last in [*[False] * ROUNDS, True]:
        rest = apart(near, placed)
        if last:
            rest = rest.select(*pair("node", "hub")).union(outside(shared, digest, placed).select(*pair("node", "hub"))).distinct()
        else:  # the likeliest few of each set
            nth = F.row_number().over(Window.partitionBy("node").orderBy("d", "hub"))
            rest = rest.withColumn("nth", nth).where(F.col("nth") <= FIRST).select(*pair("node", "hub")).distinct()
        if tried is not None:
            rest = rest.join(tried, ["u", "v"], "left_anti")
        now, _ = write_table(rest, "tried")
        good, _ = write_table(verified(now, docs, words), "links")
        found = good if found is None else found.union(good)
        tried = now if tried is None else tried.union(now)
        if not last:
            named = connected_components(found).withColumnRenamed("node", "__node")
            placed, _ = write_table(sets.select("node").distinct().join(named, F.expr("node = __node"), "left").select("node", F.coalesce("component", "node").alias("component")), "placed")
    return found


def apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (node, hub) between different components."""
    a, b = placed.select("node", F.col("component").alias("a")), placed.select(F.col("node").alias("hub"), F.col("component").alias("b"))
    return pairs.join(a, "node").join(b, "hub").where("a <> b").drop("a", "b")


def outside(shared: DataFrame, digest: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, hub) of sets that share a band, are in different components and may be similar: of a band's sets, those
    outside its largest component against all."""
    rows = shared.select("key", "node").join(placed, "node")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed, _ = write_table(rows.join(main, "key").join(digest, "node").select("key", "node", "component", "main", "n", "bits"), "mixed")
    x, y = mixed.where("component <> main").alias("x"), mixed.alias("y")
    return x.join(y, F.expr(f"x.key = y.key and x.component <> y.component and {may_be_similar('x', 'y')}")).select(F.col("x.node").alias("node"), F.col("y.node").alias("hub"))
