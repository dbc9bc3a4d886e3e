"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned to their principal axes, the axis of largest variance first, and dealt to tiles
by their places on the first two. A vector meets another tile only if the box of that tile's vectors on
the leading axes is near enough to hold a link. Tiles are compared two by two: inner products are
accumulated over the leading axes, and a pair is given up when what it has plus the product of both
suffix norms cannot reach the threshold. Pairs that remain are verified in double precision on the
vectors as given. Equal vectors are one class with a count, so copies are never expanded; a tile pair
passes on counts of links and a spanning forest.

Defined results: null vectors, zero vectors and those with null or non-finite components link with
nothing; so do vectors of different lengths; repeated rows of one vec_id are one vector and come
back as one row; rows of a null vec_id have no link and come back as one row, not kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.llm.common import connected_components, drop_path, write_table
from meridio.llm.vectors import clean_vectors, from_bytes

COSINE = 0.9
#: Vectors of a tile, more only where a length has over TILES times as many.
TILE, TILES = 4096, 4096
#: Axes that the boxes of tiles have; lengths of vector that are turned, the most frequent ones, and their coordinates that are.
BOX, TURNED, TURNED_AXES = 4, 4, 1024
#: Shares of the axes after which the bound is tested.
STEPS = (0.25, 0.5, 0.75)
#: Rows of a tile that are compared at a time, and pairs that are verified at a time: they bound the memory of a task.
STRIP, PAIRS = 512, 1 << 17
SLACK = 1e-5


def classes_of(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row for each different non-zero vector: rep (smallest vec_id), n rows, dim, raw (bytes)."""
    good = clean_vectors(table, vector).where(F.exists("v", lambda x: x != 0))

    def pack(batches):
        for batch in batches:
            yield batch[["vec_id"]].assign(dim=[len(x) for x in batch["v"]], raw=[(np.asarray(x, "<f8") + 0.0).tobytes() for x in batch["v"]])

    return good.mapInPandas(pack, "vec_id long, dim int, raw binary")


def axes(classes: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Principal axes of the unit vectors of each length, by falling variance, in one job; TURNED_AXES^2 sums for each are gathered at most."""

    def sums(batches):
        import pandas as pd

        total = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = unit(from_bytes(part["raw"], "<f8"))[:, :TURNED_AXES]
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, x in total.items():
            yield pd.DataFrame({"dim": dim, "i": np.arange(x.size), "x": x.ravel()})

    rows = classes.where(F.col("dim").isin(dims)).select("dim", "raw").mapInPandas(sums, "dim int, i long, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).collect() if dims else []
    gram = {d: np.zeros(min(d, TURNED_AXES) ** 2) for d in dims}
    for r in rows:
        gram[r.dim][r.i] = r.x
    out = {}
    for d, x in gram.items():
        k = min(d, TURNED_AXES)
        out[d] = np.ascontiguousarray(np.linalg.eigh(x.reshape(k, k))[1][:, ::-1])
    return out


def turned(u: np.ndarray, rotation: np.ndarray | None) -> np.ndarray:
    """Vectors on their axes: the leading coordinates turned, the others, and lengths without a rotation, as they are."""
    if rotation is None:
        return u
    k = len(rotation)
    return u @ rotation if k == u.shape[1] else np.hstack([u[:, :k] @ rotation, u[:, k:]])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tile_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray | None, cosine: float, same: bool):
    """Verified pairs (i, j) of rows of a and b with cosine at or over the threshold; i < j in the same tile."""
    ua, ub = unit(a), unit(b)
    pa, pb = turned(ua, rotation).astype(np.float32), turned(ub, rotation).astype(np.float32)
    dim = a.shape[1]
    cuts = sorted({max(1, int(dim * s)) for s in STEPS} | {dim})
    tails = lambda p: [np.sqrt(np.maximum((p[:, c:] ** 2).sum(1), 0)) for c in cuts]
    ta, tb = tails(pa), tails(pb)
    for at in range(0, len(a), STRIP):
        s = slice(at, min(at + STRIP, len(a)))
        dot = pa[s, : cuts[0]] @ pb[:, : cuts[0]].T
        dot += np.multiply.outer(ta[0][s], tb[0]) - np.float32(cosine - SLACK)
        near = np.nonzero(dot >= 0)
        for n in range(0, len(near[0]), PAIRS):
            i, j = near[0][n : n + PAIRS] + at, near[1][n : n + PAIRS]
            if same:
                i, j = i[i < j], j[i < j]
            have = np.einsum("ij,ij->i", pa[i, : cuts[0]], pb[j, : cuts[0]])
            for k in range(1, len(cuts)):
                have = have + np.einsum("ij,ij->i", pa[i, cuts[k - 1] : cuts[k]], pb[j, cuts[k - 1] : cuts[k]])
                left = have + ta[k][i] * tb[k][j] >= cosine - SLACK
                i, j, have = i[left], j[left], have[left]
            real = np.einsum("ij,ij->i", ua[i], ub[j]) >= cosine
            yield i[real], j[real]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """label, a root for each row, after the pairs (i, j) are joined: the smaller root stays."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def dealt(classes: DataFrame, rotations: dict[int, np.ndarray], cosine: float, tile: int) -> DataFrame:
    """classes with (low, high), the pairs of tiles that each takes part in, and tile, its own."""
    spark = classes.sparkSession
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row for each length of vector
    grid = {}
    for d, n in counts.items():
        tiles = min(TILES, -(-n // tile))
        slabs = int(np.ceil(np.sqrt(tiles)))
        grid[d] = slabs, -(-tiles // slabs)
    turn = spark.sparkContext.broadcast(rotations)

    @F.pandas_udf("array<double>")
    def leading(dim, raw):
        import pandas as pd

        out = pd.Series([None] * len(dim), index=dim.index, dtype=object)
        for d, part in raw.groupby(dim):
            p = turned(unit(from_bytes(part, "<f8")), turn.value.get(d))[:, :BOX]
            out[part.index] = list(np.pad(p, ((0, 0), (0, BOX - p.shape[1]))))
        return out

    def cut(df: DataFrame, by: list[str], axis: int, parts: dict[int, int], name: str) -> DataFrame:
        """The place of a row among the parts of its group, by rising coordinate."""
        each = F.array(*[F.lit(i / 64) for i in range(1, 64)])  # 63 of them in each of 64 slabs at most
        quantiles = df.groupBy(*by).agg(F.percentile_approx(F.col("p")[axis], each, 10_000).alias("__q"))
        share = spark.createDataFrame([(d, n) for d, n in parts.items()], "dim int, __parts int")
        place = F.size(F.filter("__q", lambda q: q <= F.col("p")[axis]))  # 0 to 63
        return df.join(F.broadcast(quantiles), by).join(F.broadcast(share), "dim").withColumn(name, F.floor(place * F.col("__parts") / 64).cast("int")).drop("__q", "__parts")

    rows, path = write_table(classes.withColumn("p", leading("dim", "raw")), "turned")
    rows = cut(rows, ["dim"], 0, {d: g[0] for d, g in grid.items()}, "slab")
    rows = cut(rows, ["dim", "slab"], 1, {d: g[1] for d, g in grid.items()}, "cell")
    rows, new = write_table(rows, "cells")
    drop_path(spark, path)
    # cells that ties make too large are dealt out by a hash
    sizes = rows.groupBy("dim", "slab", "cell").agg(F.count("*").alias("n"), *[f(F.col("p")[x]).alias(f"{f.__name__}{x}") for f in (F.min, F.max) for x in range(BOX)]).orderBy("dim", "slab", "cell").collect()
    names, boxes, lengths = [], [], []
    for r in sizes:
        parts = max(1, round(r.n / max(tile, counts[r.dim] / TILES)))
        names.append((r.dim, r.slab, r.cell, len(boxes), parts))
        boxes += [[[r[f"min{x}"], r[f"max{x}"]] for x in range(BOX)]] * parts
        lengths += [r.dim] * parts
    named = spark.createDataFrame(names, "dim int, slab int, cell int, first int, parts int")
    held = spark.sparkContext.broadcast((np.array(boxes, float).reshape(-1, BOX, 2), np.array(lengths, np.int64)))  # a box for each TILE vectors, 2 * TILES or so at most for a length
    reach = 2 - 2 * cosine + 1e-6  # squared distance of unit vectors that link

    @F.pandas_udf("array<int>")
    def meets(tile, dim, p):
        import pandas as pd

        boxes, lengths = held.value
        out = []
        for at in range(0, len(tile), 256):
            own = tile.to_numpy()[at : at + 256]
            x = np.stack(p.to_numpy()[at : at + 256])[:, None, :]
            gap = np.maximum(np.maximum(boxes[None, :, :, 0] - x, x - boxes[None, :, :, 1]), 0)
            near = ((gap * gap).sum(2) <= reach) & (lengths[None] == dim.to_numpy()[at : at + 256, None])
            near[np.arange(len(own)), own] = True
            out += [np.flatnonzero(r).astype(np.int32) for r in near]
        return pd.Series(out)

    own = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")
    placed = rows.join(F.broadcast(named), ["dim", "slab", "cell"]).withColumn("tile", own)
    each = placed.withColumn("other", F.explode(meets("tile", "dim", "p")))
    return each.select("dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "rep", "n", "raw")


def links(classes: DataFrame, rotations: dict[int, np.ndarray], cosine: float, tile: int) -> DataFrame:
    """u, v, n: links counted for each class (u = v, n over 0), and the forest edges between classes (n 0)."""
    held = classes.sparkSession.sparkContext.broadcast(rotations)

    def compare(key, frame):
        import pandas as pd

        dim, low, high = key
        a = frame[frame["tile"] == low]
        b = a if low == high else frame[frame["tile"] == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        ids = a["rep"].to_numpy() if low == high else np.r_[a["rep"].to_numpy(), b["rep"].to_numpy()]
        size = a["n"].to_numpy() if low == high else np.r_[a["n"].to_numpy(), b["n"].to_numpy()]
        shift = 0 if low == high else len(a)
        label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        xa = from_bytes(a["raw"], "<f8")
        xb = xa if low == high else from_bytes(b["raw"], "<f8")
        for i, j in tile_pairs(xa, xb, held.value.get(dim), cosine, low == high):
            j = j + shift
            np.add.at(count, i, size[j])
            np.add.at(count, j, size[i])
            join_labels(label, i, j)
        k, e = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"u": np.r_[ids[k], ids[e]], "v": np.r_[ids[k], ids[label[e]]], "n": np.r_[count[k], np.zeros(len(e), np.int64)]})

    return dealt(classes, rotations, cosine, tile).groupBy("dim", "low", "high").applyInPandas(compare, "u long, v long, n long")


def near_duplicates(table: DataFrame, cosine: float = COSINE, vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vec_id of the table."""
    packed, _ = write_table(classes_of(table, vector), "vectors")
    classes, _ = write_table(packed.groupBy("dim", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    often = classes.groupBy("dim").count().where("count > 1").orderBy(F.desc("count"), "dim").limit(TURNED).collect()
    found, path = write_table(links(classes, axes(classes, sorted(r.dim for r in often)), cosine, tile), "links")
    counted, _ = write_table(found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links")), "counts")
    members = connected_components(found.where("n = 0").select("u", "v"))
    drop_path(table.sparkSession, path)
    by_class = (
        classes.join(counted, "rep", "left")
        .join(members.withColumnRenamed("node", "rep"), "rep", "left")
        .select("dim", "raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    linked = packed.join(by_class, ["dim", "raw"]).select("vec_id", "n_links", "component_id")
    return ids.join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    )
