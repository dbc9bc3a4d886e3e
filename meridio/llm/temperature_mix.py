"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is bisected
between 0 (equal weights) and 1 (the shares themselves) to the largest value whose weights have the
target entropy, and, if those weights repeat a source too often, to the least that keeps the
repetition limit. A source's budget of tokens is spent in epochs: an epoch is a permutation of the
source's blocks, and within blocks of its documents; the last epoch ends where the budget does, in
the middle of one block. Without a given budget, the least that reads every document once is used.

Defined results: a null source is the source ''; a null or empty text has no words and counts as
one token; rows equal in source, doc_id and text have one place and are taken or left together; an
empty table gives no rows. All columns of the input come back as they are: where one has the name of
a column of the result, that has an underscore at its end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.llm.common import drop_path, free_name, write_table

#: Tokens of a block, more only where a source has over BLOCKS times as many; the last epoch of a source cuts one block.
BLOCK_TOKENS, BLOCKS = 500_000, 1 << 17
#: Rows of a plan that may be broadcast; larger plans are joined by a shuffle.
BROADCAST_ROWS = 100_000
SEED = 11


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items()}
    z = sum(raw.values())
    return {s: x / z for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def budget_for(tokens: dict[str, int], weights: dict[str, float]) -> float:
    """The fewest tokens that read every source whole at these weights."""
    return max(n / weights[s] for s, n in tokens.items())


def repeats(tokens: dict[str, int], weights: dict[str, float], budget: float | None) -> float:
    b = budget_for(tokens, weights) if budget is None else budget
    return max(weights[s] * b / n for s, n in tokens.items())


def solve(tokens: dict[str, int], target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The exponent, by bisection: entropy falls with it, and so do the repetitions of the smallest source."""

    def bisect(holds_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds_low(mid) else (low, mid)
        return (low + high) / 2

    exponent = 1.0
    if target_entropy is not None and entropy(weights_at(tokens, 1.0)) < target_entropy:
        exponent = bisect(lambda x: entropy(weights_at(tokens, x)) >= target_entropy)
    if max_repeats is not None and repeats(tokens, weights_at(tokens, exponent), budget) > max_repeats:
        start = exponent
        exponent = start + (1 - start) * bisect(lambda x: repeats(tokens, weights_at(tokens, start + (1 - start) * x), budget) > max_repeats)
    return exponent


def mix(
    docs: DataFrame, target_share: float = 0.97, max_repeats: float = 4.0, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED
) -> DataFrame:
    """A row for each reading of a document: docs' columns and mix_tokens, mix_weight, mix_epoch, mix_block, mix_at.

    target_share: entropy aimed at, as a share of that of equal weights. mix_at (0 to 1) orders the mixture.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    counted = docs.select(
        F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("source"), F.greatest(words, F.lit(1)).cast("long").alias("tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")
    )
    sizes = {r["source"]: r.n for r in counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row a source
    if not sizes:
        sizes = {"": 1}
    target = target_share * math.log(len(sizes)) if len(sizes) > 1 else None
    weights = weights_at(sizes, solve(sizes, target, max_repeats, budget))
    total = budget_for(sizes, weights) if budget is None else budget
    source_rows = [(s, n, min(BLOCKS, max(1, -(-n // block_tokens))), weights[s], weights[s] * total * (1 + 1e-12)) for s, n in sizes.items()]
    by_source = spark.createDataFrame(source_rows, "source string, n long, blocks long, weight double, budget double")
    in_block = lambda df: df.join(F.broadcast(by_source.select("source", "blocks")), "source").withColumn("block", F.pmod("key", "blocks")).drop("blocks")
    keyed = in_block(counted)

    # blocks of each source and epoch in permuted order, with the tokens before them
    blocks = keyed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    plan = (
        blocks.join(F.broadcast(by_source), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor(F.col("budget") / F.col("n")).cast("int"))))
        .withColumn("left", F.least(F.col("budget") - F.col("epoch") * F.col("n"), F.col("n").cast("double")))
    )
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "source", "block"), "block")
    plan = (
        plan.withColumn("before", F.sum("size").over(order) - F.col("size"))
        .where(F.col("before") < F.col("left") - 1e-6)
        .withColumn("room", F.col("left") - F.col("before"))
        .select("source", "block", "epoch", "weight", "budget", "n", "before", "size", "room")
    )
    # a row for each block and epoch, in proportion to the tokens; only a plan of few rows is broadcast
    few = sum(r[2] * (1 + r[4] / r[1]) for r in source_rows) <= BROADCAST_ROWS
    plan, plan_path = write_table(plan, "plan")
    whole, _ = write_table(plan.join(reached(in_block(counted.drop("row")), plan, seed), ["source", "block", "epoch"], "left").withColumn("whole", F.col("room") >= F.col("size") - 1e-6), "plan")
    drop_path(spark, plan_path)
    out = keyed.join(F.broadcast(whole) if few else whole, ["source", "block"]).withColumn("place", place_of(seed)).where("whole or place <= last")
    # within a block the places are spread evenly over its tokens
    share = (F.col("place").cast("double") / 2.0**64 + 0.5) * F.least("size", F.col("room"))
    at = (F.col("epoch") * F.col("n") + F.col("before") + share) / F.col("budget")
    results = {"mix_tokens": F.col("tokens"), "mix_weight": F.col("weight"), "mix_epoch": F.col("epoch"), "mix_block": F.col("block"), "mix_at": F.least(at, F.lit(1.0))}
    return out.select("row.*", *[c.alias(free_name(docs.columns, name)) for name, c in results.items()])


def place_of(seed: int):
    """The place of a document in its block, in an epoch."""
    return F.xxhash64(F.lit(seed), "epoch", "key")


def reached(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """For the blocks that the budget cuts: source, block, epoch, last, the last place that it reaches.

    Tokens are first summed over 256 stretches of places; only the documents of the stretch that the budget ends in are put in order.
    """
    keys = ["source", "block", "epoch"]
    cut = plan.where(F.col("room") < F.col("size") - 1e-6).select(*keys, "room")
    rows = docs.join(cut, ["source", "block"]).withColumn("place", place_of(seed)).withColumn("part", F.shiftright("place", 56))
    parts = rows.groupBy(*keys, "part", "room").agg(F.sum("tokens").alias("size"))
    parts = parts.withColumn("before", F.sum("size").over(Window.partitionBy(*keys).orderBy("part")) - F.col("size"))
    fits = F.col("before") + F.col("size") <= F.col("room") + 1e-6
    full = parts.where(fits).groupBy(*keys).agg(F.max(F.shiftleft("part", 56).bitwiseOR(F.lit((1 << 56) - 1))).alias("last"))
    split = parts.where(~fits & (F.col("before") < F.col("room"))).select(*keys, "part", "before")
    sums = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("place"))
    some = rows.join(split, [*keys, "part"]).withColumn("sum", F.col("before") + sums).where(F.col("sum") <= F.col("room") + 1e-6)
    return full.unionByName(some.groupBy(*keys).agg(F.max("place").alias("last"))).groupBy(*keys).agg(F.max("last").alias("last"))
