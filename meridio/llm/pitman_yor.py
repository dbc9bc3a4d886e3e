"""Language-model scoring with a hierarchical Pitman-Yor model.

The restaurant of a context serves the next token. A context is the whole word before (one more stands
before the first word); each has a restaurant of its own, and all share one parent, the restaurant
without context, whose parent is uniform over the known tokens and one for all unknown ones. Customers
are exact counts of pairs over the whole training corpus; no pair and no context is left out. Words
are told apart by their 64-bit hashes. Seating is sampled by Gibbs: in a sweep, the customers of a token in
a restaurant get up and are seated again, each at a new table with the probability that the other
tables and the parent give, and the tables become the parent's customers. Cells are independent
given the tables' totals, so a sweep runs over all of them in parallel, with the totals of the sweep
before. A customer who is alone with a dish in a restaurant has one table in every seating, so such
cells stay as they are and count in the totals. Predictive probabilities are averaged over the sweeps after the first BURN.

Every token of every text is scored. Texts are read once, in blocks: a block's different pairs, with the
rows that hold them, are dealt to parts by context (those of a hot context by both words). A part counts
its pairs, seats its cells and adds up what its pairs give to each row of a block; shards of words hold the
root's dishes, and parts ask them. Rows between tasks are arrays of many pairs, so nothing is done pair by pair.

Defined results: a null or empty text is its end alone; without training texts every token has
probability 1 (one unknown outcome); rows equal in doc_id and text are scored alike and all come
back; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.llm.common import file_system, new_path, remainder, small_batches, write_table

BURN, SAMPLES = 1, 2
DISCOUNT, STRENGTH = 0.75, 5.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
#: Most words that head_of takes; also of hot contexts, 4,096 at most, that make up one token in HOT_SHARE of a sample each. These only spread work.
HEAD, HOT_SHARE = 1 << 16, 10_000
#: Tokens of a block, unless one batch has more; bytes of text for each part.
BLOCK, PART_BYTES = 2_000_000, 16 << 20
#: Pairs lie in so many slices by part, and are scored a slice at a time, so that only one is on its way at once.
SLICES = 8
#: No word is empty or a space: the token after the last word, and the context of the first.
END, START = b"", b" "
#: Kinds of rows. PAIRS: a block's pairs of one part, with the rows they are in; COUNTED: the same, of which only the counts are asked. MORE: a part's
#: cells of more than one customer. ASK: a part's words of one shard; ANSWER: what the shard has of them. DISH: a shard's words. SUM: tables of a part
#: for a shard. HOT: what a part has of a hot context. VIEW: a cell or dish of its own, for reading only.
PAIRS, COUNTED, MORE, ASK, ANSWER, DISH, SUM, HOT, VIEW = range(9)
ROWS = "kind int, at long, p int, data binary, a long, b long, c long, d long, rest binary"
#: A cell of a view as bytes: context, customers, tables; the last field is not used.
CELL = np.dtype([("k", ">i8"), ("c", ">i8"), ("t", ">i8"), ("p", ">f8")])


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def context(word: bytes) -> int:
    """As Spark's xxhash64 of the word."""
    x = xxhash.xxh64_intdigest(word, 42)
    return x - (1 << 64) if x >> 63 else x


def contexts(words: list[bytes]) -> list[int]:
    """The context that each token and the end follow."""
    return [context(w) for w in (START, *words)]


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def pack(*arrays) -> bytes:
    return pickle.dumps(arrays, 5)


def small(x: np.ndarray) -> np.ndarray:
    """The same numbers, none below zero, in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def unpacked(table: pa.Table, kind: int | None = None) -> list[tuple]:
    """The arrays of each row (of one kind), by at and p, so that their order doesn't depend on the shuffle."""
    of = [i for i, k in enumerate(table.column("kind").to_pylist()) if kind is None or k == kind]
    at, p, data = (table.column(x) for x in ("at", "p", "data"))
    return [pickle.loads(data[i].as_buffer()) for i in sorted(of, key=lambda i: (at[i].as_py(), p[i].as_py() or 0))]


def rows_of(found: list[tuple]) -> pa.Table:
    """Rows of ROWS; a tuple may end early."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
    full = [(*x, *[None] * (9 - len(x))) for x in found]
    return pa.Table.from_arrays([pa.array([x[i] for x in full], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in ROWS.split(", ")])


def grouped(run, *parts: DataFrame) -> DataFrame:
    """run over all rows of equal at."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    whole = parts[0].select(names)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(names))
    return whole.groupBy("at").applyInArrow(run, ROWS)


def summed(at: np.ndarray, x, n: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    return np.rint(np.bincount(at, weights=x, minlength=n)).astype(np.int64)


def sent(kind: int, to: np.ndarray, p: int, parts: int, *columns: np.ndarray) -> list[tuple]:
    """A row for each shard, with the words of to that are there and what columns have of them."""
    shard = np.mod(to, parts)
    by = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[by], np.arange(parts + 1))
    return [(kind, s, p, pack(to[by[i:j]], *[small(x[by[i:j]]) for x in columns])) for s, (i, j) in enumerate(pairwise(edges.tolist())) if j > i]


def found_at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the asked ones that are there lie in the sorted keys, and which they are."""
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    there = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
    return at[there], there


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a pair of hashes; equal ones are told apart by the hashes."""
    return u * np.int64(-7046029254386353131) + w


def merged(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, and which of them each is."""
    key = mixed(u, w)
    by = np.argsort(key)
    for again in (False, True):
        su, sw = u[by], w[by]
        new = np.r_[True, (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])][: len(by)]
        sk = key[by]
        if again or not (new[1:] & (sk[1:] == sk[:-1])).any():
            break
        by = np.lexsort((w, u))
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    return su[new], sw[new], of


def seat(c: np.ndarray, base: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after c customers of each dish came one by one; base: (strength + discount * tables) * parent's probability.

    Many customers come in groups of a fiftieth of those seated, for which the rate of new tables is held.
    """
    t = np.minimum(c, 1).astype(np.int64)
    live = np.flatnonzero(c > 1)
    seated = 1
    while len(live):
        step = max(1, seated // 50)
        n = np.minimum(step, c[live] - seated)
        rate = base[live] / (seated - discount * t[live] + base[live])
        t[live] += (rng.random(len(live)) < rate) if step == 1 else rng.binomial(n, np.clip(rate, 0, 1))
        seated += step
        live = live[c[live] > seated]
    return np.minimum(t, c)


class Deal:
    """How pairs are dealt: a context's to one part, but those of hot contexts, that would fill it, by both words. Any choice gives the same counts."""

    def __init__(self, docs: DataFrame):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = min(-(-size // PART_BYTES) or 1, 1 << 15)
        seen = Counter(chain.from_iterable(tokens(r[0]) for r in docs.select(F.substring("text", 1, 4000)).limit(1000).collect()))  # 4 MB at most
        often = [w for w, n in seen.most_common(min(HEAD, 4096)) if n * HOT_SHARE >= seen.total()]
        self.hot = np.unique(np.array([context(w) for w in (START, *often)], np.int64))


def pairs_of(docs: DataFrame, deal: Deal, name: str) -> tuple[DataFrame, str]:
    """doc_id, text, counted -> rows of PAIRS by block and part, in slices; a block's ids and sizes in slice -1. Hashes, no text.

    data of PAIRS: contexts, pairs of each, words, word of each pair, counted occurrences; rest: occurrences, and the row of each in its block."""
    parts, hot = deal.parts, deal.hot

    def run(batches):
        class Ids(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        blocks = count(TaskContext.get().partitionId() << 33)

        def block():
            at = next(blocks)
            h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in ids), np.uint64, len(ids)).view(np.int64)
            order = np.argsort(h)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            h = h[order]
            size, kept = np.concatenate(sizes), np.concatenate(counted)
            w = rank[np.concatenate(flat)]
            u = np.r_[0, w[:-1]]
            u[np.r_[0, np.cumsum(size)[:-1]]] = rank[0]
            row = np.repeat(np.arange(len(size)), size)
            bits, low = len(h).bit_length(), len(size).bit_length()
            pair = u << bits | w
            if 2 * bits + low < 64:
                pair = np.sort(pair << low | row)
                row, pair = pair & (1 << low) - 1, pair >> low
            else:
                by = np.lexsort((row, pair))
                row, pair = row[by], pair[by]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            times = np.diff(np.r_[first, len(pair)])
            n = np.add.reduceat(kept[row].astype(np.int64), first)
            u, w = pair[first] >> bits, pair[first] & (1 << bits) - 1
            part = np.mod(h, parts)[u]
            spread = np.flatnonzero(np.isin(h, hot)[u])
            part[spread] = np.mod(mixed(h[u[spread]], h[w[spread]]), parts)
            part = part.astype(np.uint16)
            row = row[np.argsort(np.repeat(part, times), kind="stable")].astype(np.uint16)
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(parts + 1))
            ends = np.r_[0, np.cumsum(times[by])]
            ps, data, rest = [], [], []
            for p, (i, j) in enumerate(pairwise(edges.tolist())):
                if j > i:
                    a = by[i:j]
                    x = u[a]
                    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    words, of = np.unique(w[a], return_inverse=True)
                    ps.append(p)
                    data.append(pack(h[x[new]], small(np.diff(np.r_[new, j - i])), h[words], small(of), small(n[a])))
                    rest.append(pack(small(times[a]), row[ends[i] : ends[j]]))
            data.append(pack(np.concatenate(doc_ids), np.concatenate(valid), size))
            k = len(ps)
            return batch_of(
                kind=pa.array([PAIRS] * (k + 1), pa.int32()), block=pa.array([at] * (k + 1), pa.int64()), p=pa.array([*ps, -1], pa.int32()), data=pa.array(data, pa.binary()), rest=pa.array([*rest, None], pa.binary()),
                docs=pa.array([len(size)] * (k + 1), pa.int64()), slice=pa.array([*[p % SLICES for p in ps], -1], pa.int32()),
            )

        def fresh():
            return Ids({START: 0}), [], [], [], [], []

        ids, flat, sizes, counted, doc_ids, valid = fresh()
        held = rows = 0
        for batch in batches:
            texts = [tokens(x) for x in batch.column("text").to_pylist()]
            if not texts:
                continue
            size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            if held and (held + size.sum() > BLOCK or rows + len(texts) >= 1 << 16):
                yield block()
                ids, flat, sizes, counted, doc_ids, valid = fresh()
                held = rows = 0
            flat.append(np.fromiter(map(ids.__getitem__, chain.from_iterable([*x, END] for x in texts)), np.int32, size.sum()))
            sizes.append(size)
            counted.append(batch.column("counted").to_numpy(zero_copy_only=False).astype(bool))
            doc_ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            held, rows = held + int(size.sum()), rows + len(texts)
        if held:
            yield block()

    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "counted").mapInArrow(run, "kind int, block long, p int, data binary, rest binary, docs long, slice int")
    return written_in_slices(found, name)


def as_rows(pairs: DataFrame, kind: int = PAIRS) -> DataFrame:
    """As rows of ROWS: at is the part, a the block, b its number of documents."""
    none = F.lit(None).cast("long")
    return pairs.select(F.lit(kind).alias("kind"), F.col("p").cast("long").alias("at"), "p", "data", F.col("block").alias("a"), F.col("docs").alias("b"), none.alias("c"), none.alias("d"), F.col("rest") if kind == PAIRS else F.lit(None).cast("binary").alias("rest"))


def part_of(table: pa.Table) -> tuple:
    """The pairs of a part: context, word and count of each different one, and the blobs as block, documents, occurrences, rows, which pairs."""
    kinds, data, blocks, docs, occurrences = (table.column(x) for x in ("kind", "data", "a", "b", "rest"))
    of = [i for i, k in enumerate(kinds.to_pylist()) if k in (PAIRS, COUNTED)]
    us, ws, ns, rest = [], [], [], []
    for i in of:
        u, times_u, words, w, n = pickle.loads(data[i].as_buffer())
        us.append(np.repeat(u, times_u))
        ws.append(words[w])
        ns.append(n)
        if kinds[i].as_py() == PAIRS:
            rest.append((len(us) - 1, blocks[i].as_py(), docs[i].as_py(), *pickle.loads(occurrences[i].as_buffer())))
    if not of:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    u, w, at = merged(np.concatenate(us), np.concatenate(ws))
    edges = np.r_[0, np.cumsum([len(x) for x in us])]
    return u, w, summed(at, np.concatenate(ns), len(u)), [(block, n, times, row, at[edges[i] : edges[i + 1]]) for i, block, n, times, row in rest]


def written_in_slices(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """As write_table, in folders by the columns of by and slice."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(4 * SLICES))  # else rows are sorted first
    path = new_path(spark, name)
    df.write.partitionBy(*by, "slice").option("compression", "zstd").parquet(path)
    spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")
    return spark.read.schema(df.schema).parquet(path), path


def drop_folder(spark, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def release(spark) -> None:
    """Shuffle files go when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def cells_of(pairs: DataFrame, deal: Deal) -> tuple[DataFrame, list[str]]:
    """Of each part: its cells of more customers, each at one table (many); what it asks of words and has of them, and of hot contexts."""
    parts, hot = deal.parts, deal.hot

    def run(table: pa.Table) -> pa.Table:
        p = table.column("at")[0].as_py()
        u, w, c, _ = part_of(table)
        words, at = np.unique(w, return_inverse=True)
        found = sent(ASK, words, p, parts, summed(at, c, len(words)), summed(at, c == 1, len(words)), summed(at, c > 0, len(words)))
        rooms, at = np.unique(u, return_inverse=True)
        room, n1, more = summed(at, c, len(rooms)), summed(at, c == 1, len(rooms)), summed(at, c > 1, len(rooms))
        i, there = found_at(hot, rooms)
        found += [(HOT, *x[:1], p, None, *x[1:]) for x in zip(i.tolist(), room[there].tolist(), n1[there].tolist(), more[there].tolist(), strict=True)]
        many = np.flatnonzero(c > 1)
        if len(many):
            used, of = np.unique(at[many], return_inverse=True)
            found.append((MORE, p, p, pack(rooms[used], small(n1[used]), small(of), w[many], small(c[many]), np.ones(len(many), np.uint8), [])))
        return rows_of(found)

    cells, paths = None, []
    for i in range(min(SLICES, parts)):
        counted = grouped(run, as_rows(pairs.where(F.col("slice") == i), COUNTED))
        found, path = written_in_slices(counted.withColumns({"many": F.col("kind") == MORE, "slice": F.lit(i)}), "cells", "many")
        cells, paths = cells.unionByName(found) if cells else found, [*paths, path]
        release(pairs.sparkSession)
    return cells, paths


def dish(w, c, n1, t, t0, before, at: int) -> tuple:
    return DISH, at, None, pack(w, small(c), small(n1), small(t), small(t0), before), int(t.sum()), int(t0.sum()), int(c.sum()), len(w)


def first_dishes(table: pa.Table) -> pa.Table:
    asks = unpacked(table)
    w, at = np.unique(np.concatenate([x[0] for x in asks]), return_inverse=True)
    c, n1, t = (summed(at, np.concatenate([x[i] for x in asks]), len(w)) for i in (1, 2, 3))
    k = c > 0
    return rows_of([dish(w[k], c[k], n1[k], t[k], np.ones(k.sum(), np.int64), [], table.column("at")[0].as_py())])


def of_kind(df: DataFrame, *kind: int) -> DataFrame:
    return df.where(F.col("kind").isin(*kind))


def hot_sums(rows: DataFrame, deal: Deal) -> np.ndarray:
    """Customers, cells of one customer and tables of the others, of each hot context."""
    out = np.zeros((3, len(deal.hot)), np.int64)
    for r in of_kind(rows, HOT).groupBy("at").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abc"]).collect():  # 4,097 rows at most
        out[:, r["at"]] = r.a, r.b, r.c
    return out


def state_of(more: DataFrame, dishes: DataFrame, total: dict) -> DataFrame:
    """All rows of a seating; a filter by kind reads only those of that kind. Rows with a word are a view of all cells, made when asked for:
    word, cells (CELL), t0 (the word's tables in the root)."""

    def cells(table: pa.Table) -> pa.Table:
        u, w, c, _ = part_of(table)
        one, found = c == 1, []
        found += zip(w[one].tolist(), u[one].tolist(), c[one].tolist(), c[one].tolist(), strict=True)
        for rooms, _, of, w, c, t, _ in unpacked(table, MORE):
            found += zip(w.tolist(), rooms[of].tolist(), c.tolist(), t.tolist(), strict=True)
        return rows_of([(VIEW, w, None, np.array((k, c, t, 0), CELL).tobytes()) for w, k, c, t in found])

    def top(table: pa.Table) -> pa.Table:
        return rows_of([(VIEW, w, None, None, t0) for w, _, _, _, t0, _ in unpacked(table) for w, t0 in zip(w.tolist(), t0.tolist(), strict=True)])

    def word(table: pa.Table) -> pa.Table:
        return rows_of([(VIEW, table.column("at")[0].as_py(), None, b"".join(x for x in table.column("data").to_pylist() if x), max(x or 0 for x in table.column("a").to_pylist()))])

    none = [F.lit(None).cast(kind).alias(x) for x, kind in (("word", "binary"), ("cells", "binary"), ("t0", "long"))]
    view = grouped(word, grouped(cells, as_rows(total["pairs"].where("slice >= 0"), COUNTED), more), grouped(top, dishes))
    view = view.select("at", F.col("data").alias("cells"), F.col("a").alias("t0")).join(total["names"], "at")
    rows = [x.split() for x in ROWS.split(", ")]
    view = view.select(F.lit(VIEW).alias("kind"), *[F.lit(None).cast(kind).alias(x) for x, kind in rows[1:]], "word", "cells", "t0")
    names = [x for x, _ in rows[1:]]
    return more.select(F.lit(MORE).alias("kind"), *names, *none).unionByName(dishes.select(F.lit(DISH).alias("kind"), *names, *none)).unionByName(view)


def totals(state: DataFrame) -> dict:
    """Customers and tables of the root, tokens, words."""
    r = of_kind(state, DISH).agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "abcd"]).first()
    return dict(zip(("c0", "t0", "n", "v"), map(float, r), strict=True))


def unknown_probability(total: dict) -> float:
    return (ROOT_STRENGTH + ROOT_DISCOUNT * total["t0"]) / (ROOT_STRENGTH + total["c0"]) / (total["v"] + 1)


def root_probability(c0, t0, total: dict):
    return (c0 - t0 * ROOT_DISCOUNT) / (ROOT_STRENGTH + total["c0"]) + unknown_probability(total)


def answers(asks: DataFrame, dishes: DataFrame, samples: bool) -> DataFrame:
    """For each part, of the words asked that are known: customers, then tables and tables in the root, now or at each sample too."""

    def run(table: pa.Table) -> pa.Table:
        found, kinds = [], table.column("kind").to_pylist()
        if DISH not in kinds:
            return rows_of([])
        (w, c, _, t, t0, before), = unpacked(table, DISH)
        columns = [c, *(chain.from_iterable(before) if samples else ()), t, t0]
        p, data = table.column("p"), table.column("data")
        for i, kind in enumerate(kinds):
            if kind == ASK:
                asked = pickle.loads(data[i].as_buffer())[0]
                at, there = found_at(w, asked)
                found.append((ANSWER, p[i].as_py(), table.column("at")[0].as_py(), pack(asked[there], *[small(x[at]) for x in columns])))
        return rows_of(found)

    return grouped(run, asks, dishes)


def answered(table: pa.Table, w: np.ndarray, n: int) -> list[np.ndarray]:
    """The n columns of the answers for each of w, which are sorted; 0 for words that are not known."""
    out = np.zeros((n, len(w)))
    for words, *columns in unpacked(table, ANSWER):
        at, there = found_at(w, words)
        for x, y in zip(out, columns, strict=True):
            x[at] = y[there]
    return list(out)


def sweep(state: DataFrame, total: dict, seed: int, sample: bool) -> DataFrame:
    """One Gibbs sweep over all restaurants, then over the root; the seating before it is added to the samples if asked.

    The new tables are written; their paths are total's "written", the tables of hot contexts its "seated"."""
    root, deal = {x: total[x] for x in ("c0", "t0", "n", "v")}, total["deal"]
    parts, hot, hot_tables = deal.parts, deal.hot, total["hot"][1] + total["hot"][2]
    more, dishes = of_kind(state, MORE), of_kind(state, DISH)

    def ask(batches):
        for b in batches:
            for p, data in zip(b.column("p").to_pylist(), b.column("data"), strict=True):
                yield from rows_of(sent(ASK, np.unique(pickle.loads(data.as_buffer())[3]), p, parts)).to_batches()

    def restaurants(table: pa.Table) -> pa.Table:
        p = table.column("at")[0].as_py()
        ((rooms, n1, of, w, c, t, before),) = unpacked(table, MORE)
        words, at = np.unique(w, return_inverse=True)
        _, c0, t0 = (x[at] for x in answered(table, words, 3))
        tk = n1 + summed(of, t, len(rooms))
        i, there = found_at(hot, rooms)
        tk[there] = hot_tables[i]
        # the dish's own tables in a restaurant get up, from it and from the parent
        rest = np.maximum(c0 - t, 0)
        base = (STRENGTH + DISCOUNT * np.maximum(tk[of] - t, 0)) * root_probability(rest, np.minimum(t0, rest), root)
        seated = small(seat(c.astype(np.int64), base, DISCOUNT, np.random.default_rng([seed, p])))
        found = [(MORE, p, p, pack(rooms, n1, of, w, c, seated, [*before, t] if sample else before))]
        found += sent(SUM, words, p, parts, summed(at, seated, len(words)))
        mine = summed(of, seated, len(rooms))[there]
        return rows_of(found + [(HOT, i, p, None, 0, 0, n) for i, n in zip(i.tolist(), mine.tolist(), strict=True)])

    def parent(table: pa.Table) -> pa.Table:
        shard = table.column("at")[0].as_py()
        ((w, c, n1, t, t0, before),) = unpacked(table, DISH)
        now = n1.astype(np.int64)
        for words, n in unpacked(table, SUM):
            now[found_at(w, words)[0]] += n
        own = (ROOT_STRENGTH + ROOT_DISCOUNT * np.maximum(root["t0"] - t0.astype(np.int64), 0)) / (root["v"] + 1)
        return rows_of([dish(w, c, n1, now, seat(now, own, ROOT_DISCOUNT, np.random.default_rng([seed, 1 << 32, shard])), [*before, (t, t0)] if sample else before, shard)])

    spark = state.sparkSession
    small_batches(spark)
    asks = more.select(list(x.split()[0] for x in ROWS.split(", "))).mapInArrow(ask, ROWS)
    seated, a = written_in_slices(grouped(restaurants, more, answers(asks, dishes, False)).withColumn("slice", F.col("kind")), "seating")
    served, b = write_table(grouped(parent, dishes, seated.where(F.col("slice") == SUM)), "seating")
    total["written"], total["seated"] = [a, b], hot_sums(seated.where(F.col("slice") == HOT), deal)[2]
    return state_of(seated.where(F.col("slice") == MORE), served, total)


class Model:
    """pairs: the training pairs; state: the last seating, with those of the samples before; asks: the words that the pairs' parts ask for;
    hot: of hot contexts customers, cells of one customer, and tables at each sample."""

    def __init__(self, pairs: DataFrame, path: str, state: DataFrame, asks: DataFrame, deal: Deal, hot: tuple, samples: list[dict]):
        self.pairs, self.path, self.state, self.asks, self.deal, self.hot, self.samples = pairs, path, state, asks, deal, hot, samples
        self.n, self.v = int(samples[-1]["n"]), int(samples[-1]["v"])
        self.unknown = np.array([unknown_probability(t) for t in samples])

    def unknown_log(self):
        return np.log10(self.unknown.mean())


def names_of(docs: DataFrame) -> DataFrame:
    """at (hash), word: all words; only views ask for them."""

    def run(batches):
        for batch in batches:
            words = list({*chain.from_iterable(tokens(x) for x in batch.column("text").to_pylist()), END})
            yield batch_of(at=pa.array([context(w) for w in words], pa.int64()), word=pa.array(words, pa.binary()))

    return docs.select("text").mapInArrow(run, "at long, word binary").distinct()


def train(docs: DataFrame, seed: int = 3) -> Model:
    """Fit on all rows of docs."""
    docs, deal = docs.withColumn("counted", F.lit(True)), Deal(docs)
    return fitted(docs, deal, *pairs_of(docs, deal, "pairs"), seed)


def fitted(docs: DataFrame, deal: Deal, pairs: DataFrame, path: str, seed: int = 3) -> Model:
    """Fit on the counted rows of docs, whose pairs are given."""
    spark = docs.sparkSession
    cells, written = cells_of(pairs, deal)
    asks, hot = of_kind(cells.where("not many"), ASK), hot_sums(cells.where("not many"), deal)
    dishes, first = write_table(grouped(first_dishes, asks), "seating")
    total = {"pairs": pairs, "names": names_of(docs.where("counted")), "deal": deal}
    state = state_of(cells.where("many"), dishes, total)
    total, seated, samples, paths = total | totals(state) | {"hot": hot}, [], [], [first, *[f"{p}/many=true" for p in written]]
    for i in range(BURN + SAMPLES):
        state = sweep(state, total, seed + i, sample=i > BURN)
        for p in paths:
            drop_folder(spark, p)
        paths, hot = total["written"], (hot[0], hot[1], total["seated"])
        total |= totals(state) | {"hot": hot}
        release(spark)
        if i >= BURN:
            samples.append({x: total[x] for x in ("c0", "t0", "n", "v")})
            seated.append(hot[1] + hot[2])
    return Model(pairs, path, state, asks, deal, (hot[0], hot[1], seated), samples)


def head_of(model: Model) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """The most frequent words, by hash: their places, counts, and log probabilities in the root."""
    samples = model.samples

    def run(table: pa.Table) -> pa.Table:
        ((w, c, _, t, t0, before),) = unpacked(table, DISH)
        p = np.mean([root_probability(x, y, s) for (x, y), s in zip([*before, (t, t0)], samples, strict=True)], 0)
        by = np.argsort(-c.astype(np.int64), kind="stable")[:HEAD]
        return rows_of([(DISH, k, None, None, n, q) for k, n, q in zip(w[by].tolist(), c[by].tolist(), p[by].view(np.int64).tolist(), strict=True)])

    rows = grouped(run, of_kind(model.state, DISH)).orderBy(F.desc("a"), "at").limit(HEAD).collect()
    return {r["at"]: i for i, r in enumerate(rows)}, np.array([r.a for r in rows], np.int64), np.log10(np.array([r.b for r in rows], np.int64).view(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 of the text's probability), one row for each row of docs."""
    parts = model.deal.parts
    pairs, path = pairs_of(docs.withColumn("counted", F.lit(False)), model.deal, "asked")

    def ask(batches):
        for b in batches:
            for p, data in zip(b.column("p").to_pylist(), b.column("data"), strict=True):
                yield from rows_of(sent(ASK, pickle.loads(data.as_buffer())[2], p, parts)).to_batches()

    return scored(pairs, path, model, lambda i: pairs.where(F.col("slice") == i).mapInArrow(ask, ROWS), model.pairs)


def scored(pairs: DataFrame, path: str, model: Model, asks: Callable[[int], DataFrame], trained: DataFrame | None = None) -> DataFrame:
    """As score. pairs: those of the texts, dropped on the way; asks: the words that a slice's parts ask for; trained: those of the training, if they are others."""
    spark, samples, deal = pairs.sparkSession, model.samples, model.deal
    room_hot, _, seated_hot = model.hot
    words_in_all, hot = model.n + model.v + 1, deal.hot

    def run(table: pa.Table) -> pa.Table:
        u, w, c, blobs = part_of(table)
        if not blobs:
            return rows_of([])
        rooms, of = np.unique(u, return_inverse=True)
        words, at = np.unique(w, return_inverse=True)
        room, n1 = summed(of, c, len(rooms)), summed(of, c == 1, len(rooms))
        i, there = found_at(hot, rooms)
        room[there] = room_hot[i]
        many = np.flatnonzero(c > 1)
        tables = [np.zeros(0, np.int64)] * len(samples)
        for k, _, of_k, word, _, t, before in unpacked(table, MORE):
            tables, k = [*before, t], k[of_k]
            if not (np.array_equal(k, u[many]) and np.array_equal(word, w[many])):  # in another order
                a, b = np.lexsort((w[many], u[many])), np.lexsort((word, k))
                back = np.empty(len(a), np.int64)
                back[a] = b
                tables = [x[back] for x in tables]
        known, *xs = answered(table, words, 1 + 2 * len(samples))
        own = np.where(c > 0, 1 - DISCOUNT, 0.0)
        own[many] = c[many] - DISCOUNT * np.mean(tables, 0)
        parent = np.zeros(len(u))
        for t, s, x, y, h in zip(tables, samples, xs[::2], xs[1::2], seated_hot, strict=True):
            tk = n1 + summed(of[many], t, len(rooms))
            tk[there] = h[i]
            parent += ((STRENGTH + DISCOUNT * tk) / (room + STRENGTH))[of] * root_probability(x, y, s)[at]
        lm = np.log10(own / (room + STRENGTH)[of] + parent / len(samples))
        base = np.log10((known + 1) / words_in_all)[at]
        known = (known > 0)[at].astype(float)
        found = []
        for block, n, times, row, which in blobs:
            sums = [np.bincount(row, np.repeat(x[which], times), n) for x in (known, base, lm)]
            found.append((SUM, block, table.column("at")[0].as_py(), pack(small(np.rint(sums[0]).astype(np.int64)), *sums[1:])))
        return rows_of(found)

    def add(table: pa.Table) -> pa.Table:
        known, base, lm = (sum(x[1:], x[0].astype(y)) for x, y in zip(zip(*unpacked(table), strict=True), (np.int64, float, float), strict=True))
        return pa.table({"block": table.column("at")[:1], "known": pa.array([known], pa.list_(pa.int64())), "base": pa.array([base], pa.list_(pa.float64())), "lm": pa.array([lm], pa.list_(pa.float64()))})

    def documents(table: pa.Table) -> pa.Table:
        sums = table.filter(table.column("data").is_null())
        ((ids, valid, size),) = (pickle.loads(x.as_buffer()) for x in table.column("data").drop_null())
        known, base, lm = (sum(np.asarray(sums.column(x)[i].values) for i in range(len(sums))) for x in ("known", "base", "lm"))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~valid), "n_tokens": size, "n_known": known, "base_score": base, "score": lm})

    more, dishes, parts = of_kind(model.state, MORE), of_kind(model.state, DISH), []
    for i in range(min(SLICES, deal.parts)):
        asked = [as_rows(pairs.where(F.col("slice") == i))] + ([as_rows(trained.where(F.col("slice") == i), COUNTED)] if trained is not None else [])
        found = grouped(run, *asked, more.where(F.pmod("p", F.lit(SLICES)) == i), answers(asks(i), dishes, True))
        added = found.groupBy("at").applyInArrow(add, "block long, known array<long>, base array<double>, lm array<double>")
        parts.append(written_in_slices(added.withColumn("slice", F.lit(i)), "scores")[0].drop("slice"))
        drop_folder(spark, f"{path}/slice={i}")
        release(spark)
    whole = pairs.where("slice = -1").select("block", "data", *[F.lit(None).cast(x).alias(y) for x, y in (("array<long>", "known"), ("array<double>", "base"), ("array<double>", "lm"))])
    for part in parts:
        whole = whole.unionByName(part.withColumn("data", F.lit(None).cast("binary")))
    return whole.groupBy("block").applyInArrow(documents, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from all but the held-out documents, and score every one; the pairs of both are made once."""
    docs = docs.select("doc_id", "text").withColumn("counted", remainder("doc_id", 7) != 2)
    deal = Deal(docs)
    pairs, path = pairs_of(docs, deal, "pairs")
    model = fitted(docs, deal, pairs, path)
    return scored(pairs, path, model, lambda i: model.asks.where(F.pmod("p", F.lit(SLICES)) == i)).withColumn("held_out", remainder("doc_id", 7) == 2).withColumn("train_tokens", F.lit(model.n).cast("long"))
