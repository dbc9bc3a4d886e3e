"""Best-fit packing of token sequences under several capacities at once.

A bin (sequence) has room for tokens, documents and attention cost (the sum of squared lengths).
A piece of n tokens takes (n, 1, n * n). Pieces differ only in length, so the packing is planned on
the counts of lengths, of which there are as many as a sequence has tokens whatever the input:
lengths are taken from the longest down, and all equal bins that best fit one, by weighted
dot-product or by the norm of what stays free, are filled at a time. The plan, a list of ranges,
then places each piece by its number among those of its length; the numbers come from exact counts
of groups of about GROUP pieces, so a length that a third of all pieces have is dealt to as many tasks
as it needs.

Defined results: a null text is an empty one, whose document is the end token alone; rows of equal
doc_id or of none are packed apart; texts are read whole; an empty table gives no rows; other columns
are left out. Ids go through Python as text, so that no long becomes a float beside a null.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridio.llm.common import small_batches, write_table

CAPACITY, END = 1024, 2
#: Pieces of one length that a task numbers, about.
GROUP = 100_000

PIECES = "doc_id string, piece int, start long, length int, ids binary, nth long"
#: What the faster library's pattern stands for; another pre-tokenizer is left to the file's own library.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False}


class Tokenizer:
    """The vocabulary of a byte-level BPE tokenizer file, run by the faster of the two public libraries.

    That one gives up on runs of about a million white-space characters; the file's own library takes such texts, and all
    texts if the file asks for anything but byte-level splitting.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        table = byte_table()
        ranks = {bytes(table[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in table for c in token)}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        for content in self.special:
            ranks.pop(content.encode(), None)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = set(self.special)
        self.path, self.own = path, None
        split = file.get("pre_tokenizer") or {}
        self.plain = file.get("normalizer") is None and all(split.get(k) == v for k, v in BYTE_LEVEL.items()) and split.get("use_regex", True)

    def __call__(self, text: str) -> list[int]:
        if not self.plain:
            return self.by_own_library(text)
        try:
            return self.encoding.encode(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:
            return self.by_own_library(text)

    def by_own_library(self, text: str) -> list[int]:
        if self.own is None:
            from tokenizers import Tokenizer as Own

            self.own = Own.from_file(self.path)
        return self.own.encode(text, add_special_tokens=False).ids


def byte_table() -> dict[str, int]:
    """The characters that stand for bytes in such files: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in shown):
        out[chr(256 + n)] = b
    return out


_tokenizers: dict[str, Tokenizer] = {}


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first takes what is over."""
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), nth (of its text in its task)."""
    small_batches(docs.sparkSession, 128)

    def run(batches):
        import pandas as pd

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer(path)
        encode, nth = _tokenizers[path], 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                nth += 1
                ids = np.array([*encode(text or ""), end], "<u4")
                rows += [(doc, i, s, n, ids[s : s + n].tobytes(), nth) for i, (s, n) in enumerate(cuts(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids", "nth"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PIECES)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity=(CAPACITY, CAPACITY, CAPACITY * CAPACITY), rule: str = "norm", weights=(1.0, 0.01, 0.01)):
    """Pack counts[length] pieces. Returns the number of bins and ranges (length, first, n, bin, offset).

    A range says that the pieces numbered first .. first + n - 1 of that length go to the bins from
    `bin` on, one each, at that offset. rule: "norm" takes the bins whose free room, weighted and as
    a share of the capacity, is smallest afterwards; "dot" those whose free room agrees most with the
    piece's needs by weighted dot-product.
    """
    cap, w = np.array(capacity, float), np.array(weights)
    free = np.zeros((0, 3))  # room of the bins of a group
    group: list[tuple[int, int]] = []  # first bin and number of bins of a group
    bins, out = 0, []
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1.0, float(length) * length])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        left, first = counts[length], 0
        while left:
            fits = np.flatnonzero((free >= need).all(1))
            if len(fits):
                room = free[fits] / cap
                if rule == "norm":
                    price = (w * (room - need / cap) ** 2).sum(1)
                else:
                    price = -(w * room * (need / cap)).sum(1)
                g = int(fits[np.lexsort((fits, price))[0]])
                start, n = group[g]
                used = min(n, left)
                out.append((length, first, used, start, int(cap[0] - free[g, 0])))
                if used < n:
                    group[g] = (start + used, n - used)
                    free = np.vstack([free, free[g] - need])
                    group.append((start, used))
                else:
                    free[g] = free[g] - need
            else:
                most = int((cap // need).min())  # pieces of this length that an empty bin holds
                used = min(left, max(1, left // most))
                out.append((length, first, used, bins, 0))
                free = np.vstack([free, cap - need])
                group.append((bins, used))
                bins += used
            first, left = first + used, left - used
        alive = np.flatnonzero((free > 0).all(1))
        free, group = free[alive], [group[i] for i in alive]
    return bins, out


def pack(pieces: DataFrame, length: str = "length", capacity=(CAPACITY, CAPACITY, CAPACITY * CAPACITY), rule: str = "norm", weights=(1.0, 0.01, 0.01)) -> DataFrame:
    """pieces without nth, with sequence_id and offset. pieces is read several times: give a written table."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy(length).agg(F.count("*").alias("n")).collect()  # as many rows at most as lengths
    groups_of = spark.createDataFrame([(r[0], 1 + r.n // GROUP) for r in sizes], f"{length} int, __groups long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "nth"), F.col("__groups"))
    salted = pieces.join(F.broadcast(groups_of), length).withColumn("__salt", salt).drop("__groups")
    # a row for each GROUP pieces and each length
    groups = {(r[0], r[1]): r.n for r in salted.groupBy(length, "__salt").agg(F.count("*").alias("n")).collect()}
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for n, salt in sorted(groups):
        before[n, salt] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + groups[n, salt]
    _, ranges = plan(counts, capacity, rule, weights)
    by_length: dict[int, tuple] = {}
    for n in counts:
        r = np.array([x[1:] for x in ranges if x[0] == n], np.int64)
        by_length[n] = r[np.argsort(r[:, 0])]
    held = spark.sparkContext.broadcast((by_length, before))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, salts, nth):
        import pandas as pd

        by_length, before = held.value
        n, k = lengths.to_numpy(), nth.to_numpy(np.int64) - 1 + np.array([before[x] for x in zip(lengths.tolist(), salts.tolist(), strict=True)], np.int64)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            at = np.flatnonzero(n == x)
            r = by_length[x]
            i = np.searchsorted(r[:, 0], k[at], "right") - 1
            seq[at], off[at] = r[i, 2] + k[at] - r[i, 0], r[i, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    number = Window.partitionBy(length, "__salt").orderBy("doc_id", "piece", "nth")
    placed = salted.withColumn("__nth", F.row_number().over(number)).withColumn("__place", place(F.col(length), "__salt", "__nth"))
    return placed.withColumn("sequence_id", F.col("__place.sequence_id")).withColumn("offset", F.col("__place.offset")).drop("__salt", "__nth", "__place", "nth")


def pack_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if kept, the ids themselves."""
    crc = F.crc32("ids").alias("ids_crc32")
    small_batches(docs.sparkSession, 128)
    cols = ["doc_id", "piece", "start", "length", crc, "nth", *(["ids"] if keep_ids else [])]
    pieces, _ = write_table(tokenised(docs, path).select(*cols), "pieces")
    return pack(pieces).withColumn("length", F.col("length").cast("long"))
