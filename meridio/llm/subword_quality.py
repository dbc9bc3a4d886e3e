"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax.

Vectors and output weights are learned together by stochastic gradient descent in numpy on a
bounded sample of labelled rows. Because the document vector is an average, its product with
the output weights is an average of one number per hashed feature; scoring looks that number up.

Defined results: a null or empty text scores the learned prior; texts of any length are read
whole, in pieces that carry on what their cuts part; repeated rows score alike; an empty table gives
no rows; with no labels of one class every score is the share of label 1 (0.5 without labels). All
columns of the input come back as they are: where one is named score, the result's column is score_.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.llm.common import fitted_apart, free_name, small_batches, train_rows

BITS = 16
SIZE = 1 << BITS
GRAMS = (3, 4)
DIM = 8
#: Rows of each class that training may use: the bound of what the driver gathers.
SAMPLE_PER_CLASS = 1200
#: Updates that training makes, whatever the sample's size.
UPDATES = 19_200
#: Bytes of a text that are read at a time.
PIECE = 1 << 20
_POW = np.cumprod(np.full(256, 16777619, np.uint32), dtype=np.uint32)
#: Weight of the feature kinds: characters, words, pairs of words, repetition patterns.
KINDS = (0.4, 0.25, 0.15, 0.2)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


class Reader:
    """Hashed features of a text, piece by piece: what a cut parts (n-grams, a word, neighbouring words) is carried on."""

    def __init__(self):
        self.tail = np.array([32], np.uint8)  # the last bytes, as many as the longest n-gram needs
        self.word, self.place = np.uint32(0), 0  # hash and length so far of the word that the piece ended in
        self.last = np.zeros(0, np.uint32)  # the last three words

    def read(self, piece: bytes) -> list[np.ndarray]:
        """Features that end in this piece, one array for each kind. The text ends with a space."""
        new = np.frombuffer(piece, np.uint8)
        b = np.concatenate([self.tail, new])
        space = (b == 32) | ((b >= 9) & (b <= 13))
        v = np.where(space, 32, b).astype(np.uint32)
        many = np.cumsum(space)
        chars = []
        for n in GRAMS:
            first = max(0, len(self.tail) - n + 1)  # n-grams before it ended in the piece before
            if len(v) - first < n:
                continue
            h = np.zeros(len(v) - n + 1 - first, np.uint32)
            for j in range(n):
                h = h * np.uint32(16777619) + v[first + j : len(v) - n + 1 + j]
            inside = many[first + n - 2 : len(v) - 1] == many[first : len(v) - n + 1]  # no space but at the ends
            chars.append(_mix(h[inside], n))
        words = self.words(v[len(self.tail) :], space[len(self.tail) :])
        self.tail = b[-(max(GRAMS) - 1) :]
        near = np.concatenate([self.last, words])
        old = len(self.last)
        pairs = near[max(0, old - 1) : -1] * np.uint32(40503) + near[max(0, old - 1) + 1 :]
        same = np.zeros(len(near), np.uint32)  # which of the last three words a word repeats
        for k in (3, 2, 1):
            same[k:][near[k:] == near[:-k]] = k
        self.last = near[-3:]
        return [np.concatenate(chars) if chars else np.zeros(0, np.int64), _mix(words, 101), _mix(pairs, 102), _mix(same[old:], 103)]

    def words(self, v: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Hashes of the words that end here."""
        ends = np.flatnonzero(space)
        starts = np.r_[0, ends + 1]  # of the stretches between spaces; the last goes on in the next piece
        place = np.arange(len(v)) - np.repeat(starts, np.diff(np.r_[starts, len(v)]))[: len(v)]
        place[: ends[0] if len(ends) else len(v)] += self.place
        sums = np.concatenate([[np.uint32(0)], np.cumsum(np.where(space, np.uint32(0), v * _POW[place & 255]), dtype=np.uint32)])
        each, sizes = sums[np.r_[ends, len(v)]] - sums[starts], np.r_[ends, len(v)] - starts
        each[:1] += self.word
        sizes[0] += self.place
        self.word, self.place = each[-1], int(sizes[-1])
        return each[:-1][sizes[:-1] > 0]


def features(text: str | None):
    """Features of a whole text, a piece at a time."""
    data, reader = (text or "").encode("utf-8", "replace") + b" ", Reader()
    for at in range(0, len(data), PIECE):
        yield reader.read(data[at : at + PIECE])


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of a whole text and their weights in its average."""
    sums, n = np.zeros((len(KINDS), SIZE), np.float32), np.zeros(len(KINDS))
    for piece in features(text):
        for k, ids in enumerate(piece):
            sums[k] += np.bincount(ids, minlength=SIZE)
            n[k] += len(ids)
    weight = (sums * (np.array(KINDS) / np.maximum(n, 1))[:, None]).sum(0)
    ids = np.flatnonzero(weight)
    return ids.astype(np.int32), weight[ids].astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float, updates: int = UPDATES, rate: float = 0.2, seed: int = 7):
    """Numpy SGD. rows: ids, weights, label. Returns the number of each feature, and the bias."""
    y = np.array([r[2] for r in rows])
    logit = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    if len(set(y.tolist())) < 2:
        return np.zeros(SIZE), float(np.clip((prior - 0.5) * 8, -4, 4))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (SIZE, DIM))
    out, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-updates // len(rows)))])[:updates]
    for done, i in enumerate(order):
        ids, weight, label = rows[i]
        lr = rate * (1 - done / updates)
        hidden = weight @ vectors[ids]
        z = hidden @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = out @ p
        out -= lr * np.outer(hidden, p)
        bias -= lr * 0.1 * p
        # a step as long for a text of many features as for one of few, shared by their weights
        vectors[ids] -= (lr * 0.5 * weight / (weight @ weight + 1e-3))[:, None] * back
    share = y.mean()
    table = vectors @ (out[:, 1] - out[:, 0])
    return table, float(bias[1] - bias[0] + logit - np.log(share / (1 - share)))


def score(text: str | None, table: np.ndarray, bias: float) -> float:
    sums, n = np.zeros(len(KINDS)), np.zeros(len(KINDS))
    for piece in features(text):
        for k, ids in enumerate(piece):
            sums[k] += table[ids].sum()
            n[k] += len(ids)
    z = float((np.array(KINDS) * sums / np.maximum(n, 1)).sum() + bias)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS):
    """Fit on at most per_class rows of each class, the first by a hash of doc_id; held-out rows are never read."""
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train_rows("doc_id", 5, 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = dict(known.groupBy("y").count().collect())
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = spark.createDataFrame(picked.collect(), "doc_id long, y int")  # 2 * per_class rows at most

    def featurise(batches):
        for batch in batches:
            got = [sparse(t) for t in batch["text"]]
            yield batch[["doc_id", "y"]].assign(ids=[g[0].tobytes() for g in got], weights=[g[1].tobytes() for g in got])

    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").mapInPandas(featurise, "doc_id long, y int, ids binary, weights binary")

    def fitted(found):
        return fit([(np.frombuffer(ids, np.int32), np.frombuffer(weights, np.float32), y) for _, ids, weights, y in found], prior)

    return fitted_apart(sample, fitted, "doc_id", "ids", "weights", "y")


def score_documents(docs: DataFrame, model) -> DataFrame:
    """docs with a column score (0 to 1, higher: label 1 likelier), from the text alone."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        table, bias = held.value
        return texts.map(lambda t: score(t, table, bias)).astype("float64")

    return docs.withColumn(free_name(docs.columns, "score"), scored(F.col("text")))
