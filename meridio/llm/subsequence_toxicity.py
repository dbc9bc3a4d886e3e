"""Toxicity: a gap-weighted subsequence-kernel SVM on Nyström landmarks.

A sentence is a set of spans: its words without outer punctuation, and runs of single characters
taken together ("i d i o t"). The kernel of two spans is drawn from their common subsequences of three
characters, weighted down by the gaps in them and enumerated (spans are short), so inserted or missing characters lower it little.
Labels say which documents are toxic, not which span; the machine is trained by multiple-instance
rounds: a clean text gives only negative spans, a toxic one has a witness, the span of highest margin.
A text's score is that of its highest span.

Defined results: a null or empty text scores as one span of no kernel value at all (near 0); texts
are read whole; repeated rows score alike; empty tables give no rows; without labels of both classes
every score is 0. Spans over WIDTH characters are cut into overlapping windows, none is left out; of a
run of single characters, every stretch that may be a word is a span too. All columns of the input come
back as they are: where one is named score, the result's column is score_.
"""

from __future__ import annotations

import re
import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.llm.common import fitted_apart, free_name, small_batches, train_rows

WIDTH = 14
DECAY = 0.85
#: Sharpness of the kernel in the count of common subsequences, and the count under which it is 0.
SHARP, FLOOR = 4.0, 0.35
TURNS = 3
#: Log odds from which a span is taken as a witness: in four toxic texts and no clean one, or as good.
SURE = float(np.log(8))
#: Of the cost, the share of clean spans that resemble a landmark; toxic ones have half, the other clean ones the rest.
NEAR_SHARE = 0.45
#: Labelled documents of each class that training may read, and landmarks.
SAMPLE_PER_CLASS, LANDMARKS = 1200, 96
#: Lengths of the words that are looked for in a run of single characters; RUN_MARK begins such a run.
SPELLED, RUN_MARK = range(3, 11), "\x01"
#: Spans whose kernel sums are taken at a time: their lists stay in a core's cache.
STEP = 256
#: A worker's memory of span scores is emptied beyond this many entries.
MEMO = 1_000_000
#: Characters of a run that are scored at a time; windows of WIDTH fall on the same places.
RUN_PIECE = WIDTH // 2 * 1024
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RUN = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_INNER = re.compile(r"[\W_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def windows(token: str) -> list[str]:
    """A token without outer punctuation, between marks of its ends; long ones as overlapping windows; with inner
    punctuation, also without it."""
    if token.startswith(RUN_MARK):
        run = token[1:]
        return [*cut(run), *{f"^{run[i : i + n]}$" for n in SPELLED for i in range(len(run) - n + 1)}]
    if token.isalnum():
        return cut(token)
    bare = _OUTER.sub("", token)
    inner = _INNER.sub("", bare)
    if inner != bare:
        return [*cut(bare), *cut(inner)]
    return cut(bare)


def cut(bare: str) -> list[str]:
    core = f"^{bare}$"
    if len(core) < 5:
        return []
    if len(core) <= WIDTH:
        return [core]
    return [core[i : i + WIDTH] for i in range(0, len(core) - WIDTH // 2, WIDTH // 2)]


def tokens(text: str | None) -> set[str]:
    low = (text or "").lower()
    words = low.split()
    found = {w.strip(PUNCTUATION) for w in set(words)}
    if list(map(len, words)).count(1) > 2:  # a run has three such words
        found.update(RUN_MARK + re.sub(r"\s", "", r) for r in RUN.findall(low))
    return found


_places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def places(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every three increasing places in a span of this length (WIDTH at most), DECAY to the width they take, every two places, and which of these each three begin with."""
    if length not in _places:
        at = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
        two = list(combinations(range(length), 2))
        nth = {x: i for i, x in enumerate(two)}
        pair = np.array([nth[i, j] for i, j, _ in at.tolist()], np.int64)
        _places[length] = at, DECAY ** (at[:, 2] - at[:, 0] + 1.0) if len(at) else np.zeros(0), np.array(two, np.int64).reshape(-1, 2), pair
    return _places[length]


def characters(spans: list[str]) -> np.ndarray:
    """Code points of spans of one length, one row each."""
    return np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(spans), -1).astype(np.int64)


def keys(x: np.ndarray) -> np.ndarray:
    """One exact integer for each subsequence of three characters."""
    at = places(x.shape[1])[0]
    return (x[:, at[:, 0]] << 42) | (x[:, at[:, 1]] << 21) | x[:, at[:, 2]]


def gathered(k: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subsequences of one span and the sums of their weights."""
    got, where = np.unique(k, return_inverse=True)
    return got, np.bincount(where, weight)


def norms(k: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each row's norm, repeated subsequences summed first."""
    order = np.argsort(k, 1, kind="stable")
    s = np.take_along_axis(k, order, 1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
    return np.sqrt(np.bincount(np.nonzero(new)[0], sums * sums, len(k)))


class Machine:
    """coefficients of normalised kernels with the landmarks, a bias, and a logistic scale."""

    def __init__(self, landmarks: list[str], weight: np.ndarray, bias: float, scale: float, shift: float):
        self.landmarks, self.weight, self.bias, self.scale, self.shift = landmarks, weight, bias, scale, shift

    def prepare(self):
        """The landmarks' subsequences as one sorted list, with a column of weights for each landmark."""
        found = [gathered(keys(characters([x]))[0], places(len(x))[1]) for x in self.landmarks]
        k = np.concatenate([f[0] for f in found])
        order = np.argsort(k, kind="stable")
        every, self.first, self.often = np.unique(k[order], return_index=True, return_counts=True)
        self.whose = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[order]
        self.share = np.concatenate([w / np.sqrt(w @ w) for _, w in found])[order]
        # tables from characters to the landmarks' characters, from two of these to a pair, from a pair and a third to a subsequence
        three = np.stack([every >> 42, every >> 21 & (1 << 21) - 1, every & (1 << 21) - 1])
        known = np.unique(three)
        self.code = np.zeros(0x110000, np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        self.size = len(known) + 1
        c = self.code[three].astype(np.int64)
        pairs, of = np.unique(c[0] * self.size + c[1], return_inverse=True)
        self.pairs = np.zeros(self.size**2, np.int32)
        self.pairs[pairs] = np.arange(1, len(pairs) + 1)
        self.thirds = np.full((len(pairs) + 1) * self.size, -1, np.int32)
        self.thirds[(of + 1) * self.size + c[2]] = np.arange(len(every))
        return self

    def features(self, spans: list[str]) -> np.ndarray:
        """Kernel of each span with each landmark: exp(SHARP * (normalised count - 1)), 0 for counts under FLOOR."""
        out = np.zeros((len(spans), len(self.landmarks)), np.float32)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(spans):
            by.setdefault(len(x), []).append(i)
        for length, of in by.items():
            at, weight, two, pair = places(length)
            least = np.sqrt(weight @ weight)  # of the span's norm; repeated subsequences only add to it
            for start in range(0, len(of), STEP):
                part = np.array(of[start : start + STEP])
                x = characters([spans[i] for i in part])
                code = self.code[x]
                begun = self.pairs[code[:, two[:, 0]] * self.size + code[:, two[:, 1]]] * self.size
                found = self.thirds[begun[:, pair] + code[:, at[:, 2]]].ravel()
                at_hit = np.flatnonzero(found >= 0)
                if not len(at_hit):
                    continue
                place = found[at_hit]
                row, col = np.divmod(at_hit, len(pair))
                new = np.r_[True, row[1:] != row[:-1]]
                some, at_row = row[new], np.cumsum(new) - 1
                times = self.often[place]
                ends = np.cumsum(times)
                each = np.arange(ends[-1]) + np.repeat(self.first[place] - ends + times, times)
                cell = self.whose[each] + np.repeat(at_row * len(self.landmarks), times)
                raw = np.bincount(cell, self.share[each] * np.repeat(weight[col], times), len(some) * len(self.landmarks)).reshape(len(some), -1)
                high = raw.max(1) >= FLOOR * least
                if high.any():
                    near = raw[high] / norms(keys(x[some[high]]), weight)[:, None]
                    out[part[some[high]]] = np.where(near >= FLOOR, np.exp(SHARP * (near - 1)), 0)
        return out

    def margins(self, spans: list[str]) -> np.ndarray:
        if not spans or not len(self.weight):
            return np.full(len(spans), -10.0)
        return self.features(spans) @ self.weight + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -60, 60))))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = cost / cost.sum()
    lip = 2 * np.linalg.norm((z * weight[:, None]).T @ z, 2) + 1e-5
    w = v = np.zeros(z.shape[1])
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (z @ v))
        grad = -2 * z.T @ (weight * y * gap) + 1e-5 * v
        new = v - grad / lip
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(bags: list[tuple[set[str], int]]) -> Machine:
    """bags: the windows of a labelled text, and its label."""
    good, bad = [b for b, y in bags if y == 0], [b for b, y in bags if y == 1 and b]
    if not good or not bad:
        return Machine([], np.zeros(0), -10.0, 1.0, -50.0)
    clean: dict[str, int] = {}
    for b in good:
        for s in b:
            clean[s] = clean.get(s, 0) + 1
    seen: dict[str, int] = {}
    for b in bad:
        for s in b:
            seen[s] = seen.get(s, 0) + 1
    odds = {s: np.log((n + 0.5) / (clean.get(s, 0) + 0.5)) for s, n in seen.items()}
    witness = [max(sorted(b), key=lambda s: odds[s]) for b in bad]
    negatives = sorted(clean)
    machine, margin = Machine([], np.zeros(0), 0.0, 1.0, 0.0), {}
    for _ in range(TURNS):
        count: dict[str, int] = {}
        for s in witness:
            # a rare span of a wrongly labelled text says nothing, unless it resembles what is known
            if odds[s] >= SURE or margin.get(s, -1) > 0:
                count[s] = count.get(s, 0) + 1
        if not count:
            count = {s: 1 for s in witness}
        machine.landmarks = sorted(count, key=lambda s: (-count[s], s))[: LANDMARKS * 3 // 4]
        machine.prepare()
        pos = sorted(count)
        near = machine.features(negatives).max(1)
        machine.landmarks += [negatives[i] for i in np.argsort(-near, kind="stable")[: LANDMARKS - len(machine.landmarks)]]
        machine.prepare()
        # spans with no kernel value at all are equal rows: they count as one
        of = machine.features(negatives)
        some = np.flatnonzero(of.any(1))
        x = np.vstack([machine.features(pos), of[some], np.zeros((1, of.shape[1]), np.float32)])
        # Nyström: the landmarks' kernel, whitened
        gram = machine.features(machine.landmarks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
        y = np.r_[np.ones(len(pos)), -np.ones(len(some) + 1)]
        cost = np.r_[[min(count[s], 5) for s in pos], [min(clean[negatives[i]], 5) for i in some], 0].astype(float)
        cost[: len(pos)] *= 0.5 / cost[: len(pos)].sum()
        cost[len(pos) :] *= NEAR_SHARE / max(cost[len(pos) :].sum(), 1e-9)
        cost[-1] = 0.5 - NEAR_SHARE
        w, machine.bias = linear_svm(x @ whiten, y, cost)
        machine.weight = whiten @ w
        # a witness of better margin replaces one whose odds said little
        weak = [i for i, s in enumerate(witness) if odds[s] < SURE]
        pool = sorted(set().union(*[bad[i] for i in weak])) if weak else []
        margin = dict(zip(pool, machine.margins(pool), strict=True))
        for i in weak:
            witness[i] = max(sorted(bad[i]), key=lambda s: (margin[s], odds[s]))
    # the threshold: what best parts the texts of the sample by their highest span
    spans = sorted(set(clean) | set(seen))
    margin = dict(zip(spans, machine.margins(spans), strict=True))
    top = np.array([max((margin[s] for s in b), default=machine.bias) for b in good + bad])
    toxic = np.r_[np.zeros(len(good)), np.ones(len(bad))]
    order = np.argsort(top, kind="stable")
    # errors if all from place i on are called toxic; a clean text lost counts double
    errors = np.r_[2 * len(good), 2 * len(good) - np.cumsum(2 * (toxic[order] == 0))] + np.r_[0, np.cumsum(toxic[order] == 1)]
    best = np.flatnonzero(errors == errors.min())
    edge = np.r_[top[order][0] - 1, top[order], top[order][-1] + 1]
    i = best[len(best) // 2]
    # half way down the widest part of the gap between the highest clean texts and the next toxic one
    cut = edge[i] + 0.4 * (edge[i + 1] - edge[i])
    machine.scale = 8.0
    machine.shift = -machine.scale * float(cut)
    return machine


class Scorer:
    def __init__(self, machine: Machine):
        self.machine = machine.prepare() if machine.landmarks else machine
        self.memo: dict[str, float] = {}
        self.empty = machine.bias if len(machine.weight) else -10.0

    def __call__(self, texts: list[str | None]) -> list[float]:
        found = self.read(texts)
        return [self.machine.probability(max(map(self.memo.__getitem__, f), default=-10.0)) for f in found]

    def memo_of(self, text: str | None) -> list[float]:
        """The margins of a text's tokens."""
        return [self.memo[t] for f in self.read([text]) for t in f]

    def read(self, texts: list[str | None]) -> list[set[str]]:
        """The tokens of each text, their highest margins now in the memory."""
        found = [tokens(t) for t in texts]
        new = sorted(set().union(*found) - self.memo.keys()) if found else []
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = sorted(set().union(*found))
        short = [t for t in new if len(t) <= RUN_PIECE or not t.startswith(RUN_MARK)]
        spans = [windows(t) for t in short]
        flat = sorted({s for x in spans for s in x})
        margin = dict(zip(flat, self.machine.margins(flat), strict=True))
        for t, x in zip(short, spans, strict=True):
            self.memo[t] = max((margin[s] for s in x), default=-10.0)
        for t in set(new) - set(short):
            self.memo[t] = self.of_run(t)
        return found

    def of_run(self, token: str) -> float:
        """The highest margin of a run, a piece at a time: its stretches are many times its length."""
        run, best, widest = token[1:], -10.0, max(max(SPELLED), WIDTH)
        for at in range(0, len(run), RUN_PIECE):
            # stretches that a cut parts are in the overlap
            part = sorted(set(windows(RUN_MARK + run[at : at + RUN_PIECE + widest])))
            best = max([best, *self.machine.margins(part)])
        return best


_scorers: dict[str, Scorer] = {}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit on at most per_class labelled documents of each class, the first by a hash of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train_rows("doc_id", 5, 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    picked = []
    for y in (0, 1):
        picked += known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(per_class).collect()
    rows = spark.createDataFrame(picked, "doc_id long, y int")  # 2 * per_class rows at most

    def spans(batches):
        for batch in batches:
            yield batch[["doc_id", "y"]].assign(spans=["\n".join(sorted({w for t in tokens(x) for w in windows(t)})) for x in batch["text"]])

    got = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").mapInPandas(spans, "doc_id long, y int, spans string")

    def fitted(found):
        machine = fit([(set(spans.split("\n")) - {""}, y) for _, spans, y in found])
        return machine.landmarks, machine.weight, machine.bias, machine.scale, machine.shift

    return Machine(*fitted_apart(got, fitted, "doc_id", "spans", "y"))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with a column score (0 to 1, higher: toxic likelier), from the text alone."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((machine.landmarks, machine.weight, machine.bias, machine.scale, machine.shift))
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(Machine(*held.value))
        return pd.Series(_scorers[key](texts.tolist()), dtype="float64")

    return docs.withColumn(free_name(docs.columns, "score"), scored(F.col("text")))
