"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
(character-class shares, word shapes, repetition; then a learned tanh layer), gated
attention weighs the passages, and the weighted representation gives the score.
Weights are learned from document labels alone.

* Training rows: labelled documents whose crc32(doc_id) mod 5 is not 0, at most
  ``max_train`` of each label, chosen by hash of the id: a documented bound, so that the
  chosen ids are broadcast and every task keeps only their passages. Of an id with several
  texts the smallest is learned.
* Whole texts are scored: all passages count. An empty or null text is one empty passage.
* Labels that are null or contradict each other within a doc_id are not learned. With
  labels of one value only (or none) every score is that share (0.5 if none).
* Rows are scored one by one; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Whole, WordCache, held_out, map_batches, map_rows, pick

PASSAGE = 64
_PUNCT = set(".,;:!?'\"()-")
_SYMBOL = set("#*$%&|<>@^~=+_/\\{}[]`")
N_WORD, N_FEATURES = 12, 17


def word_shape(word: str) -> tuple:
    n = len(word)
    upper = sum(c.isupper() for c in word)
    lower = sum(c.islower() for c in word)
    digit = sum(c.isdigit() for c in word)
    punct = sum(c in _PUNCT for c in word)
    symbol = sum(c in _SYMBOL for c in word)
    bang = word.count("!") + word.count("?")
    return (n, upper, lower, digit, punct, symbol, n - upper - lower - digit - punct - symbol, bang,
            float(n > 1 and upper > 1 and not lower), float(symbol == n), float(n <= 3 and lower == n), float(n > 14))


class Passages:
    """text -> float32 matrix, a row of features per passage."""

    def __init__(self, limit: int = 400_000):
        self.table = np.zeros((1024, N_WORD), dtype=np.float32)
        self.words = WordCache(self._add, limit)
        self.limit = limit
        self.used = 0

    def _add(self, word: bytes) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = word_shape(word.decode())
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        if not words:
            return np.zeros((1, N_FEATURES), dtype=np.float32)
        if len(self.words) + len(words) > self.limit:  # between documents, so that ids agree within one
            self.words.clear()
            self.used = 0
        if len(words) > self.words.limit:
            self.words.limit = len(words) + 1
        ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        starts = np.arange(0, len(ids), PASSAGE)
        n = np.diff(np.append(starts, len(ids))).astype(np.float32)
        sums = np.add.reduceat(self.table[ids], starts, axis=0)
        chars = np.maximum(sums[:, 0], 1)
        first = np.zeros(len(ids), dtype=np.float32)
        first[np.unique(ids, return_index=True)[1]] = 1
        same = np.append(False, ids[1:] == ids[:-1]).astype(np.float32)
        where = np.arange(len(ids)) // PASSAGE
        distinct = np.bincount(np.unique(where * (ids.max() + 1) + ids) // (ids.max() + 1), minlength=len(starts))
        share = lambda x: np.add.reduceat(x, starts) / n
        return np.column_stack([
            sums[:, 0] / n / 10, sums[:, 1:8] / chars[:, None], sums[:, 8:] / n[:, None],
            share(first), share(same), distinct / n, np.log1p(n) / 5, np.full(len(n), np.log1p(len(ids)) / 10, dtype=np.float32),
        ]).astype(np.float32)


@dataclass
class MilModel:
    """Encoder W, attention V (tanh) and U (gate) with mixing w, classifier c; all small arrays."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator, hidden: int = 16, attention: int = 8) -> MilModel:
        g = lambda *s: rng.normal(0, 0.3, s)
        return cls({"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "W": g(N_FEATURES, hidden), "b": np.zeros(hidden), "V": g(hidden, attention),
                    "U": g(hidden, attention), "w": g(attention), "c": g(hidden), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        z = np.clip((x - p["mean"]) * p["scale"], -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        n = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        m = np.add.reduceat(h * a[:, None], starts)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "y": y, "n": n}

    def gradients(self, s: dict, starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        dy = (s["y"] - target) * weight / weight.sum()
        out = {"c": s["m"].T @ dy, "d": np.array([dy.sum()])}
        dm = np.repeat(dy[:, None] * p["c"], s["n"], axis=0)
        da = (dm * s["h"]).sum(1)
        de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, starts), s["n"]))
        out["w"] = (s["t"] * s["g"]).T @ de
        dt = de[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2)
        dg = de[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
        out["V"], out["U"] = s["h"].T @ dt, s["h"].T @ dg
        dh = (dm * s["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - s["h"] ** 2)
        out["W"], out["b"] = s["z"].T @ dh, dh.sum(0)
        return out

    def score(self, x: np.ndarray) -> float:
        return float(self.forward(x, np.array([0]))["y"][0])


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, seed: int = 7) -> MilModel:
    """Adam on balanced log loss, in minibatches of documents; fixed seed and order."""
    rng = np.random.default_rng(seed)
    model = MilModel.new(rng)
    every = np.concatenate(bags).astype(np.float64)
    model.p["mean"] = every.mean(0)
    model.p["scale"] = 1 / np.maximum(every.std(0), 1e-3)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            starts = np.cumsum([0, *(len(bags[i]) for i in chosen[:-1])])
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            grads = model.gradients(model.forward(x, starts), starts, labels[chosen], weights[chosen])
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[k] = model.p[k] - rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-3 * model.p[k] * (k in "WVUc"))
    return model


def training_labels(labels: DataFrame, column: str, max_each: int) -> DataFrame:
    """(doc_id, label): rows whose labels may be learned, at most ``max_each`` of each label, by hash of the id."""
    rows = pick(labels, "doc_id", column).where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    clean = rows.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("__high")).where("label = __high").select("doc_id", "label")
    parts = [clean.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_each) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 3000) -> MilModel | float:
    chosen = training_labels(labels, "quality", max_train)  # at most 2 * max_train rows: their size is bounded by the parameter
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        encode = Passages()
        return lambda doc_id, text, label: [(doc_id, label, encode(text).tobytes())]

    texts = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # of a repeated id one text, so the bound is one of rows too
    got = map_rows(texts.select("doc_id", "text", "label"), "doc_id long, label int, bag binary", make, 3).collect()
    got = sorted({(r["doc_id"], bytes(r["bag"])): r["label"] for r in got}.items())
    y = np.array([label for _, label in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(bag, dtype=np.float32).reshape(-1, N_FEATURES) for (_, bag), _ in got], y)


def score_quality(docs: DataFrame, model: MilModel | float) -> DataFrame:
    """doc_id, score for every row."""

    def make():
        if isinstance(model, float):
            return lambda doc_id, text: [(doc_id, model)]
        encode = Passages()
        return lambda doc_id, text: [(doc_id, model.score(encode(text)))]

    return map_rows(pick(docs, "doc_id", "text"), "doc_id long, score double", make, 2)


def quality_classifier(docs: DataFrame, labels: DataFrame, max_train: int = 3000, threshold: float = 0.3) -> DataFrame:
    scored = score_quality(docs, train(docs, labels, max_train))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = 3000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``. The model is trained on what ``docs`` holds of the labelled rows.

    A null text scores as an empty one, repeated rows stay or go together, an empty table stays
    empty, and columns may have any names beside doc_id and text.
    """
    import pyarrow as pa

    model = train(docs, labels, max_train)
    whole = Whole(docs, "text")
    text = whole.at["text"]

    def make():
        encode = Passages()
        score = (lambda text: model) if isinstance(model, float) else (lambda text: model.score(encode(text)))
        return lambda batch: batch.filter(pa.array([score(t) >= threshold for t in batch.column(text).to_pylist()], type=pa.bool_()))

    return whole.back(map_batches(whole.frame, make))
