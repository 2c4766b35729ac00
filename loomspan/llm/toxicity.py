"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the characters of words share one
lower-order model: absolute-discounted counts of a class at the highest order
back off to continuation counts pooled over both classes. What only the shared
counts know cancels between the classes, so rare expressions are neutral unless
a class has seen their beginning. A document is scored by its log-likelihood ratios,
normalised by length, through a logistic calibration: of the whole text, of the toxic-most
expression of 2, 4, 8 and 16 words each, and of the words that speak clearly for toxic.

* Counts come from all labelled rows that may be learned (crc32(doc_id) mod 5 in 1, 2,
  3), so what is gathered grows with the input; the calibration is fitted on a bounded
  sample (``max_calibration`` of each label) of the rows with 4. Rows with 0 are never read.
* Every n-gram counted is kept. Its statistics are Spark aggregations; workers get a sorted
  table of 64-bit hashes and ratios, 16 bytes an n-gram or context and nothing dropped. It
  grows with the distinct n-grams. Two n-grams share a hash once in 2^64 pairs.
* Labels that are null or contradict each other within a doc_id are not learned. With one
  label value only, scores are that share (0 if none). Empty and null texts score by the prior.
* Rows are scored one by one; repeated rows get equal scores, and an empty table stays empty.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, fold, held_out, map_rows, materialize, pick, temporary

ORDER = 5
WINDOWS = (2, 4, 8, 16)
N_FEATURES = 4 + len(WINDOWS)
DISCOUNT = 0.75
_EDGES = " .,;:!?'\"()[]{}-"


def core(word: str) -> str:
    """The expression scored: lower case, without punctuation at its ends, marked at both."""
    return f"^{word.lower().strip(_EDGES)}$"


def top_grams(word: str) -> Iterable[str]:
    """n-grams of the highest order a position allows: ORDER characters, or all from the word's start."""
    for i in range(2, len(word) + 1):
        yield word[max(0, i - ORDER) : i]


class Counting:
    """Word counts of a task, by label; emptied as (gram, ordinary, toxic) counts."""

    def __init__(self, most: int = 200_000):
        self.words: tuple[Counter, Counter] = (Counter(), Counter())
        self.most = most

    def add(self, text: str | None, label: int) -> bool:
        self.words[label].update((text or "").split())
        return len(self.words[0]) + len(self.words[1]) > self.most

    def flush(self) -> list[tuple[str, int, int]]:
        grams: dict[str, list[int]] = {}
        for label, words in enumerate(self.words):
            for w, n in words.items():
                for g in top_grams(core(w)):
                    grams.setdefault(g, [0, 0])[label] += n
            words.clear()
        return [(g, a, b) for g, (a, b) in grams.items()]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic) counted over ``rows`` (text, label), summed within tasks first."""
    import pyarrow as pa

    schema = pa.schema([("gram", pa.string()), ("ordinary", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        counting = Counting()
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                if counting.add(text.as_py(), label.as_py()) and (got := counting.flush()):
                    yield out(got)
        if got := counting.flush():
            yield out(got)

    parts = rows.select("text", "label").mapInArrow(run, "gram string, ordinary long, toxic long")
    return parts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def statistics(counts: DataFrame) -> DataFrame:
    """(kind, text, ratio) of every n-gram ('gram') and context ('context') in ``counts`` (gram, ordinary, toxic)."""
    joint = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.substring("gram", k, F.length("gram")))).alias("g")).distinct()
    joint = materialize(joint, "toxic-suffixes")
    size = joint.agg(F.count_distinct(F.right("g", F.lit(1)))).first()[0] + 1
    below = joint.where(F.length("g") > 1).groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("n"))
    below = below.select("g", "n", F.expr("left(g, length(g) - 1)").alias("h"))
    around = below.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    lower = materialize(below.join(around, "h"), "toxic-continuations")
    mixed = lambda under: (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * under) / F.col("total")
    shared = level = lower.where(F.length("g") == 1).select("g", mixed(F.lit(1 / size)).alias("low"))
    for k in range(2, ORDER):
        under = level.select(F.col("g").alias("tail"), F.col("low").alias("under"))
        own = lower.where(F.length("g") == k).withColumn("tail", F.expr("substring(g, 2)"))
        level = materialize(own.join(under, "tail").select("g", mixed(F.col("under")).alias("low")), "toxic-shared")
        shared = shared.unionByName(level)

    split = counts.select("gram", "ordinary", "toxic", F.expr("left(gram, length(gram) - 1)").alias("context"), F.expr("substring(gram, 2)").alias("g"))
    sums = split.groupBy("context").agg(F.sum("ordinary").alias("n0"), F.sum("toxic").alias("n1"), F.count_if(F.col("ordinary") > 0).alias("k0"), F.count_if(F.col("toxic") > 0).alias("k1"))
    weight = lambda v: F.when(F.col(f"n{v}") > 0, DISCOUNT * F.col(f"k{v}") / F.col(f"n{v}")).otherwise(1.0)
    sums = materialize(sums.withColumn("w0", weight(0)).withColumn("w1", weight(1)), "toxic-contexts")

    def seen(column: str, v: int):
        own = F.greatest(F.col(column) - DISCOUNT, F.lit(0.0)) / F.col(f"n{v}") + F.col(f"w{v}") * F.col("low")
        return F.greatest(F.when(F.col(f"n{v}") > 0, own).otherwise(F.col("low")), F.lit(1e-12))

    grams = split.join(sums, "context").join(shared, "g").select(F.lit("gram").alias("kind"), F.col("gram").alias("text"), F.log(seen("toxic", 1) / seen("ordinary", 0)).alias("ratio"))
    return grams.unionByName(sums.select(F.lit("context").alias("kind"), F.col("context").alias("text"), F.log(F.col("w1") / F.col("w0")).alias("ratio")))


class Ratios:
    """text -> ratio as two sorted arrays: hashes and values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, text: str) -> float | None:
        h = np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)
        at = self.keys.searchsorted(h)
        return float(self.values[at]) if at < len(self.keys) and self.keys[at] == h else None


class ToxicityModel:
    """Log-likelihood ratios by n-gram and by context, and the calibration."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        """From counts that fit the driver; :meth:`gathered` makes the same of a table."""
        joint: dict[str, int] = {}
        for g in counts:
            for k in range(len(g)):  # distinct left extensions, order by order
                joint.setdefault(g[k:], 0)
        continuation: Counter = Counter()
        for g in joint:
            if len(g) > 1:
                continuation[g[1:]] += 1
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, n in continuation.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        size = len({g[-1] for g in joint}) + 1
        memo: dict[str, float] = {}

        def shared(g: str) -> float:
            if not g:
                return 1 / size
            if g not in memo:
                h, below = g[:-1], (shared(g[1:]) if len(g) > 1 else 1 / size)
                memo[g] = (max(continuation[g] - DISCOUNT, 0) + DISCOUNT * kinds[h] * below) / total[h] if total[h] else below
            return memo[g]

        sums: dict[str, list] = defaultdict(lambda: [0, 0, 0, 0])
        for g, (a, b) in counts.items():
            s = sums[g[:-1]]
            s[0] += a
            s[1] += b
            s[2] += a > 0
            s[3] += b > 0
        weight = lambda n, kinds: DISCOUNT * kinds / n if n else 1.0
        context = {h: math.log(weight(s[1], s[3]) / weight(s[0], s[2])) for h, s in sums.items() if s[0] + s[1]}
        gram = {}
        for g, (a, b) in counts.items():
            s, low = sums[g[:-1]], shared(g[1:])
            p = [max(n - DISCOUNT, 0) / of + weight(of, k) * low if of else low for n, of, k in ((a, s[0], s[2]), (b, s[1], s[3]))]
            gram[g] = math.log(max(p[1], 1e-12) / max(p[0], 1e-12))
        hashed = lambda of: np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in of], dtype=np.uint64).view(np.int64)
        self._hold(*(Ratios(hashed(x), np.array(list(x.values()), dtype=np.float64)) for x in (gram, context)))

    def _hold(self, gram: Ratios, context: Ratios) -> None:
        self.gram, self.context, self.calibration = gram, context, np.zeros(N_FEATURES)

    @classmethod
    def gathered(cls, counts: DataFrame) -> ToxicityModel:
        made = materialize(statistics(counts).select("kind", F.xxhash64("text").alias("key"), "ratio"), "toxic-model")
        parts = []
        for kind in ("gram", "context"):
            got = made.where(F.col("kind") == kind).select("key", "ratio").toArrow()
            parts.append(Ratios(got.column("key").to_numpy(), got.column("ratio").to_numpy()))
        model = cls.__new__(cls)
        model._hold(*parts)
        return model

    def value(self, gram: str) -> float:
        """The ratio of an n-gram, or of its context if it was never seen, or 0."""
        x = self.gram.find(gram)
        return (self.context.find(gram[:-1]) or 0.0) if x is None else x

    def ratio(self, raw: bytes, value: Callable[[str], float] | None = None) -> float:
        """Toxic over ordinary log-likelihood of one word, given that there is a word."""
        return sum(map(value or self.value, top_grams(core(raw.decode()))), 0.0)

    def words(self) -> WordCache:
        """word -> ratio. Each n-gram met is looked up once while it is cached."""
        grams = WordCache(self.value, 500_000)
        return WordCache(lambda raw: self.ratio(raw, grams.__getitem__), 300_000)

    def features(self, text: str | None, cache: WordCache) -> np.ndarray:
        """Length-normalised ratios: by words, by the root of words, of the words that speak for toxic, and of the best expression of each length."""
        words = (text or "").encode().split()
        if not words:
            return np.eye(1, N_FEATURES)[0]
        r = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        n = len(words)
        strong = np.clip(r - 2.0, 0, 6).sum()
        sums = np.append(0.0, np.cumsum(r))
        best = [np.clip((sums[k:] - sums[:-k]).max() / k if n > k else sums[-1] / n, -5, 8) for k in WINDOWS]
        return np.array([1.0, np.clip(10 * sums[-1] / n, -5, 5), np.clip(sums[-1] / math.sqrt(n), -10, 10), min(strong / math.sqrt(n) * 4, 10.0), *best])

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + math.exp(-float(np.clip(features @ self.calibration, -30, 30))))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighted alike."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge / 100 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge / 100 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, max_calibration: int = 2000) -> ToxicityModel | float:
    rows = pick(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    clean = rows.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("__high")).where("label = __high").select("doc_id", "label")
    texts = pick(docs, "doc_id", "text")
    # Labels grow with the documents, so both sides are dealt by id at every size.
    with temporary():  # the model holds what it needs of these tables
        counts = materialize(gram_counts(texts.hint("merge").join(clean.where(fold(F.col("doc_id")) != 4), "doc_id")), "toxic-grams")
        model = ToxicityModel.gathered(counts)
    parts = [clean.where((fold(F.col("doc_id")) == 4) & (F.col("label") == v)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_calibration) for v in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        cache = shared.value.words()
        return lambda doc_id, text, label: [(doc_id, label, shared.value.features(text, cache).tolist())]

    sample = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("doc_id", "text", "label")
    seen = sorted({(r["doc_id"], tuple(r["x"])): r["label"] for r in map_rows(sample, "doc_id long, label int, x array<double>", make, 3).collect()}.items())
    y = np.array([v for _, v in seen], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    model.calibration = calibrate(np.array([x for (_, x), _ in seen]), y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes an n-gram or context

    def make():
        m = shared.value
        if isinstance(m, float):
            return lambda doc_id, text: [(doc_id, m)]
        cache = m.words()
        return lambda doc_id, text: [(doc_id, m.score(m.features(text, cache)))]

    return map_rows(pick(docs, "doc_id", "text"), "doc_id long, score double", make, 2)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    scored = score_toxicity(docs, train(docs, labels, **bounds))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
