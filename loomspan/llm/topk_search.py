"""Exact top-k inner products with a pivot table.

Pivots are vectors of the table itself, far from each other. Every row keeps its distances to
them, and lies in the cell of its nearest one. For a query the largest |d(q, p) - d(x, p)|
over the pivots bounds d(q, x) from below, and so q.x = (|q|^2 + |x|^2 - d^2) / 2 from above.

1. Each query is searched in a block of its own cell: candidates are evaluated in bound
   order until no bound reaches the k-th score (an exact stop). That score goes on.
2. A cell's ranges of distances bound all that it holds. The query is sent to the other blocks
   of those cells that can still reach its score, and stored rows to none but queried blocks;
   each block stops as before, from the score the query brought.

* Components are floor(scale * x), x as double; vectors that are null, or hold a null or a
  non-finite component, take no part, nor do rows without an id. Empty vectors score 0.
  Vectors of different lengths are never compared.
* Ties go to the smaller id. Repeated rows of an id are one candidate each (ranks are by
  row); "every row but the query's own" excludes all rows with the query's id.
* Pivots come from ``sample`` rows at most, chosen by hash of the id; they decide how much is
  eliminated, never what is found. A length that the sample lacks is one cell with no pivots.
* A cell is dealt in blocks of about ``rows_per_block`` rows by hash, so no key is hot, copies of
  one vector included. Cells and pivots are at most ``n_pivots`` for each length in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, pick

N_PIVOTS, FIRST = 48, 64


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    rows = pick(vectors, vec_id, embedding).toDF("vec_id", "v").where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to the pivots."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))


def choose_pivots(x: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """Up to ``n`` distinct rows of ``x``: each the farthest from those before it, the first farthest from the mean."""
    if not len(x) or not x.shape[1]:
        return x[:0]
    far = distances(x, x.mean(0, keepdims=True))[:, 0]
    chosen: list[int] = []
    while len(chosen) < n and (not chosen or far.max() > 0.5):
        chosen.append(int(far.argmax()))
        d = distances(x, x[chosen[-1:]])[:, 0]
        far = d if len(chosen) == 1 else np.minimum(far, d)
        far[chosen] = 0
    return x[chosen]


def slack(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """What rounding could cost a bound: scores are integers, squares ``a`` and ``b`` may be large."""
    return 1 + 1e-7 * (a + b)


class PivotTable:
    """The vectors of a block, ids ascending, with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, to_pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.to_pivots = ids[order], x[order], to_pivots[order]
        self.f = self.x.astype(np.float64)
        self.largest = float(np.abs(self.f).max(initial=0))
        self.square = (self.f * self.f).sum(1)
        self.evaluated = self.seen = 0

    def bounds(self, q_square: float, to_pivots: np.ndarray) -> np.ndarray:
        """No candidate scores more than this."""
        lower = np.zeros(len(self.ids)) if not self.to_pivots.shape[1] else np.abs(self.to_pivots - to_pivots).max(1)
        return (q_square + self.square - lower * lower) / 2 + slack(q_square, self.square)

    def search(self, query_id: int, q: np.ndarray, to_pivots: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, ids other than the query's, scores of ``least`` and more if given."""
        qf = q.astype(np.float64)
        upper = self.bounds(float(qf @ qf), to_pivots)
        exact = max(1, len(qf)) * float(np.abs(qf).max(initial=0)) * self.largest < 2**52
        order = np.argsort(-upper, kind="stable")
        descending = -upper[order]
        best: list[tuple[int, int]] = []
        at, size, self.seen = 0, FIRST, self.seen + len(order)
        while at < len(order):
            floor = best[-1][0] if len(best) == k else least
            stop = len(order) if floor is None else int(descending.searchsorted(-floor, side="right"))
            some = order[at : min(at + size, stop)]
            if not len(some):
                break
            at, size = at + len(some), 2 * size
            self.evaluated += len(some)
            scores = (self.f[some] @ qf).astype(np.int64) if exact else self.x[some] @ q
            good = self.ids[some] != query_id
            if floor is not None:
                good &= scores >= floor
            some, scores = some[good], scores[good]
            if len(some) > k:  # the k best of them, and all that tie with the last
                keep = scores >= -np.partition(-scores, k - 1)[k - 1]
                some, scores = some[keep], scores[keep]
            ids = self.ids[some]
            first = np.lexsort((ids, -scores))[:k]
            best = sorted([*best, *((int(scores[i]), int(ids[i])) for i in first)], key=lambda t: (-t[0], t[1]))[:k]
        return best


def _matrix(column: pd.Series, dim: int, kind) -> np.ndarray:
    return np.array(column.tolist(), dtype=kind).reshape(len(column), dim)


def _with_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add dim, cell (nearest pivot, -1 without pivots), d (distances to the pivots) and square."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby(f["v"].map(len)):
                x = _matrix(g["v"], dim, np.int64)
                p = pivots.get(dim, x[:0])
                d = distances(x, p)
                cell = d.argmin(1) if d.shape[1] else np.full(len(x), -1)
                yield pd.DataFrame({"vec_id": g["vec_id"], "v": g["v"], "dim": dim, "cell": cell, "d": list(d), "square": (x.astype(np.float64) ** 2).sum(1)})

    return rows.mapInPandas(run, "vec_id long, v array<long>, dim int, cell int, d array<double>, square double")


def _search(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score over the blocks (dim, cell, sub, qb) that both have; asked may bring ``least``."""
    keys = ["dim", "cell", "sub", "qb"]

    def run(asks: pd.DataFrame, stores: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asks) and len(stores):
            dim, n = len(stores["v"].iloc[0]), len(stores["d"].iloc[0])
            table = PivotTable(stores["vec_id"].to_numpy(np.int64), _matrix(stores["v"], dim, np.int64), _matrix(stores["d"], n, np.float64))
            for i, v, d, least in zip(asks["vec_id"], asks["v"], asks["d"], asks["least"]):
                least = None if pd.isna(least) else int(least)
                out += [(i, j, score) for score, j in table.search(int(i), np.asarray(v, dtype=np.int64), np.asarray(d), k, least)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, rows_per_block: int = 20_000, queries_per_block: int = 20_000, n_pivots: int = N_PIVOTS, sample: int = 4096, **columns) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by ``every``, their ``k`` best among all other rows."""
    plain = quantize(vectors, **columns)
    some = plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    pivots = {int(dim): choose_pivots(_matrix(g["v"], dim, np.int64), n_pivots) for dim, g in some.groupby(some["v"].map(len))} if len(some) else {}
    celled = materialize(_with_cells(plain, pivots), "vectors")

    width = max((len(p) for p in pivots.values()), default=0)
    sides = [f(F.get("d", F.lit(i))).alias(f"{name}{i}") for i in range(width) for name, f in (("low", F.min), ("high", F.max))]
    n_q = F.count_if(F.pmod("vec_id", F.lit(every)) == 0)
    cells = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"), n_q.alias("n_q"), F.max("square").alias("square"), *sides)
    known = {dim for dim in pivots if len(pivots[dim])}
    ranges: dict[int, list[tuple]] = {}
    subs = F.lit(1)
    sized = []
    for r in cells.where(F.col("dim").isin(*known)).collect() if known else ():  # a row a pivot at most
        n = len(pivots[r["dim"]])
        ranges.setdefault(r["dim"], []).append((r["cell"], -(-r["n"] // rows_per_block), r["square"], np.array([r[f"low{i}"] for i in range(n)]), np.array([r[f"high{i}"] for i in range(n)])))
        sized.append((r["dim"] * n_pivots + r["cell"], -(-r["n"] // rows_per_block), r["n_q"]))
    total_q = celled.where(F.pmod("vec_id", F.lit(every)) == 0).count()
    a = max(1, -(-total_q // queries_per_block))
    if sized:
        lookup = F.create_map(*(F.lit(x) for key, n, _ in sized for x in (key, n)))
        subs = F.coalesce(F.try_element_at(lookup, F.col("dim") * n_pivots + F.col("cell")), F.lit(1))
    placed = celled.withColumn("sub", F.pmod(F.xxhash64("vec_id", F.xxhash64("v")), subs).cast("int"))
    queries = celled.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    queries = queries.select("vec_id", "v", "d", "square", "dim", "cell", F.pmod(F.xxhash64("vec_id"), subs).cast("int").alias("sub"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(a)).cast("int").alias("qb"))
    stored = placed.select("vec_id", "v", "d", "dim", "cell", "sub")
    spread = stored.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

    home = materialize(_search(queries.withColumn("least", F.lit(None).cast("long")), spread, k), "topk-home")
    kth = home.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    onward = queries.join(kth, "vec_id", "left").select("vec_id", "v", "d", "square", "dim", F.col("cell").alias("own_cell"), F.col("sub").alias("own_sub"), "qb", "least")

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                d, least = np.asarray(row.d), row.least
                for cell, n, square, low, high in ranges.get(row.dim, ()):
                    gap = np.maximum(np.maximum(low - d, d - high), 0).max()
                    if pd.isna(least) or (row.square + square - gap * gap) / 2 + slack(row.square, square) >= least:
                        out += [(row.vec_id, row.v, row.d, row.dim, cell, sub, row.qb, least) for sub in range(n) if (cell, sub) != (row.own_cell, row.own_sub)]
            yield pd.DataFrame(out, columns=["vec_id", "v", "d", "dim", "cell", "sub", "qb", "least"])

    asked = materialize(onward.mapInPandas(reach, "vec_id long, v array<long>, d array<double>, dim int, cell int, sub int, qb int, least long"), "topk-asked")
    keys = ["dim", "cell", "sub", "qb"]
    wanted = spread.join(asked.select(*keys).distinct(), keys, "left_semi")
    found = home.unionByName(_search(asked, wanted, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def evaluated_share(x: np.ndarray, every: int = 50, k: int = 5, n_pivots: int = N_PIVOTS) -> float:
    """Of the candidates of all queries (row numbers divisible by ``every``) in one block, the share that is evaluated."""
    p = choose_pivots(x, n_pivots)
    d = distances(x, p)
    table = PivotTable(np.arange(len(x)), x, d)
    for i in range(0, len(x), every):
        table.search(i, x[i], d[i], k)
    return table.evaluated / max(1, table.seen)


def brute_force(vectors: Iterator[tuple], k: int = 5, every: int = 50, scale: int = 256) -> list[tuple]:
    """For tests: (query_id, rank, vec_id, score) over (vec_id, floats or None)."""
    import math

    x = {i: [math.floor(scale * c) for c in v] for i, v in vectors if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q in x:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q and len(x[i]) == len(x[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)
