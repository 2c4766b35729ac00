"""Benchmark decontamination: n-gram seeds, runs with small gaps, best hit, redaction.

Item n-grams and text n-grams meet in one equi-join on a 128-bit hash of the
gram; only positions move, never gram strings. Spark decides by its size
whether the item side is broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize


def _grams(keyed: DataFrame, n: int, tokens: int = 1 << 19) -> DataFrame:
    """One row per n-gram of the last column, token hashes: the other columns, position, two 64-bit polynomial hashes. About ``tokens`` tokens are taken at a time (one row at least)."""
    import numpy as np
    import pyarrow as pa

    kept = keyed.dtypes[:-1]

    def run(batches):
        for whole in batches:
            ends = np.cumsum(whole.column(len(kept)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype="int64")
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")))
                batch, at = whole.slice(at, to - at), to
                lists = batch.column(len(kept))
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
                keys = lists.flatten().to_numpy(zero_copy_only=False).view("uint64")
                if len(keys) < n:
                    continue
                row, end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
                start = np.flatnonzero(np.arange(len(keys)) + n <= end[row])
                hashes = []
                for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    made = np.zeros(len(keys) - n + 1, "uint64")
                    for j in range(n):
                        made = made * np.uint64(factor) + keys[j : j + len(made)]
                    hashes.append(pa.array(made[start].view("int64")))
                row = row[start]
                place = (start - (end - sizes)[row]).astype("int32")
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(len(kept))), pa.array(place), *hashes], [*(c for c, _ in kept), "p", "h1", "h2"])

    return keyed.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*kept, ("p", "int"), ("h1", "bigint"), ("h2", "bigint")]))


def long_fields(items: DataFrame, id_cols: list[str], fields: list[str]) -> DataFrame:
    """One row per non-blank text field of an item: id columns, field, text."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    return items.select(*id_cols, F.explode(parts).alias("x")).select(*id_cols, "x.field", "x.text").where(T.strip("text") != "")


def marked_tokens(items: DataFrame, texts: DataFrame, n: int = 13, item: str = "item_id", doc: str = "doc_id", source: str | None = None) -> DataFrame:
    """(item, doc, pos, n_keys): token positions of ``texts`` covered by an n-gram shared with an item of at least n tokens."""
    by = [source] if source else []
    hashed = lambda: F.transform(T.tokens("text"), lambda t: F.xxhash64(t)).alias("k")
    keyed = items.select(item, *by, hashed()).where(F.size("k") >= n)
    seeds = _grams(keyed.select(item, *by, F.size("k").alias("n_keys"), "k"), n).drop("p").distinct()
    probes = _grams(texts.select(doc, *by, hashed()), n)
    hits = probes.join(seeds, [*by, "h1", "h2"]).select(item, doc, "p", "n_keys")
    return hits.select(item, doc, "n_keys", F.explode(F.sequence(F.col("p"), F.col("p") + n - 1)).alias("pos")).distinct()


def runs(marked: DataFrame, gap: int = 2, item: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """Islands of marked tokens with at most ``gap`` unmarked ones between: start, end (inclusive), n_tokens."""
    w = Window.partitionBy(item, doc).orderBy("pos")
    new = (F.col("pos") - F.lag("pos").over(w) > gap + 1).cast("int")
    islands = marked.withColumn("isle", F.sum(F.coalesce(new, F.lit(0))).over(w))
    made = islands.groupBy(item, doc, "n_keys", "isle").agg(F.min("pos").alias("start_tok"), F.max("pos").alias("end_tok"))
    return made.select(item, doc, "n_keys", "start_tok", "end_tok", (F.col("end_tok") - F.col("start_tok") + 1).alias("n_tokens"))


def needed(n_keys: Column, n: int, cover: float) -> Column:
    return F.greatest(F.lit(n), (n_keys * F.lit(cover) + F.lit(0.999)).cast("int"))


def best_hits(found: DataFrame, n: int = 13, cover: float = 0.6, item: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """The longest run of each item that covers enough of it; ties to the first document, then position."""
    enough = found.where(F.col("n_tokens") >= needed(F.col("n_keys"), n, cover))
    w = Window.partitionBy(item).orderBy(F.desc("n_tokens"), doc, "start_tok")
    return enough.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def contaminated(items: DataFrame, texts: DataFrame, n: int = 13, gap: int = 2, cover: float = 0.6, **names) -> DataFrame:
    found = runs(marked_tokens(items, texts, n, **names), gap, **{k: v for k, v in names.items() if k != "source"})
    return found.where(F.col("n_tokens") >= needed(F.col("n_keys"), n, cover))


def merge_spans(spans: DataFrame, doc: str = "doc_id", start: str = "s", end: str = "e") -> DataFrame:
    """Overlapping and touching half-open spans of a document, merged."""
    w = Window.partitionBy(doc).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    isle = spans.withColumn("__new", new).withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(doc, "__isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__isle")


def redact_text(text: str, runs: list[tuple[int, int]], placeholder: str) -> tuple[str, int]:
    """``text`` with its token runs (first, last) replaced; runs that overlap or touch are one."""
    spans = T.token_spans(text)
    merged: list[list[int]] = []
    for s, e in sorted((spans[a][1], spans[b][2]) for a, b in runs):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + placeholder + text[e:]
    return text, len(merged)


def redact(texts: DataFrame, hits: DataFrame, placeholder: str = "[REDACTED]", doc: str = "doc_id") -> DataFrame:
    """``texts`` with the token runs of ``hits`` (start_tok, end_tok) replaced; documents without a hit don't pass through Python."""
    packed = materialize(hits.groupBy(doc).agg(F.collect_set(F.struct("start_tok", "end_tok")).alias("__runs")), "redactions")  # read twice, searched once

    @F.pandas_udf("struct<text:string,n_spans:long>")
    def run(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact_text(t, [(r["start_tok"], r["end_tok"]) for r in rs], placeholder) for t, rs in zip(text, runs)], columns=["text", "n_spans"])

    made = texts.select(doc, "text").join(packed, doc).select(doc, run("text", "__runs").alias("r")).select(doc, "r.text", "r.n_spans")
    rest = texts.join(packed.select(doc), doc, "left_anti").select(doc, "text", F.lit(0).cast("long").alias("n_spans"))
    return made.unionByName(rest)


def uncovered_sources(items: DataFrame, books: DataFrame, source: str = "source") -> DataFrame:
    """Sources with items but no book, and with books but no item."""
    a, b = items.select(source).distinct(), books.select(source).distinct()
    return a.join(b, source, "left_anti").withColumn("missing", F.lit("book")).unionByName(b.join(a, source, "left_anti").withColumn("missing", F.lit("item")))
