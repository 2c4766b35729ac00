"""Slices by position in an order, sorted sets of values, and cut texts for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def positions(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Add the row's place from 0 in ``order``. Ranges of the order are numbered apart; only their sizes go through the driver."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    before, bases = 0, []
    for r in sorted(ranged.groupBy("__range").count().collect(), key=lambda r: r["__range"]):  # a row per partition
        bases += [F.lit(r["__range"]), F.lit(before)]
        before += r["count"]
    base = F.element_at(F.create_map(*bases), F.col("__range")) if bases else F.lit(0)
    w = Window.partitionBy("__range").orderBy(*order)
    return ranged.withColumn(name, (base + F.row_number().over(w) - 1).cast("long")).drop("__range")


def sliced(df: DataFrame, order: list[str], start: int | None = None, end: int | None = None, limit: int | None = None, indices: list[int] | None = None) -> DataFrame:
    """Rows at places ``start`` to ``end`` (not included), or at ``indices``; of those the first ``limit``. Negative places are an error."""
    if any(x is not None and x < 0 for x in (start, end, limit, *(indices or ()))):
        raise ValueError("places and limits are not negative")
    placed = positions(df, *order)
    if indices is not None:
        placed = placed.where(F.col("index").isin(list(indices)))
    placed = placed.where(F.col("index") >= (start or 0))
    if end is not None:
        placed = placed.where(F.col("index") < end)
    return placed.orderBy("index").limit(limit) if limit is not None else placed


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The values of a column, each once, in order; nulls are none."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


# How much of a text the records of a stage show.
SHOWN = {"problem": 240, "fragment": 2000, "reason": 280, "description": 400, "quote": 200}


def snippet(text: Column | str, what: str = "problem") -> Column:
    """The beginning of a text as a record of ``what`` shows it; empty for null."""
    return F.left(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SHOWN[what]))


def candidate_records(ranked: DataFrame, fragments: DataFrame, query: str = "kp_id", text: str = "text_md") -> DataFrame:
    """Ranked candidates with what a reader needs to see: place, book, kind and the beginning of the text."""
    return ranked.join(fragments.select("fragment_id", "book", "kind", snippet(text, "fragment").alias("snippet")), "fragment_id").select(
        query, "rank", "fragment_id", "book", "kind", "final_score", "in_domain", "snippet"
    )
