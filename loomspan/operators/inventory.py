"""Dataset inventory: counts with totals, pivots, percents of total, validity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

JUDGEABLE = ["NV", "EX", "EQ", "TUP", "IN", "MC", "TF", "QL", "ALT"]


def count_with_total(df: DataFrame, key: str, *measures: Column, total: str = "TOTAL") -> DataFrame:
    """Measures by ``key`` and, in the same pass, a TOTAL row."""
    out = df.rollup(key).agg(F.grouping(key).alias("__g"), *measures)
    return out.withColumn(key, F.when(F.col("__g") == 1, total).otherwise(F.col(key).cast("string"))).drop("__g")


def unit_count(subs: Column) -> Column:
    """A parent without subs is one unit."""
    return F.greatest(F.lit(1), F.size(F.coalesce(subs, F.array()))).cast("long")


def percent_of_total(df: DataFrame, *columns: str) -> DataFrame:
    """Add <column>_pct: percent of the column's total (0 if that is 0). Meant for grouped tables: the total is one extra aggregate, joined back."""
    totals = df.agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumns({f"{c}_pct": F.coalesce(F.try_divide(F.lit(100.0) * F.col(c), F.col(f"__t_{c}").cast("double")), F.lit(0.0)) for c in columns}).drop(
        *(f"__t_{c}" for c in columns)
    )


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def outer_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of several tables side by side on the union of their keys, missing ones 0."""
    parts = [t.groupBy(key).agg(F.count("*").alias(n)) for n, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    return joined.na.fill(0, list(tables))


def mapped(df: DataFrame, dimension: DataFrame, on: str, unknown: str = "(unmapped)", columns: list[str] | None = None) -> DataFrame:
    """Left join to a dimension; what it lacks is ``unknown``."""
    names = columns or [c for c in dimension.columns if c != on]
    return df.join(dimension, on, "left").na.fill(unknown, names)


def violations(df: DataFrame, key: str, **rules: Column) -> DataFrame:
    """One row per broken rule: key, rule."""
    found = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("rule"))


def judgeable(answer: Column, answer_type: Column) -> Column:
    return (strip(F.coalesce(answer, F.lit(""))) != "") & F.upper(F.coalesce(answer_type, F.lit(""))).isin(*JUDGEABLE)


def text_stats(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Documents, bytes, characters and estimated tokens of each group, and the grand total."""
    from ..functions.text import tokens_estimate

    chars = F.length(text)
    return count_with_total(docs, by, F.count("*").alias("n_docs"), F.sum(F.octet_length(text)).alias("n_bytes"), F.sum(chars).alias("n_chars"),
                            F.sum(tokens_estimate(chars)).alias("n_tokens_est"))


def exact_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal texts of two or more: digest, size, first id. Digests are grouped, not texts."""
    return docs.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n_copies"), F.min(doc).alias("first_id")).where("n_copies > 1")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
