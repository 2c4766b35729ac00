"""pass@k: grouped and unbiased, with means, deviations and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unbiased(n: Column, c: Column, k: int) -> Column:
    """1 - prod_{i<k} (n-c-i)/(n-i); 1 if fewer than k attempts fail. Invalid counts raise."""
    if k <= 0:
        raise ValueError("k must be positive")
    good = (n > 0) & (c >= 0) & (c <= n) & (F.lit(k) <= n)
    chance = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(~good, F.raise_error(F.lit("pass@k: counts out of range")).cast("double")).when(n - c < k, 1.0).otherwise(F.lit(1.0) - chance)


def in_order(attempts: DataFrame, item: str, attempt_id: str, position: str) -> DataFrame:
    """Add slot: rank by attempt id where an item's ids are all set and distinct, else by position."""
    w = Window.partitionBy(item)
    whole = (F.count(attempt_id).over(w) == F.count(F.lit(1)).over(w)) & (F.size(F.collect_set(attempt_id).over(w)) == F.count(F.lit(1)).over(w))
    keyed = attempts.withColumn("__key", F.when(whole, F.col(attempt_id)).otherwise(F.col(position)))
    return keyed.withColumn("slot", F.row_number().over(w.orderBy("__key", position)) - 1).drop("__key")


def grouped(attempts: DataFrame, item: str = "item", slot: str = "slot", correct: str = "correct", group: int = 8, exclude: list[int] | None = None) -> DataFrame:
    """Per group of ``group`` consecutive slots: items, pass rate, accuracy."""
    ok = F.coalesce(F.col(correct), F.lit(False))
    g = attempts.withColumn("grp", F.floor(F.col(slot) / group).cast("long"))
    if exclude:
        g = g.where(~F.col("grp").isin(exclude))
    per = g.groupBy("grp", item).agg(F.max(ok.cast("int")).alias("passed"), F.sum(ok.cast("int")).alias("right"), F.count("*").alias("n"))
    return per.groupBy("grp").agg(F.count("*").alias("n_items"), F.avg("passed").alias("pass_rate"), (F.sum("right") / F.sum("n")).alias("accuracy"))


def per_item(attempts: DataFrame, k: int = 8, item: str = "item", correct: str = "correct") -> DataFrame:
    counts = attempts.groupBy(item).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("long")).alias("c"))
    return counts.withColumn("pass_at_k", unbiased(F.col("n"), F.col("c"), k))


def spread(values: DataFrame, column: str) -> DataFrame:
    """n, mean, population and sample deviation, standard error; NaN where there is too little."""
    v, nan = F.col(column), F.lit(float("nan"))
    return values.agg(
        F.count(v).alias("n"), F.coalesce(F.avg(v), nan).alias("mean"), F.coalesce(F.stddev_pop(v), nan).alias("sd0"),
        F.coalesce(F.stddev_samp(v), nan).alias("sd1"), F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), nan).alias("stderr"),
    )
