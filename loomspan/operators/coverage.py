"""Coverage: verified matches joined to entities and sub-problems, matrices and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import canon

NOT_VERIFIED = "kp not verified yet"


def score_counts(matches: DataFrame, kp: str = "kp_id", score: str = "score") -> DataFrame:
    names = {3: "n_strong", 2: "n_partial", 1: "n_weak", 0: "n_zero"}
    return matches.groupBy(kp).agg(*(F.count_if(F.col(score) == s).alias(n) for s, n in names.items()))


def top_matches(matches: DataFrame, exposition: int = 3, example: int = 2) -> DataFrame:
    """Per entity and kind, the best matches of score 1 or more: score, then verified quotes, then rank (missing last)."""
    w = Window.partitionBy("kp_id", "kind").orderBy(F.desc("score"), F.desc(F.coalesce("quote_verified", F.lit(False))), F.coalesce("candidate_rank", F.lit(999)), "fragment_id")
    most = F.when(F.col("kind") == "exposition", exposition).otherwise(example)
    return matches.where("score >= 1 AND kind IN ('exposition', 'example')").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most)


def matrix(matches: DataFrame, books: list[str]) -> DataFrame:
    """Entity x book: best score of 2 or more, and how many books cover it (strongly)."""
    best = matches.where("score >= 2").groupBy("kp_id", "book").agg(F.max("score").alias("s"))
    counts = [F.count_if(F.col("s") >= 2).alias("n_books"), F.count_if(F.col("s") == 3).alias("n_books_strong")]
    return best.groupBy("kp_id").pivot("book", books).agg(F.max("s")).join(best.groupBy("kp_id").agg(*counts), "kp_id")


def status(n: Column, n_unverified: Column, n_strong: Column, n_covered: Column) -> Column:
    """In this order: no_kps, unverified, strongly_covered, covered, partial, uncovered."""
    return (
        F.when(n == 0, "no_kps").when(n_unverified > 0, "unverified").when(n_strong == n, "strongly_covered")
        .when(n_covered == n, "covered").when(n_covered > 0, "partial").otherwise("uncovered")
    )


def sub_coverage(sub_kps: DataFrame, entities: DataFrame, scores: DataFrame, sub: str = "sub_id") -> DataFrame:
    """Per sub-problem: its entities found by type and (alias) name, their scores, and the coverage status."""
    named = sub_kps.withColumn("norm", T.normalise_name("name")).join(canon.lookup(entities), ["type", "norm"], "left")
    return coverage_status(named.join(scores, "kp_id", "left"), sub)


def coverage_status(kps: DataFrame, sub: str = "sub_id") -> DataFrame:
    """From (sub, kp_id, n_strong, n_partial): nulls are entities not verified yet; subs without entities have a null kp_id and name."""
    verified = F.col("n_strong").isNotNull()
    strong, covered = F.col("n_strong") >= 1, (F.col("n_strong") >= 1) | (F.col("n_partial") >= 1)
    out = kps.groupBy(sub).agg(
        F.count("name").alias("n_kps"), F.count_if(F.col("name").isNotNull() & ~verified).alias("n_unverified"),
        F.count_if(verified & strong).alias("n_strong"), F.count_if(verified & covered).alias("n_covered"),
    )
    return out.withColumn("coverage_status", status(F.col("n_kps"), F.col("n_unverified"), F.col("n_strong"), F.col("n_covered")))


def status_summary(statuses: DataFrame) -> DataFrame:
    counts = statuses.groupBy("coverage_status").agg(F.count("*").alias("n"))
    from .inventory import percent_of_total

    return percent_of_total(counts, "n")


def status_by(statuses: DataFrame, group: str) -> DataFrame:
    names = ["strongly_covered", "covered", "partial", "uncovered", "unverified", "no_kps"]
    return statuses.groupBy(group).pivot("coverage_status", names).agg(F.count(F.lit(1))).na.fill(0, names)


def totals(scores: DataFrame) -> DataFrame:
    """Entities, covered (2 or more), strongly covered, without any match."""
    covered = (F.col("n_strong") > 0) | (F.col("n_partial") > 0)
    return scores.agg(F.count("*").alias("n_kps"), F.count_if(covered).alias("n_covered"), F.count_if(F.col("n_strong") > 0).alias("n_strong"), F.count_if(~covered).alias("n_uncovered"))


def contributions(matches: DataFrame) -> DataFrame:
    """Per book: entities it covers (best score 2 or more), and those it covers strongly."""
    best = matches.where("score >= 2").groupBy("book", "kp_id").agg(F.max("score").alias("s"))
    return best.groupBy("book").agg(F.count("*").alias("n_covered"), F.count_if(F.col("s") == 3).alias("n_strong"))


def extremes(entities: DataFrame, covered: bool, k: int, uses: str = "n_sub_problems") -> DataFrame:
    """The ``k`` most used entities that are covered, or that are not."""
    has = (F.coalesce("n_strong", F.lit(0)) + F.coalesce("n_partial", F.lit(0))) >= 1
    return entities.where(has if covered else ~has).orderBy(F.desc(uses), "kp_id").limit(k)


def match_blocks(matches: DataFrame, scores: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity: counts and its best expositions and examples as arrays; unverified entities get the default block."""
    top = top_matches(matches).groupBy("kp_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", F.struct("fragment_id", "score", "quote_verified").alias("m")))), lambda x: x["m"]).alias("ms"))
    wide = top.groupBy("kp_id").agg(F.collect_list(F.struct("kind", "ms")).alias("all"))
    of = lambda kind: F.flatten(F.transform(F.filter(F.coalesce("all", F.array()), lambda x: x["kind"] == kind), lambda x: x["ms"]))
    joined = entities.select("kp_id").join(scores.select("kp_id", "n_strong", "n_partial"), "kp_id", "left").join(wide, "kp_id", "left")
    return joined.select("kp_id", F.coalesce("n_strong", F.lit(0)).alias("n_strong"), F.coalesce("n_partial", F.lit(0)).alias("n_partial"), of("exposition").alias("top_exposition"),
                         of("example").alias("top_example"), F.when(F.col("n_strong").isNull(), NOT_VERIFIED).alias("verifier_error"))
