"""Entity canonicalisation: clusters by (type, normalised name), with counts, aliases and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TYPES = ["concept", "law_or_equation", "technique", "assumption"]


def valid_records(df: DataFrame, kind: str = "type", name: str = "name", types: list[str] | None = None) -> DataFrame:
    ok = T.normalise_name(name) != ""
    return df.where(ok & F.col(kind).isin(*(types or TYPES)) if types != [] else ok)


def canonical(records: DataFrame, kind: str = "type", name: str = "name", sub: str = "sub_id", position: str = "position", hint: str = "domain") -> DataFrame:
    """One row per cluster: id, canonical name (most frequent; then shortest, then alphabetic), aliases, counts, histogram, subs in order.

    Rows come in no order; :func:`by_frequency` sorts them where an order is asked for.

    Two-stage: spellings are counted first, so a frequent entity is one row per
    spelling before it is gathered.
    """
    base = records.withColumn("norm", T.normalise_name(name)).where("norm <> ''")
    spelled = base.groupBy(F.col(kind).alias("type"), "norm", F.col(name).alias("spelling")).agg(F.count("*").alias("n"))
    names = spelled.groupBy("type", "norm").agg(
        F.sum("n").alias("n_records"),
        F.min_by("spelling", F.struct(-F.col("n"), F.length("spelling"), F.col("spelling"))).alias("canonical_name"),
        F.collect_set("spelling").alias("__all"),
    )
    hints = base.groupBy(F.col(kind).alias("type"), "norm", F.col(hint).alias("k")).agg(F.count("*").alias("n"))
    hists = hints.groupBy("type", "norm").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("domain_hint"))
    subs = base.groupBy(F.col(kind).alias("type"), "norm", F.col(sub).alias("sub")).agg(F.min(position).alias("p"))
    ordered = subs.groupBy("type", "norm").agg(F.count("*").alias("n_subs"), F.transform(F.array_sort(F.collect_list(F.struct("p", "sub"))), lambda x: x["sub"]).alias("subs"))
    joined = names.join(hists, ["type", "norm"]).join(ordered, ["type", "norm"])
    return joined.select(
        T.entity_id("type", "norm").alias("kp_id"), "type", "norm", "canonical_name",
        F.array_sort(F.array_except("__all", F.array("canonical_name"))).alias("aliases"), "n_records", "n_subs", "domain_hint", "subs",
    )


def by_frequency(entities: DataFrame) -> DataFrame:
    """The most frequent first, then by type and name."""
    return entities.orderBy(F.desc("n_records"), "type", "canonical_name")


def keywords_union(records: DataFrame, kind: str = "type", norm: str = "norm", keywords: str = "keywords", position: str = "position") -> DataFrame:
    """Keywords of each cluster by falling count, ties by first sight."""
    each = records.select(kind, norm, position, F.posexplode(keywords).alias("i", "w"))
    counted = each.groupBy(kind, norm, "w").agg(F.count("*").alias("n"), F.min(F.struct(position, "i")).alias("first"))
    packed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "w")))
    return counted.groupBy(kind, norm).agg(F.transform(packed, lambda x: x["w"]).alias("keywords_union"))


def loose_collisions(names: DataFrame, kind: str = "type", name: str = "canonical_name") -> DataFrame:
    """Clusters that differ only by generic suffixes: two or more under one loose name, largest first."""
    loose = names.groupBy(F.col(kind).alias("type"), T.normalise_name_loose(name).alias("loose"))
    return loose.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names")).where("n > 1").orderBy(F.desc("n"), "type", "loose")


def lookup(entities: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(type, norm) -> kp_id over canonical names and aliases; of duplicates the last entity wins."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array()))
    each = entities.select("type", "kp_id", ordinal, F.explode(names).alias("name")).withColumn("norm", T.normalise_name("name"))
    return each.groupBy("type", "norm").agg(F.max_by("kp_id", ordinal).alias("kp_id"))


def label_histogram(points: DataFrame, *columns: str) -> DataFrame:
    """(label, value, n) of each column's values, in one pass over the points."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns)))
    return points.select(pairs.alias("p")).groupBy(F.col("p.label").alias("label"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def points_per_sub(points: DataFrame, sub: str = "sub_id") -> DataFrame:
    return points.groupBy(sub).agg(F.count("*").alias("n_points")).groupBy("n_points").agg(F.count("*").alias("n_subs"))
