"""Sinks: JSON, JSONL, CSV matrices, side-by-side texts, append caches, text reports. All through Spark's commit protocol."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One record per line; with ``order`` in files that sort alike."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str, order: list[str], wrap: bool = False, internal: tuple[str, ...] = ("source_index",)) -> None:
    """One JSON document per output, a list or {"data": [...]}: for records that belong in one file."""
    rows = df.select(F.struct(*order).alias("__o"), F.struct(*(c for c in df.columns if c not in internal)).alias("__r"))
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("__o", F.to_json("__r").alias("j")))).alias("a"))
    text = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ",\n"), F.lit("]"))
    packed.select((F.concat(F.lit('{"data": '), text, F.lit("}")) if wrap else text).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def with_final_newline(text: str = "text"):
    return F.when(F.col(text).endswith("\n"), F.col(text)).otherwise(F.concat(F.col(text), F.lit("\n")))


def write_texts(df: DataFrame, path: str, by: str = "book", text: str = "text") -> None:
    """(path, text) per book; texts end in a newline."""
    df.withColumn(text, with_final_newline(text)).write.mode("overwrite").partitionBy(by).parquet(path)


def append_cache(df: DataFrame, path: str, seq: int) -> None:
    df.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(path)


def table_text(df: DataFrame, title: str | None = None, most: int = 1000) -> str:
    """A report table as Markdown. More than ``most`` rows are no report: an error, before they reach the driver."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report of more than {most} rows")
    rows = [[("-" if v is None else f"{v:.1f}" if isinstance(v, float) and v == v else "n/a" if isinstance(v, float) else str(v)) for v in r] for r in df.collect()]
    heads = df.columns
    width = [max(len(h), *(len(r[i]) for r in rows)) if rows else len(h) for i, h in enumerate(heads)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width)) + " |"
    return "\n".join([*([f"## {title}", ""] if title else []), line(heads), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows)]) + "\n"


def run_name(model: str, dataset: str, method: str | None = None, **limits) -> str:
    """Folder of a run: model, data, method and the limits that select a prompt, in characters any file system takes."""
    parts = [model.rstrip("/").split("/")[-1], dataset.split("/")[-1].removesuffix(".json"), method, *(f"{k}{v}" for k, v in sorted(limits.items()) if v is not None)]
    return "_".join(re.sub(r"[^A-Za-z0-9.-]+", "-", str(p)) for p in parts if p)


def write_sidecar(spark, path: str, meta: dict) -> None:
    """What a run was made with, beside its output."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
