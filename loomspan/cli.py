"""Command line: ``python -m loomspan.cli COMMAND``; each command is one job over tables or files, with --dry-run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunk, decontam, inventory, passk, slices
from .session import session
from .sources import readers, sinks


def _clean(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return T.cleaned(readers.read_texts(spark, a.input, "*.md")).drop("text").withColumnRenamed("clean", "text")


def _redact(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    texts = readers.read_texts(spark, a.input, "*.md")
    items = slices.sliced(spark.read.parquet(a.items), [a.key], a.start, a.end, a.limit, a.indices)
    long = decontam.long_fields(items, [a.key], a.fields).withColumn("__item", F.concat_ws("/", a.key, "field"))
    found = decontam.runs(decontam.marked_tokens(long, texts, a.n, item="__item", doc="path"), item="__item", doc="path")
    return decontam.redact(texts, decontam.best_hits(found, a.n, item="__item", doc="path").select("path", "start_tok", "end_tok"), doc="path")


def _fragments(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    chapters = spark.read.parquet(a.input)
    return chunk.fragments(slices.sliced(chapters, ["path"], limit=a.limit).drop("index") if a.limit is not None else chapters)


def _passk(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    attempts = spark.read.parquet(a.input)
    if a.group:
        return passk.grouped(attempts, group=a.group, exclude=a.exclude)
    return passk.spread(passk.per_item(attempts, a.k), "pass_at_k")


def _inventory(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return inventory.text_stats(spark.read.parquet(a.input), a.by)


COMMANDS = {"clean": _clean, "redact": _redact, "fragments": _fragments, "passk": _passk, "inventory": _inventory}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("loomspan")
    top.add_argument("--master", help="as for Spark; by default what the cluster sets")
    sub = top.add_subparsers(dest="command", required=True)
    made = {}
    for name in COMMANDS:
        p = made[name] = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("--out", help="a folder; without one the rows are shown")
        p.add_argument("--dry-run", action="store_true")
    r = made["redact"]
    r.add_argument("--items", required=True)
    r.add_argument("--key", default="item_id")
    r.add_argument("--fields", nargs="+", default=["text"])
    r.add_argument("--n", type=int, default=13)
    for name in ("--start", "--end", "--limit"):
        r.add_argument(name, type=int)
    r.add_argument("--indices", type=lambda s: [int(x) for x in s.split(",")])
    made["fragments"].add_argument("--limit", type=int)
    made["passk"].add_argument("--k", type=int, default=8)
    made["passk"].add_argument("--group", type=int)
    made["passk"].add_argument("--exclude", type=int, nargs="*")
    made["inventory"].add_argument("--by", default="source")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.dry_run:
        print(f"{a.command}: {a.input} -> {a.out or 'standard output'}")
        return 0
    df = COMMANDS[a.command](spark or session(a.master), a)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        print(sinks.table_text(df))
    return 0


if __name__ == "__main__":
    sys.exit(main())
