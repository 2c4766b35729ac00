"""Sources: JSON (list or {"data": []}), JSONL, file trees, Markdown and PDF discovery, prompt histories, embedding caches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import strip

# The configurations of the published dataset.
CONFIGS = ("apho", "eupho", "ioaa", "ipho", "nbpho", "opho", "textbook_astro", "textbook_physics")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Documents that are a list of records, or an object with such a list under ``data``: records with file and position."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = ArrayType(schema)
    records = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", StructType().add("data", kind))["data"])
    return whole.select("file", F.posexplode(records).alias("position", "r")).select("file", "position", "r.*")


def read_many(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Records of several files in the order given, with a dense source_index from 0."""
    parts = [read_json(spark, p, schema).withColumn("__f", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sizes = out.groupBy("__f").agg(F.count("*").alias("__n"))
    before = sizes.select("__f", F.coalesce(F.sum("__n").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row per file
    w = Window.partitionBy("__f").orderBy("file", "position")
    return out.join(before, "__f").withColumn("source_index", F.col("__b") + F.row_number().over(w) - 1).drop("__f", "__b", "position", "file")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record per line; blank lines are no records."""
    lines = spark.read.text(path).where(strip("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_config(spark: SparkSession, root: str, config: str, configs: tuple[str, ...] = CONFIGS) -> DataFrame:
    """The parquet folder of a dataset configuration from a closed list."""
    if config not in configs:
        raise ValueError(f"unknown config {config!r}; one of {', '.join(configs)}")
    return spark.read.parquet(f"{root}/{config}")


def decode_bytes(content: Column | str) -> Column:
    """Text of bytes whose first 1024 tell the encoding: byte-order marks, UTF-8, else Latin-1; what does not decode is dropped."""

    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            head = bytes(x[:1024])
            name = "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-16" if head[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
            if name == "utf-8":
                try:
                    head[: len(head) - 4 if len(head) == 1024 else None].decode()
                except UnicodeDecodeError:
                    name = "latin-1"
            return bytes(x).decode(name, "ignore")

        return b.map(one)

    return run(content)


def split_path(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("dir", F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract(path, r"([^/]*)$", 1))


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, dir, name) of files under ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return split_path(found.select("path"))


def preferred_markdown(files: DataFrame, skip: tuple[str, ...] = ("ocrfix.md", "ocrfix.redacted.md")) -> DataFrame:
    """Of each folder full.md, else the first name; generated files never."""
    w = Window.partitionBy("dir").orderBy(F.col("name") != "full.md", "name")
    return files.where(~F.col("name").isin(*skip)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def unparsed_pdfs(pdfs: DataFrame, markdown: DataFrame) -> DataFrame:
    """PDFs whose folder, or the folder named like them, holds no full.md yet."""
    done = markdown.where("name = 'full.md'").select("dir").distinct()
    target = F.concat_ws("/", "dir", F.regexp_replace("name", r"(?i)\.pdf$", ""))
    return pdfs.join(done, "dir", "left_anti").withColumn("target", target).join(done.withColumnRenamed("dir", "target"), "target", "left_anti")


def books(files: DataFrame, root: str, name: str = "ocrfix.md") -> DataFrame:
    """(book, dir): child folders of ``root`` with such a file somewhere below."""
    below = F.regexp_extract("path", re.escape(root.rstrip("/")).replace("\\/", "/") + r"/([^/]+)/", 1)
    return files.where(F.col("name") == name).select(below.alias("book")).where("book <> ''").distinct().withColumn("dir", F.concat_ws("/", F.lit(root.rstrip("/")), "book"))


def resolve_books(chapters: DataFrame, catalogue: DataFrame, folder: str = "folder") -> DataFrame:
    """Folder to book and whether it is a solution manual, by the folder's name; what the catalogue lacks is left out."""
    suffix = r"_solution_manual(_by_chapter)?$"
    named = chapters.withColumn("is_solution_manual", F.col(folder).rlike(suffix))
    named = named.withColumn("book", F.regexp_replace(F.regexp_replace(folder, suffix, ""), r"_by_chapter$", ""))
    return named.join(catalogue, "book")


def read_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text) of whole files."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def prompt_history(spark: SparkSession, path: str) -> DataFrame:
    """(position, iteration, rollouts, system_prompt): JSON lines, one JSON object, or a plain text that is the prompt."""
    schema = "struct<iteration:int,rollouts:int,score:double,system_prompt:string>"
    whole = spark.read.text(path, wholetext=True)
    one = F.from_json("value", schema)
    lines = F.filter(F.split("value", "\n"), lambda x: strip(x) != "")
    rows = F.filter(F.transform(lines, lambda x: F.from_json(x, schema)), lambda r: r["system_prompt"].isNotNull())
    plain = F.array(F.struct(F.lit(None).cast("int").alias("iteration"), F.lit(None).cast("int").alias("rollouts"), F.lit(None).cast("double").alias("score"), F.regexp_replace("value", r"^\s+|\s+\z", "").alias("system_prompt")))
    chosen = F.when(F.size(rows) > 0, rows).when(one["system_prompt"].isNotNull(), F.array(one)).otherwise(plain)
    return whole.select(F.posexplode(chosen).alias("position", "r")).select("position", "r.*")


def select_prompt(history: DataFrame, iteration: int | None = None, rollouts: int | None = None) -> DataFrame:
    """The last row at or before the limit (the last of all without one); fails if there is none."""
    rows = history
    for name, most in (("iteration", iteration), ("rollouts", rollouts)):
        if most is not None:
            rows = rows.where(F.col(name) <= most)
    last = rows.agg(F.max_by(F.struct(*history.columns), F.col("position")).alias("r"))
    return last.select(F.when(F.col("r").isNull(), F.raise_error(F.lit("no prompt at or before the limit"))).otherwise(F.col("r.system_prompt")).alias("system_prompt"))


def stale_embeddings(fragments: DataFrame, cache: DataFrame, key: str = "fragment_id") -> DataFrame:
    """Fragments the cache has no vector for: by id, so equal counts never hide a change."""
    return fragments.join(cache.select(key), key, "left_anti")
