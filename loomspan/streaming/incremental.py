"""Incremental work: pending keys, upserts, append caches, and a file stream that upserts batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys), keys, "left_anti")


def selected(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def layered(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Later layers win (failed, then done, then new)."""
    out = layers[0]
    for layer in layers[1:]:
        out = upsert(out, layer, keys)
    return out


def latest(cache: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """An append-only cache as it stands: of each key the row written last."""
    value = F.max_by(F.struct(*cache.columns), F.col(seq))
    return cache.groupBy(*keys).agg(value.alias("__r")).select("__r.*")


def import_missing(cache: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """What an import may append: keys the cache does not hold."""
    return other.join(cache.select(*keys), keys, "left_anti")


def window_requests(calls: DataFrame, at: str = "ts", by: str | None = None, seconds: int = 60) -> DataFrame:
    """How many calls fall in the ``seconds`` before each one, itself included.

    Time is cut in stretches of ``seconds``; a call is counted in its own and seen from the next, so
    tasks hold two stretches, however long the log.
    """
    when = F.col("__at")
    timed = calls.withColumn("__at", F.col(at).cast("double")).withColumn("__own", F.floor(when / seconds).cast("long"))
    spread = timed.withColumn("__slot", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(*([by] if by else []), "__slot").orderBy("__at").rangeBetween(-seconds, 0)
    counted = spread.withColumn("n_recent", F.count("*").over(w)).where(F.col("__slot") == F.col("__own"))
    return counted.drop("__at", "__own", "__slot")


def file_stream(spark: SparkSession, path: str, schema: StructType, checkpoint: str, step: Callable[[DataFrame, int], None], fmt: str = "parquet",
                files_per_batch: int = 1000) -> StreamingQuery:
    """New files of ``path`` go to ``step`` once each (checkpointed), all that are there now, then the stream ends."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserting(target: str, keys: list[str], transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A step that appends transformed rows under their batch number; replayed batches overwrite themselves, and :func:`current` reads the last row of a key."""

    def step(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return step


def current(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return latest(spark.read.parquet(target).drop("batch"), keys)
