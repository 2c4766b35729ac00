"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

They lie in a folder of the application's own, which goes when its driver ends; what is known
to be read no more goes before (:func:`discard`, :func:`temporary`).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_held: list[list[DataFrame]] = []
_registered: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a session on this machine alone (tests) gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    own = f"{scratch_dir(spark)}/loomspan/{spark.sparkContext.applicationId}"
    if own not in _registered:
        files, at = _file_system(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _registered.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _held:
        _held[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    files, at = _file_system(df.sparkSession, df.scratch)
    files.delete(at, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables materialized within are deleted at the end: for steps whose result does not read them."""
    _held.append([])
    try:
        yield
    finally:
        for df in _held.pop():
            discard(df)
