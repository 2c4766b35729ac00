"""Helpers shared by the training-data operators.

Every operator reads its input through :func:`pick`, which takes columns by
name and position, so extra columns (clashing names included) never matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, scratch_dir, scratch_path, temporary

__all__ = ["discard", "materialize", "scratch_dir", "scratch_path", "temporary"]

#: White space of every word and line rule here, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
TOKENIZER_DIR = "/opt/tokenizers"


def _place(columns: list[str], name: str) -> int | None:
    """Of columns that share a name (any case) an exact match wins, then the first."""
    exact = [i for i, c in enumerate(columns) if c == name]
    return next(iter(exact or [i for i, c in enumerate(columns) if c.lower() == name.lower()]), None)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select ``names``; of columns that share a name (any case) an exact match wins, then the first."""
    unique = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*unique).select(*(F.col(unique[_place(df.columns, n)]).alias(n) for n in names))


class Whole:
    """All columns of a table under names of their own (``__c0``, ...), so that no name in it can clash with a helper's.

    ``at`` has the own name of a named column (None if there is none); ``back`` gives the old names and order.
    """

    def __init__(self, df: DataFrame, *names: str):
        self.columns = df.columns
        self.own = [f"__c{i}" for i in range(len(df.columns))]
        self.frame = df.toDF(*self.own)
        self.at = {n: None if (k := _place(df.columns, n)) is None else self.own[k] for n in names}

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.own).toDF(*self.columns)


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, once a Python worker: what a task has learned serves the next one, until :func:`fresh`. One is kept at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def fresh() -> None:
    """Drop what :func:`kept` holds: workers outlive their operator, and the next one's memory would come on top."""
    _kept.clear()


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable], n_in: int) -> DataFrame:
    """mapInArrow over rows: ``make()`` runs once a task and returns f(*row) -> iterable of output tuples.

    Rows are taken one by one, so no more than one document's intermediates
    and one output batch are alive at a time.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        f = make()
        out: list[tuple] = []
        weight = 0
        for batch in batches:
            for row in zip(*(_items(batch.column(i)) for i in range(n_in))):
                for made in f(*row):
                    out.append(made)
                    weight += 1 + sum(len(x) for x in made if isinstance(x, (str, bytes))) // 1024
                    if weight >= 4096:
                        yield _to_batch(out, arrow)
                        out, weight = [], 0
        if out:
            yield _to_batch(out, arrow)

    return df.mapInArrow(run, schema)


def _items(column: pa.Array) -> Iterator:
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).to_pylist()


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of rows whose labels no model may learn."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class WordCache(dict):
    """word -> value, computed once a task and word; emptied when ``limit`` words are held."""

    def __init__(self, compute: Callable, limit: int = 600_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.compute(word)
        return value


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Pass all columns of ``df`` through ``make()``(batch), a few rows at a time; ``drop`` names helper columns that end here."""
    from pyspark.sql.types import StructType

    keep = StructType([f for f in df.schema.fields if f.name not in drop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                made = f(batch.slice(i, 512))
                yield made.select([c for c in range(made.num_columns) if made.schema.names[c] not in drop])

    return df.mapInArrow(run, keep)
