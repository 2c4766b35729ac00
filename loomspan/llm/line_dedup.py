"""Line dedup: lines whose key is in many documents go, in every document.

Lines are exploded, reduced to a 128-bit hash of their key, and counted by
distinct document; keys over the threshold go back to the documents that hold
them, whose other lines are joined again in their order.

* The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.
* A document is a ``doc_id`` (null is one id): repeated rows count once, and each loses its lines.
* A null or empty text is one empty line. Empty keys never go. An empty table stays empty.
* No line text is shuffled for the count, only (hash, doc_id) pairs, reduced before the
  second exchange; a line in a third of all documents is one combined row per task.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Whole, map_batches, map_rows, materialize, pick

_TABLE = {c: c + 32 for c in range(65, 91)}
_SEED2 = xxhash.xxh64_intdigest((1).to_bytes(8, "little"), 42)


def _key_hash(line: str) -> bytes:
    key = line.strip(" \t\n\x0b\x0c\r").translate(_TABLE).encode()
    return xxhash.xxh64_digest(key, 42) + xxhash.xxh64_digest(key, _SEED2) if key else b""


def frequent_keys(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, key hash) of every line key of at least one code point that is in ``min_docs`` documents."""

    def lines():
        def one(doc_id, text):
            return [(doc_id, k) for k in {_key_hash(x) for x in (text or "").split("\n")} if k]

        return one

    pairs = map_rows(pick(docs, "doc_id", "text"), "doc_id long, key binary", lines, 2).distinct()
    pairs = materialize(pairs, "line-keys")  # read twice: for the count and for what the count drops
    counted = pairs.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs).select("key")
    counted = materialize(counted, "frequent-keys")  # so that the join reads two plain exchanges, whose hot keys are split
    return pairs.join(counted, "key", "left_semi")


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, text without the frequent lines, n_lines, n_dropped; a row for each row."""
    base = pick(docs, "doc_id", "text")
    drops = frequent_keys(docs, min_docs).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("key").alias("__drop"))
    joined = base.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "__drop")

    def clean():
        def one(doc_id, text, drop):
            lines = (text or "").split("\n")
            gone = set(drop or ())
            kept = [x for x in lines if _key_hash(x) not in gone] if gone else lines
            return [(doc_id, "\n".join(kept), len(lines), len(lines) - len(kept))]

        return one

    return map_rows(joined, "doc_id long, text string, n_lines long, n_dropped long", clean, 3)


def dedup_lines_digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    out = dedup_lines(docs, min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def dedup_lines_in_place(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs``, all rows and columns, with the frequent lines gone from text and n_chars (if there) the new length.

    A null text stays null; columns may have any names beside doc_id and text.
    """
    import pyarrow as pa

    whole = Whole(docs, "doc_id", "text", "n_chars")
    drops = frequent_keys(docs, min_docs).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("key").alias("__drop"))
    joined = whole.frame.join(drops, F.col(whole.at["doc_id"]).eqNullSafe(F.col("__id")), "left").drop("__id")

    def make():
        def clean(text, drop):
            gone = set(drop)
            return "\n".join(x for x in text.split("\n") if _key_hash(x) not in gone)

        def one(batch):
            texts, drops = batch.column(whole.at["text"]).to_pylist(), batch.column("__drop").to_pylist()
            made = [clean(t, d) if d and t else t for t, d in zip(texts, drops)]
            for name, values in (("text", made), ("n_chars", [None if t is None else len(t) for t in made])):
                if whole.at[name]:
                    k = batch.schema.get_field_index(whole.at[name])
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(values, type=batch.schema.field(k).type))
            return batch

        return one

    whole.frame = None  # workers need the names only
    return whole.back(map_batches(joined, make, drop=("__drop",)))


def reference_dedup(rows: list[tuple], min_docs: int = 10) -> dict:
    """Brute force over (doc_id, text) for tests: {doc_id: (n_lines, n_dropped, sha256)}."""
    seen: dict[str, set] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(_TABLE)
    for i, text in rows:
        for x in (text or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
