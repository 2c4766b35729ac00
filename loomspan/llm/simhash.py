"""SimHash near-duplicates by multi-index hashing.

64-bit fingerprints of word shingles are split into two 32-bit segments. Two
fingerprints at 2 or fewer differing bits agree to within one bit in one
segment, so each segment is looked up with its Hamming ball of radius 1. Of a
pair that differs in one bit of the segment, one side has a 0 there: only 0s
are flipped, and each pair is met once. Matches are verified on all 64 bits.

* Only distinct fingerprints are joined: copies share one row, however many.
* Segment values held by more than ``max_bucket`` distinct fingerprints leave the tables;
  their fingerprints look up every fingerprint within 2 bits directly (2080 exact keys
  each, one row per key), so no link is lost and no bucket is quadratic.
* Null and empty texts have fingerprint 0, linked like any other. A document of fewer
  words than a shingle is one shingle. Repeated rows are each returned.
* ``doc_id`` null: the row gets its class's id as any other (null if no row of it has an id).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Whole, discard, map_batches, map_rows, materialize, pick
from .components import connected_components


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = starts[len(words) - n + 1 :] - 1
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, dtype=np.int64)
    spans = list(zip(starts[:n].tolist(), ends.tolist()))
    for at in range(0, n, 65536):
        part = spans[at : at + 65536]
        h = np.fromiter((digest(line[a:b], seed) for a, b in part), dtype=np.uint64, count=len(part))
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits((2 * bits > n).astype(np.uint8), bitorder="little")
    return int(ones.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    return map_rows(pick(docs, "doc_id", "text"), "doc_id long, fp long", lambda: lambda i, t: [(i, fingerprint(t, width, seed))], 2)


def near_pairs(fps: DataFrame, max_bucket: int = 4096) -> DataFrame:
    """(u, v): every pair of distinct values of ``fps`` (fp, unique) at 2 or fewer differing bits, once or twice each."""
    segments = F.array(*(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")) for s in (0, 1)))
    table = fps.select("fp", F.explode(segments).alias("s")).select("fp", "s.seg", "s.key")
    sized = table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("seg", "key")
    big = materialize(sized, "mih-big")
    cold, hot = table, None
    if not big.isEmpty():
        cold = table.join(big, ["seg", "key"], "left_anti")
        hot = table.join(big, ["seg", "key"], "left_semi").select("fp").distinct()
    ball = F.expr("""concat(array(struct(key AS k, false AS flip)),
        transform(filter(sequence(0, 31), b -> (key & shiftleft(1L, b)) = 0), b -> struct(key | shiftleft(1L, b) AS k, true AS flip)))""")
    probes = table.select("fp", "seg", F.explode(ball).alias("p")).select(F.col("fp").alias("u"), "seg", F.col("p.k").alias("key"), "p.flip")
    met = probes.join(cold.withColumnRenamed("fp", "v"), ["seg", "key"]).where(
        F.col("flip") | (F.col("u") < F.col("v"))
    ).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).between(1, 2)).select("u", "v")
    if hot is None:
        return met
    direct = hot.select(F.col("fp").alias("u"), F.explode(F.expr("""flatten(transform(sequence(0, 63), a ->
        transform(sequence(a, 63), b -> fp ^ (shiftleft(1L, a) | shiftleft(1L, b)))))""")).alias("v"))
    return met.unionByName(direct.join(fps.select(F.col("fp").alias("v")), "v").select("u", "v"))


def classes(docs: DataFrame, width: int = 3, seed: int = 42, max_bucket: int = 4096) -> DataFrame:
    """doc_id, fp, root (smallest fingerprint reachable), component_id (smallest doc_id reachable through links) for every row."""
    return linked(materialize(fingerprints(docs, width, seed), "fingerprints"), max_bucket)


def linked(sigs: DataFrame, max_bucket: int = 4096) -> DataFrame:
    """:func:`classes` of a written table of (doc_id, fp); more columns stay."""
    fps = materialize(sigs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fps")
    roots = connected_components(near_pairs(fps.select("fp"), max_bucket))
    named = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = materialize(named.join(ids, "root").select("fp", "root", "component_id"), "fp-classes")
    discard(fps)
    return sigs.join(by_fp, "fp").select(*sigs.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, max_bucket: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable through links) for every row."""
    return classes(docs, width, seed, max_bucket).drop("root")


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Of each class of ``docs``, the row with the smallest id (a null id if it has no other), all columns; of repeated rows of that id, one.

    A null text is an empty one, an empty table stays empty, and columns may have any names beside
    doc_id and text. Texts are fingerprinted once, into a written table with a number for each row;
    the rows to keep are chosen by number, and texts move once.
    """
    import pyarrow as pa

    whole = Whole(docs, "doc_id", "text")
    text = whole.at["text"]

    def make():
        def one(batch):
            fps = pa.array([fingerprint(t, width, seed) for t in batch.column(text).to_pylist()], type=pa.int64())
            return batch.set_column(batch.schema.get_field_index("__fp"), "__fp", fps)

        return one

    marked = map_batches(whole.frame.withColumn("__fp", F.lit(0).cast("long")), make)
    written = materialize(marked.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    named = linked(written.select(F.col(whole.at["doc_id"]).alias("doc_id"), F.col("__fp").alias("fp"), "__row"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    return whole.back(written.join(first, "__row", "left_semi"))
