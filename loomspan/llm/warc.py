"""WARC archives: writing with revisit records, and boundary-chain verified reading.

Writing: one record per page; of pages with equal payloads of at least
``min_revisit_bytes``, the one with the largest id is the response and the others revisit it.

Reading: archives are read in splits, cut at CRLF CRLF. Every cut that starts
with a WARC version line is a *candidate* record, also when it lies inside a
payload; its task emits its offset and that of its successor by its declared
length. Chains are shortened to one hop a segment of ``segment`` bytes of a file; then pointer
jumping (doubling, a logarithmic number of joins) from the start of each file finds where its
chain enters each segment, and so which records are on it. Magic inside payloads is on no chain.

* Payloads whose end lies in another split are put together from the splits they span.
* A null html is an empty payload; null ids and urls are left out of the header and null on reading.
  Repeated rows of the page with the largest id are responses each. An empty table writes no records.
* Archives are plain by default, and read in splits; gzip ones are one split each (at most
  ``records_per_file`` records). Both go through Spark's writers and readers, so any store will do.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, pick, scratch_path

CUT = "\r\n\r\n"
MAGIC = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")


def page_records(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, n_bytes, refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    base = pick(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                                                        F.octet_length(html).cast("long").alias("n_bytes"))
    twice = (
        base.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(F.col("digest").alias("__digest"), "__first")
    )
    twice = materialize(twice, "warc-copies")  # of known size: pages are only shuffled if it is too large to broadcast
    joined = base.join(twice, F.col("digest") == F.col("__digest"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("__first")), F.col("__first"))
    return joined.select("page_id", "url", "html", "digest", "n_bytes", refers.alias("refers_to"))


def record_text(records: DataFrame) -> DataFrame:
    """The records as text, each without its closing CRLF CRLF."""
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:loomspan:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        optional("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        optional("WARC-Refers-To", urn(F.col("refers_to"))),
        optional("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Payload-Length", F.col("n_bytes").cast("string")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string")),
    )
    return records.select(F.concat(header, F.lit(CUT), F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, compress: bool = False, records_per_file: int = 50_000) -> None:
    out = record_text(page_records(pages, min_revisit_bytes)).write.option("lineSep", CUT).option("maxRecordsPerFile", records_per_file)
    (out.option("compression", "gzip") if compress else out).text(path)


_CANDIDATES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("head", pa.int64()), ("length", pa.int64()),
    ("kind", pa.string()), ("header", pa.string()), ("digest", pa.string()), ("body", pa.binary()),
])
_CANDIDATE_DDL = "file string, block long, at long, head long, length long, kind string, header string, digest string, body binary"


def _header_length(head: bytes) -> int | None:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _scan(batches, keep_body: bool):
    """Rows of (file, block, cut) in order -> candidates, offsets within the block, and a row for each block's total.

    A candidate's payload is hashed as it passes. One that its block does not
    finish has no digest; it is put together later, if it is on the chain.
    """
    here, at, waiting, out, weight = None, 0, [], [], 0

    def emit(row):
        nonlocal weight
        out.append(row)
        weight += 1 + len(row[-1] or b"") // 1024 + len(row[6] or "") // 1024

    def close():
        for c in waiting:
            emit((*here, c["at"], c["head"], c["length"], "open", c["header"], None, None))
        waiting.clear()
        if here is not None:
            emit((*here, at, None, None, "total", None, None, None))

    def feed(data: bytes):
        for c in list(waiting):
            part = data[: c["left"]]
            c["sha"].update(part)
            if keep_body:
                c["body"].append(part)
            c["left"] -= len(part)
            if not c["left"]:
                emit((*here, c["at"], c["head"], c["length"], "whole", c["header"], c["sha"].hexdigest(), b"".join(c["body"]) if keep_body else None))
                waiting.remove(c)

    for batch in batches:
        for f, b, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            cut = cut.as_py()
            if (f, b) != here:
                close()
                here, at = (f, b), 0
            feed(cut + CUT.encode())
            shift = 2 if cut.startswith(b"\r\n") else 0  # left over where a payload ends in CRLF
            if cut[shift:].startswith(MAGIC) and (n := _header_length(cut[shift:])) is not None:
                head = cut[shift:]
                waiting.append({"at": at + shift, "head": len(head) + 4, "length": n, "left": n, "header": head.decode("utf-8", "replace"), "sha": hashlib.sha1(), "body": []})
                feed(b"")
            at += len(cut) + 4
            if weight >= 4096:
                yield _rows(out)
                out, weight = [], 0
    close()
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), _CANDIDATES.types)], schema=_CANDIDATES)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", CUT).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("cut"))


def on_chain(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(file, at) reachable from offset 0 over (file, at, next), next > at: pointer jumping.

    After round i a marked record has marked the 2^i records after it, and every
    pointer spans 2^i records; each round is two joins of (file, offset) rows. ``rounds`` gets the
    number of each round's marked records.
    """
    state = materialize(edges.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("on")), "chain")
    while True:
        ahead = state.select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("jump").alias("j"))
        moved = state.join(ahead, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("a")), "left")
        if moved.where("a IS NOT NULL AND on").isEmpty():
            return state.where("on").select("file", "at")
        marks = state.where("on").select(F.col("file").alias("f"), F.col("jump").alias("a")).distinct().withColumn("hit", F.lit(True))
        marked = moved.select("file", "at", F.col("j").alias("jump"), "on").join(marks, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "left")
        before, state = state, materialize(marked.select("file", "at", "jump", (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")), "chain")
        discard(before)
        if rounds is not None:
            rounds.append(state.where("on").count())


def _exits(segment: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a segment, where its chain leaves the segment. Of a file's first segment only offset 0 can be entered."""
    leaves: dict[int, int] = {}
    for at, after in sorted(zip(segment["at"], segment["next"]), reverse=True):
        leaves[at] = leaves.get(after, after)
    out = segment.assign(next=[leaves[a] for a in segment["at"]])
    return out[out["at"] == 0] if segment["segment"].iloc[0] == 0 else out


def _followed(segment: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a segment on the chain from its entry: at most one of the file's chain, by the jumps."""
    after = dict(zip(segment["at"], segment["next"]))
    seen: set[int] = set()
    for at in segment.loc[segment["entry"], "at"]:
        while at in after and at not in seen:
            seen.add(at)
            at = after[at]
    return segment.loc[segment["at"].isin(seen), ["file", "at"]]


def chained(edges: DataFrame, segment: int = 1 << 20, rounds: list[int] | None = None) -> DataFrame:
    """:func:`on_chain` over (file, at, next): chains are shortened to one hop a segment first, so the
    joins run over segments, and their rounds are the logarithm of a file's segments.

    A group is the candidates of one segment, so it is bounded by ``segment``. Candidates that no
    segment's chain leads to cannot be entered, and take no part in the jumps.
    """
    edges = materialize(edges.withColumn("segment", F.floor(F.col("at") / segment).cast("long")), "warc-edges")
    hops = materialize(edges.groupBy("file", "segment").applyInPandas(_exits, edges.schema).select("file", "at", "next"), "warc-hops")
    targets = hops.select("file", F.col("next").alias("at")).distinct()
    doors = hops.where("at = 0").unionByName(hops.where("at > 0").join(targets, ["file", "at"], "left_semi"))
    entries = on_chain(doors, rounds).withColumn("entry", F.lit(True))
    marked = edges.join(entries, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "segment").applyInPandas(_followed, "file string, at long")


def read_warc(spark: SparkSession, path: str, keep_body: bool = False, segment: int = 1 << 20, rounds: list[int] | None = None) -> DataFrame:
    """file, at, header, length, digest (of the stored payload) and body (if kept) of the records on each file's chain."""
    seen = materialize(_cuts(spark, path).mapInArrow(lambda batches: _scan(batches, keep_body), _CANDIDATE_DDL), "warc-candidates")
    totals = seen.where("kind = 'total'").select("file", "block", F.col("at").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    found = seen.where("kind <> 'total'").join(bases, ["file", "block"]).select(
        "file", "block", "kind", "header", "length", "digest", "body", (F.col("base") + F.col("at")).alias("at"),
        (F.col("base") + F.col("at") + F.col("head")).alias("body_at"),
    )
    edges = found.select("file", "at", (F.col("body_at") + F.col("length") + 4).alias("next"))
    good = found.join(chained(edges, segment, rounds), ["file", "at"])
    whole = good.where("kind = 'whole'").select("file", "at", "header", "length", "digest", "body")
    split = materialize(good.where("kind = 'open'").select("file", "at", "header", "length", "body_at"), "warc-split")
    if split.isEmpty():
        return whole
    return whole.unionByName(_put_together(spark, path, bases, split, keep_body))


def _put_together(spark: SparkSession, path: str, bases: DataFrame, split: DataFrame, keep_body: bool) -> DataFrame:
    """Payloads that cross splits (at most one on the chain per split): their cuts are read again and joined by offset."""
    ends = bases.select("file", "block", "base").join(split, "file").where("base < body_at + length").select("file", "block", "base", "at", "body_at", "length")
    ends = materialize(ends, "warc-ends")  # a row for each end of a split or so: of known size, so that cuts are shuffled only if it is large

    def place(batches):
        here, at = None, 0
        for batch in batches:
            starts = []
            for f, b, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (f, b) != here:
                    here, at = (f, b), 0
                starts.append(at)
                at += len(cut.as_buffer()) + 4 if cut.is_valid else 4
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, type=pa.int64())], names=["file", "block", "cut", "rel"])

    cuts = _cuts(spark, path).mapInArrow(place, "file string, block long, cut binary, rel long")
    start = F.col("base") + F.col("rel")
    near = cuts.join(ends, ["file", "block"]).where((start < F.col("body_at") + F.col("length")) & (start + F.octet_length("cut") + 4 > F.col("body_at")))
    parts = near.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct(start.alias("start"), "cut"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["cut"], F.lit(CUT).cast("binary")))
    body = F.substring(whole, F.lit(1) + (F.col("body_at") - F.col("parts")[0]["start"]).cast("int"), F.col("length").cast("int"))
    made = parts.join(split, ["file", "at"]).withColumn("__body", body)
    return made.select("file", "at", "header", "length", F.sha1("__body").alias("digest"), (F.col("__body") if keep_body else F.lit(None).cast("binary")).alias("body"))


def header_field(name: str):
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def archive_digest(pages: DataFrame, path: str | None = None, compress: bool = False, segment: int = 1 << 20, rounds: list[int] | None = None) -> DataFrame:
    """Write ``pages``, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    A response's length and digest are those of the payload read back; a revisit's are its header's.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, compress=compress)
    kind = header_field("WARC-Type")
    declared = F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "")
    revisit = kind == "revisit"
    return read_warc(spark, path, segment=segment, rounds=rounds).select(
        header_field("X-Page-ID").cast("long").alias("page_id"),
        F.when(revisit, header_field("X-Payload-Length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(revisit, F.regexp_extract(header_field("WARC-Refers-To"), r"page:(-?\d+)>", 1).cast("long")).alias("refers_to"),
        (revisit | (declared == F.col("digest"))).alias("verified"),
    )
