"""Jobs: stages in order, each ending in written parquet, resumable from any stage, with a dry run.

A stage that calls a model gets what an earlier run wrote, asks for the keys that lack a
result (or whose result is an error worth another try), and never for the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canon, chunk, coverage, decontam, retrieve, verify
from ..sources import clients, readers
from ..storage import discard, materialize
from ..streaming import incremental


@dataclass
class Job:
    """``stages``: (name, function of the job's context and of the tables made so far). Tables are written under ``root``."""

    spark: SparkSession
    root: str
    stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = field(default_factory=list)

    def run(self, tables: dict[str, DataFrame] | None = None, start_at: str | int | None = None, dry_run: bool = False) -> dict[str, DataFrame] | list[str]:
        names = [n for n, _ in self.stages]
        first = names.index(start_at) if isinstance(start_at, str) else (start_at or 1) - 1 if start_at is not None else 0
        if not 0 <= first < max(1, len(names)):
            raise ValueError(f"no stage {start_at!r}; stages are {', '.join(names)}")
        if dry_run:
            return names[first:]
        made = dict(tables or {})
        for i, (name, stage) in enumerate(self.stages):
            path = f"{self.root}/{name}"
            if i >= first:
                made[f"old:{name}"] = self.earlier(path)
                fresh = materialize(stage(made), f"job-{name}")  # a stage may read what it replaces
                fresh.write.mode("overwrite").parquet(path)
                discard(fresh)
            made[name] = self.spark.read.parquet(path)
        return made


    def earlier(self, path: str) -> DataFrame | None:
        """What an earlier run wrote, if it did."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            return None
        return self.spark.read.parquet(path)


def resumable(old: DataFrame | None, wanted: DataFrame, keys: list[str], step: Callable[[DataFrame], DataFrame], retry: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Only keys without a result (or whose result ``retry`` selects) go through ``step``; the rest is kept as it is."""
    if old is None:
        return step(wanted)
    done = old.join(retry(old).select(*keys), keys, "left_anti") if retry else old
    return incremental.upsert(done, step(incremental.pending(wanted, done, keys)), keys)


def corpus_job(spark: SparkSession, root: str, corpus: str, items: DataFrame, fields: list[str], n: int = 13, service: Callable | None = None) -> Job:
    """parse (PDFs without Markdown), clean, redact. ``items``: source, item_id and text fields; sources are the corpus' folders."""

    def parsed(made):
        pdfs, mds = readers.listing(spark, corpus, "*.[pP][dD][fF]"), readers.listing(spark, corpus, "*.md")
        have = readers.read_texts(spark, corpus, "*.md").join(readers.preferred_markdown(mds).select("path"), "path")
        if service is None:
            return have.select("path", "text")
        new = clients.parse_pdfs(readers.unparsed_pdfs(pdfs, mds).select("path"), service).where("state = 'done'")
        return have.select("path", "text").unionByName(new.select("path", "text"))

    def cleaned(made):
        source = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
        done = T.cleaned(made["parsed"].select("path", source.alias("source"), "text")).drop("text")
        return done.withColumnRenamed("clean", "text")

    def redacted(made):
        long = decontam.long_fields(items, ["source", "item_id"], fields).withColumn("key", F.concat_ws("/", "item_id", "field"))
        found = decontam.runs(decontam.marked_tokens(long, made["cleaned"], n, item="key", doc="path", source="source"), item="key", doc="path")
        hits = decontam.best_hits(found, n, item="key", doc="path")
        return decontam.redact(made["cleaned"], hits.select("path", "start_tok", "end_tok"), doc="path")

    return Job(spark, root, [("parsed", parsed), ("cleaned", cleaned), ("redacted", redacted)])


def failed(replies: DataFrame) -> DataFrame:
    return replies.where(F.col("error").isNotNull() & T.is_retryable("error"))


def coverage_job(spark: SparkSession, root: str, chapters: DataFrame, subs: DataFrame, extractor: Callable, verifier: Callable, embed: Callable | None = None,
                 domains: DataFrame | None = None, pool: int = 200, top: int = 30) -> Job:
    """fragments, told (model), points, entities, embedded (model), candidates, judged (model), matches, covered.

    ``chapters``: path, book, chapter, text. ``subs``: sub_id, problem, solution, domain.
    ``embed``: () -> f(list of texts) -> vectors, made once a task; with it the dense channel is fused with BM25.
    ``domains``: book, domain; a candidate is in its entity's domains if the book's domain is one of those the entity's subs have.
    The stages told, embedded and judged keep what an earlier run has.
    """

    def told(made):
        message = F.array(F.struct(F.lit("user").alias("role"), F.concat_ws("\n\n", "problem", "solution").alias("content")))
        ask = lambda rows: clients.complete(rows, extractor).select("sub_id", "reply", "error")
        return resumable(made["old:told"], subs.withColumn("messages", message), ["sub_id"], ask, failed)

    def points(made):
        listed = made["told"].join(subs.select("sub_id", "domain"), "sub_id")
        return listed.select("sub_id", "domain", F.posexplode(verify.knowledge_points_column("reply")).alias("pos", "p")).select("sub_id", "domain", "pos", "p.*")

    def entities(made):
        found = canon.valid_records(made["points"].withColumn("position", F.col("sub_id")))
        kept = canon.canonical(found, sub="sub_id", position="position", hint="domain")
        named = found.withColumn("norm", T.normalise_name("name"))
        words = canon.keywords_union(named)
        said = named.groupBy("type", "norm").agg(F.array_sort(F.collect_set(F.struct("sub_id", "pos", "description"))).alias("__d"), F.array_sort(F.collect_set("domain")).alias("domains"))
        said = said.select("type", "norm", F.transform(F.slice("__d", 1, 8), lambda x: x["description"]).alias("descriptions"), "domains")
        return kept.join(words, ["type", "norm"], "left").join(said, ["type", "norm"], "left")

    def texts(made):
        asked = made["entities"].select(F.concat(F.lit("kp:"), "kp_id").alias("key"), T.query_text(F.col("canonical_name"), F.col("keywords_union"), F.coalesce("descriptions", F.array().cast("array<string>"))).alias("text"))
        return asked.unionByName(made["fragments"].select(F.concat(F.lit("f:"), "fragment_id").alias("key"), F.col("text_norm").alias("text")))

    def embedded(made):
        def run(frames):
            model = embed()
            for f in frames:
                yield f[["key", "digest"]].assign(vector=[[float(x) for x in v] for v in model(f["text"].tolist())])

        if embed is None:
            return spark.createDataFrame([], "key string, digest string, vector array<double>")
        wanted = texts(made).withColumn("digest", F.sha1(F.col("text").cast("binary")))  # a changed text is another key
        return resumable(made["old:embedded"], wanted, ["key", "digest"], lambda rows: rows.mapInPandas(run, "key string, digest string, vector array<double>"))

    def candidates(made):
        asked = texts(made).where("key LIKE 'kp:%'").select(F.expr("substring(key, 4)").alias("kp_id"), "text")
        scores = retrieve.bm25(made["fragments"].withColumn("text", F.col("text_norm")), asked, "fragment_id", "kp_id", query_terms=retrieve.split_terms(F.col("text")), k=pool)
        channels = {"bm25": retrieve.ranked(scores, "kp_id", "fragment_id", pool, "bm25")}
        if embed is not None:
            now = texts(made).select("key", F.sha1(F.col("text").cast("binary")).alias("digest"))
            vectors = made["embedded"].join(now, ["key", "digest"], "left_semi")
            of = lambda prefix, name: vectors.where(F.startswith("key", F.lit(prefix))).select(F.expr(f"substring(key, {len(prefix) + 1})").alias(name), "vector")
            near = retrieve.dense(of("f:", "fragment_id"), of("kp:", "kp_id"), "kp_id", "fragment_id", "vector", pool)
            channels["emb"] = retrieve.ranked(near, "kp_id", "fragment_id", pool, "emb")
        within = None
        if domains is not None:
            met = channels["bm25"].select("kp_id", "fragment_id")
            met = met.unionByName(channels["emb"].select("kp_id", "fragment_id")).distinct() if "emb" in channels else met
            placed = met.join(made["fragments"].select("fragment_id", "book"), "fragment_id").join(domains.select("book", "domain"), "book", "left")
            within = placed.join(made["entities"].select("kp_id", F.coalesce("domains", F.array().cast("array<string>")).alias("expected")), "kp_id")
            within = within.select("kp_id", "fragment_id", F.coalesce(retrieve.in_domain(F.col("expected"), F.col("domain")), F.lit(True)).alias("in_domain"))
        fused = retrieve.fuse(channels, "kp_id", "fragment_id", top, within)
        return fused.join(made["fragments"].select("fragment_id", "book", "kind", F.col("text_md").alias("text")), "fragment_id")

    def judged(made):
        numbered = made["candidates"].withColumn("index", F.col("rank"))
        shown = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.left("text", F.lit(2000)))
        packed = numbered.groupBy("kp_id").agg(F.array_sort(F.collect_list(F.struct("index", shown.alias("t")))).alias("c"))  # at most ``top`` a point
        wanted = verify.to_verify(made["entities"].withColumn("n_sub_problems", F.col("n_subs"))).select("kp_id", "canonical_name")
        message = F.concat_ws("\n", "canonical_name", F.array_join(F.transform("c", lambda x: x["t"]), "\n"))
        asked = packed.join(wanted, "kp_id").select("kp_id", F.array(F.struct(F.lit("user").alias("role"), message.alias("content"))).alias("messages"), F.sha1(message.cast("binary")).alias("digest"))
        ask = lambda rows: clients.complete(rows, verifier).select("kp_id", "digest", "reply", "error")
        return resumable(made["old:judged"], asked, ["kp_id", "digest"], ask, failed)  # other candidates are another question

    def matches(made):
        numbered = made["candidates"].withColumn("index", F.col("rank"))
        parsed = verify.parsed_replies(made["judged"])
        return verify.verified_matches(parsed, numbered.select("kp_id", "index", "fragment_id", "book", "kind", "text", F.col("rank").alias("candidate_rank")))

    def covered(made):
        named = subs.select("sub_id").join(made["points"].select("sub_id", "type", "name"), "sub_id", "left")
        listed = made["entities"].withColumn("ordinal", F.col("kp_id"))
        return coverage.sub_coverage(named, listed, coverage.score_counts(made["matches"]))

    return Job(spark, root, [("fragments", lambda made: chunk.fragments(chapters)), ("told", told), ("points", points), ("entities", entities), ("embedded", embedded),
                             ("candidates", candidates), ("judged", judged), ("matches", matches), ("covered", covered)])

