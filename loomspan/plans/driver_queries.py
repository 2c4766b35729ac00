"""Queries over the driver's tables, one per operator family, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canon, coverage, decontam, evalrun, inventory, passk, retrieve
from ..storage import materialize
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- decontamination -------------------------------------------------------------------------

_TOKENS = r"""
keys AS (
  SELECT kind, id, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda t:
    regexp_replace(translate(lower(t), '‘’“”', '''''""'), '^[^\p{L}\p{M}\p{N}_$\\]+|[^\p{L}\p{M}\p{N}_$\\]+$', '', 'g')), lambda k: k <> '') AS k
  FROM (SELECT 'i' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents))"""
_RUNS = (
    "WITH " + _TOKENS + """,
grams AS (
  SELECT kind, id, n_keys, p, array_to_string(k[p + 1 : p + 13], chr(1)) AS g
  FROM (SELECT kind, id, k, len(k) AS n_keys, unnest(range(0, len(k) - 12)) AS p FROM keys WHERE len(k) >= 13)),
marked AS (
  SELECT DISTINCT i.id AS item_id, d.id AS doc_id, i.n_keys, d.p + o.o AS pos
  FROM (SELECT DISTINCT id, n_keys, g FROM grams WHERE kind = 'i') i JOIN grams d ON d.kind = 'd' AND d.g = i.g, range(13) o(o)),
isles AS (
  SELECT *, sum(new) OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS isle FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY item_id, doc_id ORDER BY pos) > 3 THEN 1 ELSE 0 END AS new FROM marked)),
runs AS (
  SELECT item_id, doc_id, n_keys, min(pos) AS s, max(pos) AS e, max(pos) - min(pos) + 1 AS n FROM isles GROUP BY item_id, doc_id, n_keys, isle),
hits AS (SELECT * FROM runs WHERE n >= greatest(13, floor(n_keys * 0.6 + 0.999)))
"""
)


def _hits(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


@query(_RUNS + "SELECT item_id, doc_id, s::INTEGER AS start_tok, e::INTEGER AS end_tok, n::INTEGER AS n_tokens FROM hits")
def decontam_hits(spark, sf_dir):
    return _hits(spark, sf_dir).drop("n_keys")


@query(_RUNS + """SELECT item_id, doc_id, s::INTEGER AS start_tok, n::INTEGER AS n_tokens FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id, s) AS rk FROM hits) WHERE rk = 1""")
def decontam_best_hit(spark, sf_dir):
    found = decontam.runs(decontam.marked_tokens(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")))
    return decontam.best_hits(found).select("item_id", "doc_id", "start_tok", "n_tokens")


@query(_RUNS + """SELECT source, count(*)::BIGINT AS n_docs, count(h.doc_id)::BIGINT AS n_contaminated
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM hits) h ON h.doc_id = d.doc_id GROUP BY source""")
def decontam_by_source(spark, sf_dir):
    hit = _hits(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(1))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source").join(hit, "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_contaminated"))


@query()
def redacted_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.redact(docs, _hits(spark, sf_dir).select("doc_id", "start_tok", "end_tok"))


@query("""WITH b AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0), i AS (SELECT DISTINCT source FROM documents)
SELECT source, 'book' AS missing FROM i WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT source, 'item' FROM b WHERE source NOT IN (SELECT source FROM i)""")
def sources_without_partner(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return decontam.uncovered_sources(docs, docs.join(read(spark, sf_dir, "labels").where("toxic = 1 AND quality = 0"), "doc_id", "left_semi"))


# --- cleaning --------------------------------------------------------------------------------


@query(r"""SELECT page_id, len(regexp_extract_all(html, '\$\$[\s\S]*?\$\$'))::BIGINT AS n_display,
  trim(regexp_replace(lower(regexp_replace(coalesce(url, ''), '[.,;:!?()\[\]{}"'']', ' ', 'g')), '\s+', ' ', 'g')) AS url_name,
  len(html) AS n_chars, greatest(1, len(html) // 4)::BIGINT AS n_tokens_est FROM pages""")
def page_text_scalars(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.size(F.regexp_extract_all("html", F.lit(f"({T.DISPLAY_MATH})"), F.lit(1))).cast("long").alias("n_display"),
        T.normalise_name("url").alias("url_name"), F.length("html").cast("long").alias("n_chars"), T.tokens_estimate(F.length("html")).alias("n_tokens_est"),
    )


@query()
def clean_counters(spark, sf_dir):
    done = T.cleaned(read(spark, sf_dir, "documents").select("source", "text"))
    per = done.withColumn("changed", (F.col("clean") != F.col("text")).cast("long"))
    names = ["n_leaks", "n_algorithms", "n_math", "n_pages", "n_words", "changed"]
    return per.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum(c).alias(c) for c in names))


@query()
def search_text(spark, sf_dir):
    norm = T.normalise_for_search("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1(norm.cast("binary")).alias("text_norm_sha1"), F.length(norm).alias("n_chars"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '(?is)<think>.*?</think>\s*', '', 'g') AS said, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS chinese FROM conversations""")
def think_strip(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_think("text").alias("said"), T.contains_chinese("text").alias("chinese"))


@query("""WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT u.conv_id, u.turn, count(*)::BIGINT AS n_messages, string_agg(c.role || ':' || CASE WHEN c.role = 'assistant' THEN
    CASE WHEN trim(c.text) = '' THEN '(no answer)' ELSE trim(c.text) END ELSE c.text END, chr(10) ORDER BY c.turn) AS prefix
FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn <= u.turn GROUP BY u.conv_id, u.turn""")
def chat_prefix(spark, sf_dir):
    made = evalrun.chat_prefix(read(spark, sf_dir, "conversations"))
    line = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return made.select("conv_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.array_join(line, "\n").alias("prefix"))


# --- duplicates and inventory ----------------------------------------------------------------


@query("""SELECT sha256(text) AS digest, count(*)::BIGINT AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_dup_groups(spark, sf_dir):
    return inventory.exact_duplicates(read(spark, sf_dir, "documents"))


@query("""SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def first_seen_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return inventory.first_seen(docs, ["source", "lang"], [F.desc("n_chars"), "doc_id"])


@query("""SELECT coalesce(source, 'TOTAL') AS source, count(*)::BIGINT AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars,
  sum(greatest(1, length(text) // 4))::BIGINT AS n_tokens_est FROM documents GROUP BY ROLLUP (source)""")
def inventory_rollup(spark, sf_dir):
    return inventory.text_stats(read(spark, sf_dir, "documents"), "source")


@query("""WITH g AS (SELECT source, count(*) AS n_docs, sum(n_chars) AS n_chars FROM documents GROUP BY source)
SELECT source, n_docs::BIGINT AS n_docs, n_chars::BIGINT AS n_chars, 100.0 * n_docs / sum(n_docs) OVER ()::DOUBLE AS n_docs_pct, 100.0 * n_chars / sum(n_chars) OVER ()::DOUBLE AS n_chars_pct FROM g""")
def pct_of_total(spark, sf_dir):
    grouped = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return inventory.percent_of_total(grouped, "n_docs", "n_chars")


@query("""SELECT source, count(*) FILTER (lang = 'en')::BIGINT AS en, count(*) FILTER (lang = 'de')::BIGINT AS de, count(*) FILTER (lang = 'fr')::BIGINT AS fr,
  count(*) FILTER (lang = 'es')::BIGINT AS es FROM documents GROUP BY source""")
def source_lang_pivot(spark, sf_dir):
    return inventory.pivot_counts(read(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("""SELECT doc_id, rule FROM (
  SELECT doc_id, CASE WHEN NOT coalesce(length(text) >= 200, false) THEN 'long_enough' END AS rule FROM documents UNION ALL
  SELECT doc_id, CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'counted' END FROM documents UNION ALL
  SELECT doc_id, CASE WHEN NOT coalesce(lang IN ('en', 'de'), false) THEN 'known_language' END FROM documents) WHERE rule IS NOT NULL""")
def validity_violations(spark, sf_dir):
    return inventory.violations(read(spark, sf_dir, "documents"), "doc_id", long_enough=F.length("text") >= 200,
                                counted=F.col("n_chars") == F.length("text"), known_language=F.col("lang").isin("en", "de"))


@query("""SELECT coalesce(c.k, s.k) AS nationkey, coalesce(n_customers, 0)::BIGINT AS customers, coalesce(n_suppliers, 0)::BIGINT AS suppliers FROM
 (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.k = s.k""")
def outer_counts(spark, sf_dir):
    tables = {"customers": read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")),
              "suppliers": read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))}
    return inventory.outer_counts(tables, "nationkey")


@query("""SELECT coalesce(r_name, '(unmapped)') AS r_name, count(*)::BIGINT AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) r ON r_regionkey = n_regionkey GROUP BY 1""")
def mapped_dimension(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    regions = read(spark, sf_dir, "region").where("r_regionkey < 4").select("r_regionkey", "r_name")
    joined = inventory.mapped(read(spark, sf_dir, "customer").select("c_nationkey").join(nation, "c_nationkey"), regions, "r_regionkey")
    return joined.groupBy("r_name").agg(F.count("*").alias("n"))


# --- entities --------------------------------------------------------------------------------

_NORM = """trim(regexp_replace(regexp_replace(lower(p_name), '[.,;:!?()\\[\\]{}"'']', ' ', 'g'), '\\s+', ' ', 'g'))"""
_CLUSTERS = f"""
WITH b AS (SELECT p_type AS type, {_NORM} AS norm, p_name AS spelling, p_brand AS domain, p_partkey AS p FROM part),
s AS (SELECT type, norm, spelling, count(*) AS n FROM b WHERE norm <> '' GROUP BY ALL),
c AS (SELECT type, norm, sum(n)::BIGINT AS n_records, arg_min(spelling, (-n, length(spelling), spelling)) AS canonical_name, list(spelling ORDER BY spelling) AS spellings FROM s GROUP BY type, norm)
"""


def _entities(spark, sf_dir):
    records = read(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("domain"),
                                                 F.col("p_partkey").cast("string").alias("sub_id"), F.col("p_partkey").alias("position"))
    return canon.canonical(records)


@query(_CLUSTERS + """SELECT left(sha1(c.type || '::' || c.norm), 12) AS kp_id, c.type, c.norm, canonical_name, array_to_string(list_filter(spellings, lambda x: x <> canonical_name), '|') AS aliases,
  n_records, n_subs, hints, subs FROM c
  JOIN (SELECT type, norm, string_agg(domain || '=' || n, '|' ORDER BY domain) AS hints FROM (SELECT type, norm, domain, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL) h USING (type, norm)
  JOIN (SELECT type, norm, count(*)::BIGINT AS n_subs, string_agg(p::VARCHAR, '|' ORDER BY p) AS subs FROM b GROUP BY ALL) u USING (type, norm)""")
def canonical_entities(spark, sf_dir):
    hints = F.array_join(F.transform("domain_hint", lambda x: F.concat_ws("=", x["k"], x["n"].cast("string"))), "|")
    return _entities(spark, sf_dir).select("kp_id", "type", "norm", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "n_records", "n_subs",
                                           hints.alias("hints"), F.array_join("subs", "|").alias("subs"))


@query(_CLUSTERS + r""", l AS (SELECT type, canonical_name, regexp_replace(norm, '(\s+(?:formula|equation|law|principle|theorem|approximation|expansion|method|technique|effect|relation))+$', '') AS loose FROM c)
SELECT type, loose, count(*)::BIGINT AS n, string_agg(canonical_name, '|' ORDER BY canonical_name) AS names FROM l GROUP BY type, loose HAVING count(*) > 1""")
def loose_name_collisions(spark, sf_dir):
    out = canon.loose_collisions(_entities(spark, sf_dir))
    return out.select("type", "loose", "n", F.array_join("names", "|").alias("names"))


@query(_CLUSTERS + """SELECT p_partkey, left(sha1(p_type || '::' || """ + _NORM + """), 12) AS kp_id FROM part""")
def entity_ids(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    found = canon.lookup(_entities(spark, sf_dir).withColumn("ordinal", F.col("kp_id")))
    named = part.select("p_partkey", F.col("p_type").alias("type"), T.normalise_name("p_name").alias("norm"))
    return named.join(found, ["type", "norm"], "left").select("p_partkey", "kp_id")


@query("""WITH w AS (SELECT p_brand AS brand, p_partkey AS pos, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
c AS (SELECT brand, w, count(*) AS n, min((pos, i)) AS f FROM w GROUP BY ALL)
SELECT brand, string_agg(w, '|' ORDER BY n DESC, f, w) AS keywords FROM c GROUP BY brand""")
def keywords_union(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.lit("t").alias("type"), F.col("p_brand").alias("norm"), F.split("p_name", " ").alias("keywords"), F.col("p_partkey").alias("position"))
    return canon.keywords_union(rows).select(F.col("norm").alias("brand"), F.array_join("keywords_union", "|").alias("keywords"))


# --- retrieval -------------------------------------------------------------------------------

_BM25 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS k FROM documents),
t AS (SELECT doc_id, len(k) AS dl, unnest(k) AS term FROM d),
p AS (SELECT doc_id, term, dl, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, avg(len(k)) AS avgdl FROM d),
f AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, n_docs, avgdl FROM p, n GROUP BY term, n_docs, avgdl),
m AS (SELECT 0.25 * avg(idf) AS low FROM f),
q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '')) AS term FROM benchmark),
qf AS (SELECT item_id, term, count(*) AS qf FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qf * CASE WHEN idf < 0 THEN low ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qf JOIN f USING (term) JOIN p USING (term), m GROUP BY ALL HAVING score > 0)
"""


@query(_BM25 + """SELECT item_id, doc_id, round(score, 6) AS bm25_score, rk::INTEGER AS bm25_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM s) WHERE rk <= 200""")
def bm25_topk(spark, sf_dir):
    scores = retrieve.bm25(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=200, digits=6)
    return retrieve.ranked(scores, "item_id", "doc_id", 200, "bm25", 6).withColumn("bm25_score", F.round("bm25_score", 6))


_DENSE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
s AS (SELECT q.vec_id AS query_id, u.vec_id, u.label, q.label AS q_label, list_dot_product(q.e, u.e) AS score FROM u q JOIN u ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rk FROM s)
"""


def _dense(spark, sf_dir, k):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieve.dense(vectors, queries, k=k)


@query(_DENSE + "SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE rk <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(_DENSE + """, x AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS near_rank FROM s),
f AS (SELECT coalesce(r.query_id, x.query_id) AS query_id, coalesce(r.vec_id, x.vec_id) AS vec_id, coalesce(1.0::DOUBLE / (60 + rk), 0) + coalesce(1.0::DOUBLE / (60 + near_rank), 0) AS rrf
  FROM (SELECT * FROM r WHERE rk <= 200) r FULL JOIN (SELECT * FROM x WHERE near_rank <= 200) x ON r.query_id = x.query_id AND r.vec_id = x.vec_id),
g AS (SELECT f.query_id, f.vec_id, round(f.rrf * CASE WHEN s.label = s.q_label THEN 1.0 ELSE 0.6 END::DOUBLE, 5) AS final_score FROM f JOIN s ON s.query_id = f.query_id AND s.vec_id = f.vec_id)
SELECT query_id, vec_id, final_score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vec_id) AS rank FROM g) WHERE rank <= 30""")
def rrf_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    dense = materialize(retrieve.ranked(_dense(spark, sf_dir, 200), "query_id", "vec_id", 200, "dense"), "dense")  # read for pairs and for ranks
    near = vectors.select("vec_id").withColumn("query_id", F.explode(F.expr("""filter(transform(sequence(-5, 5), i -> 50 * (vec_id div 50 + i)), q -> q >= 0)""")))
    near = near.join(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    near = retrieve.ranked(near.withColumn("score", -F.abs(F.col("vec_id") - F.col("query_id")).cast("double")), "query_id", "vec_id", 200, "near")
    labels = vectors.select("vec_id", "label")
    pairs = dense.select("query_id", "vec_id").union(near.select("query_id", "vec_id")).distinct()
    domains = pairs.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    domains = domains.select("query_id", "vec_id", (F.col("label") == F.col("q_label")).alias("in_domain"))
    return retrieve.fuse({"dense": dense, "near": near}, "query_id", "vec_id", 30, domains).select("query_id", "vec_id", "final_score", "rank")


# --- coverage --------------------------------------------------------------------------------

_MATCHES = """
WITH m AS (SELECT d.lang AS kp_id, d.source AS book, CASE WHEN d.doc_id % 3 = 0 THEN 'example' ELSE 'exposition' END AS kind, d.doc_id AS fragment_id,
  quality + 2 * (1 - toxic) AS score, d.doc_id % 2 = 0 AS quote_verified, (d.doc_id % 7)::INTEGER AS candidate_rank FROM labels l JOIN documents d USING (doc_id))
"""


def _matches(spark, sf_dir):
    """Labels as a rubric of 0 to 3: quality + 2 * (1 - toxic)."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), read(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(
        F.col("lang").alias("kp_id"), F.col("source").alias("book"), F.when(F.col("doc_id") % 3 == 0, "example").otherwise("exposition").alias("kind"),
        F.col("doc_id").alias("fragment_id"), (F.col("quality") + 2 * (1 - F.col("toxic"))).alias("score"), (F.col("doc_id") % 2 == 0).alias("quote_verified"),
        (F.col("doc_id") % 7).cast("int").alias("candidate_rank"),
    )


@query(_MATCHES + """SELECT kp_id, count(*) FILTER (score = 3)::BIGINT AS n_strong, count(*) FILTER (score = 2)::BIGINT AS n_partial, count(*) FILTER (score = 1)::BIGINT AS n_weak,
  count(*) FILTER (score = 0)::BIGINT AS n_zero FROM m GROUP BY kp_id""")
def match_score_counts(spark, sf_dir):
    return coverage.score_counts(_matches(spark, sf_dir))


@query(_MATCHES + """SELECT kp_id, kind, fragment_id, score, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY kp_id, kind ORDER BY score DESC, quote_verified DESC, candidate_rank, fragment_id) AS rk
  FROM m WHERE score >= 1) WHERE rk <= CASE WHEN kind = 'exposition' THEN 3 ELSE 2 END""")
def coverage_top_matches(spark, sf_dir):
    return coverage.top_matches(_matches(spark, sf_dir)).select("kp_id", "kind", "fragment_id", "score", "rk")


@query(_MATCHES + ", b AS (SELECT kp_id, book, max(score) AS s FROM m WHERE score >= 2 GROUP BY ALL) SELECT kp_id, "
       + ", ".join(f"max(s) FILTER (book = 'src{i}') AS src{i}" for i in range(20)) + """,
  count(*) FILTER (s >= 2)::BIGINT AS n_books, count(*) FILTER (s = 3)::BIGINT AS n_books_strong FROM b GROUP BY kp_id""")
def coverage_matrix(spark, sf_dir):
    return coverage.matrix(_matches(spark, sf_dir), [f"src{i}" for i in range(20)])


_STATUS = """
WITH k AS (SELECT d.doc_id // 2 AS sub_id, d.lang AS name, CASE WHEN l.doc_id IS NOT NULL THEN (quality = 1 AND toxic = 0)::INTEGER END AS n_strong,
  CASE WHEN l.doc_id IS NOT NULL THEN (toxic = 0)::INTEGER END AS n_partial, source FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT sub_id, count(name) AS n_kps, count(*) FILTER (n_strong IS NULL) AS n_unverified, count(*) FILTER (n_strong >= 1) AS n_strong,
  count(*) FILTER (n_strong >= 1 OR n_partial >= 1) AS n_covered FROM k GROUP BY sub_id),
t AS (SELECT *, CASE WHEN n_kps = 0 THEN 'no_kps' WHEN n_unverified > 0 THEN 'unverified' WHEN n_strong = n_kps THEN 'strongly_covered' WHEN n_covered = n_kps THEN 'covered'
  WHEN n_covered > 0 THEN 'partial' ELSE 'uncovered' END AS coverage_status FROM s)
"""


def _statuses(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name")), read(spark, sf_dir, "labels")
    strong, partial = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"), (F.col("toxic") == 0).cast("int")
    marked = labels.select("doc_id", strong.alias("n_strong"), partial.alias("n_partial"))
    kps = docs.join(marked, "doc_id", "left")
    return coverage.coverage_status(kps.withColumn("sub_id", F.floor(F.col("doc_id") / 2)))


@query(_STATUS + "SELECT sub_id, n_kps::BIGINT AS n_kps, n_unverified::BIGINT AS n_unverified, n_strong::BIGINT AS n_strong, n_covered::BIGINT AS n_covered, coverage_status FROM t")
def coverage_status(spark, sf_dir):
    return _statuses(spark, sf_dir)


@query(_STATUS + "SELECT coverage_status, count(*)::BIGINT AS n, 100.0 * count(*) / sum(count(*)) OVER ()::DOUBLE AS n_pct FROM t GROUP BY coverage_status")
def coverage_summary(spark, sf_dir):
    return coverage.status_summary(_statuses(spark, sf_dir))


@query(_STATUS + """SELECT n_kps::BIGINT AS n_kps, count(*) FILTER (coverage_status = 'strongly_covered')::BIGINT AS strongly_covered, count(*) FILTER (coverage_status = 'covered')::BIGINT AS covered,
 count(*) FILTER (coverage_status = 'partial')::BIGINT AS partial, count(*) FILTER (coverage_status = 'uncovered')::BIGINT AS uncovered,
 count(*) FILTER (coverage_status = 'unverified')::BIGINT AS unverified, count(*) FILTER (coverage_status = 'no_kps')::BIGINT AS no_kps FROM t GROUP BY n_kps""")
def status_by_type(spark, sf_dir):
    return coverage.status_by(_statuses(spark, sf_dir), "n_kps")


# --- pass@k ----------------------------------------------------------------------------------

_ATTEMPTS = """
WITH a AS (SELECT user_id AS item, event_type IN ('purchase', 'click') AS correct, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS slot FROM events),
t AS (SELECT * FROM a)
"""
_PASS8 = """p AS (SELECT item, count(*) AS n, count(*) FILTER (correct) AS c FROM t GROUP BY item),
u AS (SELECT item, n, c, CASE WHEN n - c < 8 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - list_product(list_transform(range(0, 8), lambda i: (n - c - i)::DOUBLE / (n - i))) END AS pass_at_k FROM p)"""


def _attempts(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("item"), F.col("event_type").isin("purchase", "click").alias("correct"), (F.row_number().over(w) - 1).alias("slot"))


@query(_ATTEMPTS + """SELECT grp, count(*)::BIGINT AS n_items, avg(passed) AS pass_rate, sum(hit)::DOUBLE / sum(n) AS accuracy FROM
 (SELECT slot // 8 AS grp, item, max(correct::INTEGER) AS passed, count(*) FILTER (correct) AS hit, count(*) AS n FROM t GROUP BY ALL) GROUP BY grp""")
def passk_grouped(spark, sf_dir):
    return passk.grouped(_attempts(spark, sf_dir))


@query(_ATTEMPTS + "," + _PASS8 + "SELECT item, n::BIGINT AS n, c::BIGINT AS c, round(pass_at_k, 9) AS pass_at_k FROM u")
def passk_unbiased(spark, sf_dir):
    return passk.per_item(_attempts(spark, sf_dir)).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query(_ATTEMPTS + "," + _PASS8 + """SELECT count(*)::BIGINT AS n, round(avg(pass_at_k), 9) AS mean, round(stddev_pop(pass_at_k), 9) AS sd0, round(stddev_samp(pass_at_k), 9) AS sd1,
  round(stddev_samp(pass_at_k) / sqrt(count(*)), 9) AS stderr FROM u""")
def passk_summary(spark, sf_dir):
    out = passk.spread(passk.per_item(_attempts(spark, sf_dir)), "pass_at_k")
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("mean", "sd0", "sd1", "stderr")))


# --- evaluation runs -------------------------------------------------------------------------

_SLOTS = """
WITH s AS (SELECT o_custkey AS parent, o_orderkey AS attempt, o_orderpriority AS kind, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_returnflag <> 'R' END AS correct,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS slot FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT parent, attempt, count(*) AS n_slots, min(coalesce(correct, false)::INTEGER) AS ok, count(*) FILTER (correct IS NULL) AS missing FROM s GROUP BY ALL),
r AS (SELECT parent, count(*) AS n_attempts, sum(ok) AS n_correct, max(ok) AS any_correct FROM a GROUP BY parent)
"""


def _slots(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    right = F.when(F.col("l_discount") > 0.09, None).otherwise(F.col("l_returnflag") != "R")
    numbered = lines.select("l_orderkey", right.alias("correct"), (F.row_number().over(w) - 1).alias("slot"))
    return numbered.join(orders, numbered["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("kind"), "correct", "slot"
    )


@query(_SLOTS + "SELECT parent, n_attempts::BIGINT AS n_attempts, n_correct::BIGINT AS n_correct, any_correct::INTEGER AS any_correct FROM r")
def attempt_rollup(spark, sf_dir):
    return evalrun.parent_results(_slots(spark, sf_dir))


@query(_SLOTS + """SELECT parent, slot, count(*)::BIGINT AS n_attempts, max(coalesce(correct, false)::INTEGER) AS any_correct, arg_min(coalesce(correct, false)::INTEGER, attempt) AS first_correct,
  sum(coalesce(correct, false)::INTEGER)::BIGINT AS n_correct FROM s GROUP BY parent, slot""")
def sub_passk(spark, sf_dir):
    return evalrun.sub_results(_slots(spark, sf_dir)).withColumn("slot", F.col("slot").cast("long"))


@query(_SLOTS + """, c AS (SELECT r.*, c_mktsegment AS segment FROM r JOIN customer ON c_custkey = parent)
SELECT segment, count(*)::BIGINT AS n, sum(any_correct)::BIGINT AS n_pass, sum(any_correct)::DOUBLE / count(*) AS rate FROM c GROUP BY segment""")
def by_source_rates(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent"), F.col("c_mktsegment").alias("segment"))
    return evalrun.rates_by(evalrun.parent_results(_slots(spark, sf_dir)).join(customers, "parent"), "segment")


@query(_SLOTS + """SELECT (SELECT count(*) FROM r)::BIGINT AS n_parents, (SELECT sum(any_correct) FROM r)::BIGINT AS n_any, (SELECT avg(any_correct) FROM r) AS parent_rate,
  avg(ok) AS attempt_rate, sum(missing)::BIGINT AS missing_correctness FROM a""")
def overall_metrics(spark, sf_dir):
    return evalrun.overall(_slots(spark, sf_dir))


_RESUME = """
WITH fresh AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS completion FROM orders),
old AS (SELECT o_custkey, arg_min(o_orderpriority, (o_orderkey)) AS c FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey)
"""


@query(_RESUME + "SELECT o_orderkey, o_custkey, coalesce(completion, c) AS completion, completion IS NULL AND c IS NOT NULL AS resumed FROM fresh LEFT JOIN old USING (o_custkey)")
def resume_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    fresh = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("completion"))
    cached = orders.where("o_orderstatus <> 'O'").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("completion"))
    return evalrun.resume(fresh, cached, ["o_custkey"], ["o_orderkey"])


@query("""WITH old AS (SELECT o_orderkey, o_totalprice, 'old' AS origin FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'new' AS origin FROM orders WHERE o_orderstatus <> 'F')
SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new""")
def upsert(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = orders.where("o_orderstatus <> 'P'").drop("o_orderstatus").withColumn("origin", F.lit("old"))
    new = orders.where("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("origin"))
    return incremental.upsert(old, new, ["o_orderkey"])


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_keys(spark, sf_dir):
    return incremental.pending(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH k AS (SELECT user_id, min(event_id) + 50 AS lim FROM events GROUP BY user_id)
SELECT e.user_id, max(e.event_id) AS event_id, arg_max(e.event_type, e.event_id) AS event_type FROM events e JOIN k ON k.user_id = e.user_id AND e.event_id <= k.lim GROUP BY e.user_id""")
def asof_checkpoint(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    limits = events.groupBy("user_id").agg((F.min("event_id") + 50).alias("lim"))
    return evalrun.as_of(events, limits, "user_id", "event_id", "lim")


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: length(x) >= 3), lambda x: x))), '|') AS numbers,
  regexp_replace(lower(text), '[^a-z0-9.+\\-=/^]', '', 'g') AS form FROM benchmark""")
def match_forms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.distinctive_numbers("text"), "|").alias("numbers"), T.match_form("text").alias("form"))


_HINTS = ["", " My Final Answer stands.", " \\boxed{7}", " <|end|>", " The values are not given here."]


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) AS answer FROM conversations GROUP BY conv_id),
p AS (SELECT c.conv_id, c.turn, c.text || CASE c.turn % 5 WHEN 1 THEN ' My Final Answer stands.' WHEN 2 THEN ' \\boxed{7}' WHEN 3 THEN ' <|end|>' WHEN 4 THEN ' The values are not given here.' ELSE '' END AS g, f.answer
  FROM conversations c JOIN f USING (conv_id)),
m AS (SELECT *, regexp_replace(lower(g), '[^a-z0-9.+\\-=/^]', '', 'g') AS form, regexp_replace(lower(answer), '[^a-z0-9.+\\-=/^]', '', 'g') AS gold FROM p)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(g, '\\boxed') THEN 'contains-boxed' END, CASE WHEN contains(lower(g), 'final answer') THEN 'contains-final-answer-phrase' END,
  CASE WHEN regexp_matches(g, '(?i)(?:no numerical computation is possible|(?:data|parameters?|information|values?).{0,45}not (?:given|provided|present)|(?:remaining steps|details).{0,80}(?:omitted|not present))')
    THEN 'contains-missing-data-claim' END,
  CASE WHEN length(gold) >= 8 AND contains(form, gold) THEN 'contains-normalized-gold' END, CASE WHEN regexp_matches(g, '<\\|[^|>]+\\|>') THEN 'contains-special-token' END], lambda x: x IS NOT NULL), '|') AS reasons FROM m""")
def leak_reasons(spark, sf_dir):
    """Each turn as a guidance, with a hint of each kind by turn, against the first text of its conversation as the answer."""
    turns = read(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    said = F.concat("text", F.element_at(F.array(*map(F.lit, _HINTS)), (F.col("turn") % 5 + 1).cast("int")))
    told = turns.select("conv_id", "turn", said.alias("guidance")).join(first, "conv_id")
    return told.select("conv_id", "turn", F.array_join(T.leak_reasons("guidance", "answer"), "|").alias("reasons"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, len(props) AS n FROM events""")
def json_recover(spark, sf_dir):
    from ..functions.recovery import recover_json

    fenced = F.concat(F.lit("Sure.\n```json\n"), F.col("props"), F.lit("\n```\ndone"))
    bare = F.concat(F.lit("It is {not json} but "), F.col("props"), F.lit(", or so."))
    broken = F.concat(F.lit("```json\n[1, 2\n```\nthen "), F.col("props"))
    reply = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, bare).otherwise(broken)
    events = read(spark, sf_dir, "events").select("event_id", "props", reply.alias("reply"))
    found = events.withColumn("json", recover_json("reply"))
    return found.select("event_id", F.get_json_object("json", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


# --- fragments, guidance and answers: no SQL says them -----------------------------------------


def _chapters(spark, sf_dir):
    """Documents as chapters: a heading of each kind before their lines, chosen by position."""
    lines = F.split("text", "\n")
    marks = F.transform(lines, lambda x, i: F.when(i % 7 == 2, F.concat(F.lit("# 1."), (i + 1).cast("string"), F.lit(" Part\n"), x)).when(i % 7 == 4, F.concat(F.lit("\nExample (x):\n"), x)).otherwise(x))
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.col("source").alias("book"), F.col("doc_id").cast("string").alias("chapter"), F.array_join(marks, "\n").alias("text"))


@query()
def fragment_chunks(spark, sf_dir):
    from ..operators import chunk

    made = chunk.fragments(_chapters(spark, sf_dir))
    return made.select("fragment_id", "book", "chapter", "anchor", F.array_join("section_path", " / ").alias("section_path"), "kind", "heading", "n_chars", "n_tokens_est")


@query()
def fragments_stats(spark, sf_dir):
    from ..operators import chunk

    made = chunk.fragments(_chapters(spark, sf_dir))
    return made.groupBy("book").agg(F.count("*").alias("n_fragments"), F.count_if(F.col("kind") == "example").alias("n_examples"), F.sum("n_chars").alias("n_chars"))


#: id, answer, gold, type, type sequence, and whether they are the same; worked out by hand.
JUDGED = [
    (1, r"\boxed{B}", r"\boxed{B}", "MC", "", True),
    (2, r"\boxed{B: energy}", r"\boxed{B}", "MC", "", True),
    (3, r"\boxed{C}", r"\boxed{B}", "MC", "", False),
    (4, r"\boxed{yes}", r"\boxed{TRUE}", "TF", "", True),
    (5, r"\boxed{No}", r"\boxed{TRUE}", "TF", "", False),
    (6, r"\boxed{Conservation of energy}", r"\boxed{conservation of ENERGY}", "QL", "", True),
    (7, r"\boxed{momentum}", r"\boxed{energy}", "QL", "", False),
    (8, r"\boxed{9.9}", r"\boxed{9.81}", "NV", "", True),
    (9, r"\boxed{12}", r"\boxed{9.81}", "NV", "", False),
    (10, r"\boxed{\frac{1}{2}}", r"\boxed{0.5}", "NV", "", True),
    (11, r"\boxed{4.39\times10^3}", r"\boxed{4390}", "NV", "", True),
    (12, r"\boxed{2(x+1)}", r"\boxed{2x+2}", "EX", "", True),
    (13, r"\boxed{2x+3}", r"\boxed{2x+2}", "EX", "", False),
    (14, r"\boxed{\sin^2 x+\cos^2 x}", r"\boxed{1}", "EX", "", False),
    (15, r"\boxed{2x+2y=2}", r"\boxed{x+y=1}", "EQ", "", True),
    (16, r"\boxed{x+y=2}", r"\boxed{x+y=1}", "EQ", "", False),
    (17, r"\boxed{(1,2]}", r"\boxed{(1,2]}", "IN", "", True),
    (18, r"\boxed{(1,2)}", r"\boxed{(1,2]}", "IN", "", False),
    (19, r"\boxed{2/2},\boxed{x+x}", r"\boxed{1},\boxed{2x}", "TUP", "NV,EX", True),
    (20, r"\boxed{x+x},\boxed{1}", r"\boxed{1},\boxed{2x}", "TUP", "NV,EX", False),
    (21, r"\boxed{1}", r"\boxed{1},\boxed{2x}", "TUP", "NV,EX", False),
    (22, r"\boxed{3}", r"\boxed{2},\boxed{3}", "ALT", "NV,NV", True),
    (23, r"\boxed{4}", r"\boxed{2},\boxed{3}", "ALT", "NV,NV", False),
    (24, r"\boxed{2},\boxed{1}", r"\boxed{1},\boxed{2}", "NV", "", True),
    (25, r"\boxed{\pm 3}", r"\boxed{\pm 3}", "NV", "", True),
    (26, "no box at all", r"\boxed{3}", "NV", "", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {ok}, {ok and 1.0 or 0.0}::DOUBLE)" for i, *_, ok in JUDGED) + ") AS t(id, correct, reward)")
def judge_types(spark, sf_dir):
    """All types of answers, judged and rewarded."""
    from ..functions import answers

    asked = spark.createDataFrame([r[:5] for r in JUDGED], "id int, pred string, gold string, kind string, types string")
    ok = answers.judge_column(F.col("pred"), F.col("gold"), F.col("kind"), F.col("types"), 1e-2)
    return asked.select("id", ok.alias("correct"), answers.judge_column(F.col("pred"), F.col("gold"), F.col("kind"), F.col("types"), 1e-2, "reward").cast("double").alias("reward"))


@query("""WITH l AS (SELECT l_linenumber % 5 AS kind, l_quantity::BIGINT % 2 = 0 AS same, l_extendedprice FROM lineitem)
SELECT ['NV', 'EX', 'TF', 'QL', 'MC'][kind + 1] AS kind, count(*)::BIGINT AS n,
  count(*) FILTER (same OR kind < 2 AND l_extendedprice > 0 AND round(0.001 / l_extendedprice, 6) <= 0.01)::BIGINT AS n_correct FROM l GROUP BY kind""")
def answer_judge(spark, sf_dir):
    from ..functions import answers

    lines = read(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    kind = F.element_at(F.array(*map(F.lit, ["NV", "EX", "TF", "QL", "MC"])), (F.col("l_linenumber") % 5 + 1).cast("int"))
    price = F.format_string("%.2f", "l_extendedprice")
    said = F.concat(F.lit("So \\boxed{"), F.when(F.col("l_quantity") % 2 == 0, price).otherwise(F.concat(price, F.lit("1"))), F.lit("}"))
    gold = F.concat(F.lit("\\boxed{"), price, F.lit("}"))
    return answers.judged_counts(lines.withColumn("kind", kind), said, gold, F.col("kind"), F.lit(""), ["kind"], 1e-2)


@query("""SELECT item_id, replace(regexp_replace(text, '[^A-Za-z0-9 ]+', '', 'g'), ' ', '') || '|1|2' AS answers FROM benchmark""")
def boxed_answers(spark, sf_dir):
    from ..functions import answers

    items = read(spark, sf_dir, "benchmark")
    boxed = F.concat(F.col("text"), F.lit(" \\boxed{"), F.regexp_replace("text", r"[^A-Za-z0-9 ]+", ""), F.lit("}, \\boxed{1,2}"))
    return items.select("item_id", F.array_join(answers.extracted_column(boxed), "|").alias("answers"))


@query("""SELECT item_id, true AS own, false AS other FROM benchmark""")
def quote_checks(spark, sf_dir):
    """Every item holds itself as a quote, and not itself with words that it lacks."""
    from ..operators import verify

    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), "text")
    return items.select("item_id", verify.quote_verified(F.col("quote"), F.col("text")).alias("own"), verify.quote_verified(F.concat("quote", F.lit(" qqqqqqqqqqqqqqqqqqqqqqqq")), F.col("text")).alias("other"))


@query("""WITH g AS (SELECT o_custkey AS c, count(*) FILTER (o_orderstatus = 'F') AS g FROM orders GROUP BY 1), s AS (SELECT c_custkey, length(c_name) AS n, coalesce(g, 0) AS g FROM customer LEFT JOIN g ON c = c_custkey),
t AS (SELECT *, CASE WHEN g BETWEEN 1 AND 7 THEN 'near_miss' ELSE 'zero_short_solution' END AS tier FROM s WHERE g <= 7)
SELECT c_custkey, tier, g::BIGINT AS guided_correct FROM t ORDER BY tier = 'near_miss' DESC, g DESC, n, c_custkey LIMIT 100""")
def target_selection(spark, sf_dir):
    from ..operators import guidance

    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    slots = orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("correctness"))
    right = guidance.correct_counts(slots, "guided_correct", ["c_custkey"])
    subs = customers.select("c_custkey", F.lit("NV").alias("answer_type"), F.col("c_name").alias("solution"), F.lit(None).cast("string").alias("old_guidance"))
    base = right.select("c_custkey", F.col("guided_correct").alias("base_correct"))
    return guidance.select_targets(subs, right, base, 100, ["c_custkey"]).select("c_custkey", "tier", "guided_correct")


@query(_MATCHES + """, b AS (SELECT kp_id, book, max(score) AS s FROM m WHERE score >= 2 GROUP BY ALL)
SELECT book, count(*)::BIGINT AS n_covered, count(*) FILTER (s = 3)::BIGINT AS n_strong FROM b GROUP BY book""")
def book_contributions(spark, sf_dir):
    return coverage.contributions(_matches(spark, sf_dir))


@query("""SELECT 'lang' AS label, lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents GROUP BY source""")
def label_histogram(spark, sf_dir):
    return canon.label_histogram(read(spark, sf_dir, "documents"), "lang", "source")


@query("""WITH n AS (SELECT conv_id, count(*) AS n_points FROM conversations GROUP BY conv_id) SELECT n_points::BIGINT AS n_points, count(*)::BIGINT AS n_subs FROM n GROUP BY n_points""")
def points_per_sub(spark, sf_dir):
    return canon.points_per_sub(read(spark, sf_dir, "conversations"), "conv_id")


@query(_SLOTS + """SELECT parent AS parent_index, count(*)::BIGINT AS n_slots, count(DISTINCT attempt)::BIGINT AS n_attempts, min(attempt) AS first_attempt,
  count(*) FILTER (coalesce(correct, false))::BIGINT AS n_right FROM s GROUP BY parent""")
def nested_round_trip(spark, sf_dir):
    """Slots nested to parents with attempts, and flattened again."""
    slots = _slots(spark, sf_dir).select(F.col("parent").alias("parent_index"), F.col("attempt").alias("attempt_id"), F.col("slot").alias("slot_index"), F.col("correct").alias("correctness"), "kind")
    back = evalrun.flatten_attempts(evalrun.nest_attempts(slots, ["correctness", "kind"]))
    return back.groupBy("parent_index").agg(F.count("*").alias("n_slots"), F.count_distinct("attempt_id").alias("n_attempts"), F.min("attempt_id").alias("first_attempt"),
                                            F.count_if(F.coalesce("correctness", F.lit(False))).alias("n_right"))
