"""Operators against small independent Python, and the edge cases of each."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.operators import canon, chunk, coverage, decontam, evalrun, guidance, inventory, passk, retrieve, verify
from loomspan.streaming import incremental


def rows(df, *names):
    return sorted(tuple(r[n] for n in names or df.columns) for r in df.collect())


def test_runs_merge_by_gap(spark):
    marked = spark.createDataFrame([(1, 1, 9, p) for p in (0, 1, 2, 5, 6, 10)], "item_id long, doc_id long, n_keys int, pos int")
    assert rows(decontam.runs(marked, 2), "start_tok", "end_tok", "n_tokens") == [(0, 6, 7), (10, 10, 1)]
    assert rows(decontam.runs(marked, 3), "start_tok", "end_tok") == [(0, 10)]


def brute_hits(items, docs, n, gap, cover):
    out = []
    for i, a in items:
        ka = a.split()
        grams = {tuple(ka[p : p + n]) for p in range(len(ka) - n + 1)}
        for d, b in docs:
            kb = b.split()
            pos = sorted({p + o for p in range(len(kb) - n + 1) if tuple(kb[p : p + n]) in grams for o in range(n)})
            groups = []
            for p in pos:
                if groups and p - groups[-1][1] <= gap + 1:
                    groups[-1][1] = p
                else:
                    groups.append([p, p])
            out += [(i, d, s, e) for s, e in groups if e - s + 1 >= max(n, int(len(ka) * cover + 0.999))]
    return sorted(out)


def test_decontamination_is_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(3, 14)))) for i in range(12)]
    docs = [(d, " ".join(w for _ in range(4) for w in (rng.choice(items)[1].split() if rng.random() < 0.6 else ["zz"] * 5))) for d in range(25)]
    got = decontam.contaminated(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), n=4, gap=2, cover=0.6)
    assert rows(got, "item_id", "doc_id", "start_tok", "end_tok") == brute_hits(items, docs, 4, 2, 0.6)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "keep The quick brown fox! keep"), (2, "nothing")], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 1, 2), (1, 2, 4)], "doc_id long, start_tok int, end_tok int")
    assert rows(decontam.redact(docs, hits)) == [(1, "keep [REDACTED] keep", 1), (2, "nothing", 0)]
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8)], "doc_id long, s int, e int")
    assert rows(decontam.merge_spans(spans), "s", "e") == [(0, 5), (7, 9)]


def test_best_hit_ties(spark):
    runs = spark.createDataFrame([(1, 5, 20, 0, 15, 16), (1, 3, 20, 4, 19, 16), (1, 3, 20, 2, 17, 16)], "item_id long, doc_id long, n_keys int, start_tok int, end_tok int, n_tokens int")
    assert rows(decontam.best_hits(runs), "doc_id", "start_tok") == [(3, 2)]


@pytest.mark.parametrize(("n", "c", "k", "want"), [(24, 1, 8, 1 / 3), (24, 0, 8, 0.0), (24, 17, 8, 1.0), (8, 1, 8, 1.0), (10, 3, 2, 1 - 7 * 6 / 90)])
def test_unbiased(spark, n, c, k, want):
    assert spark.range(1).select(passk.unbiased(F.lit(n), F.lit(c), k)).first()[0] == pytest.approx(want)


def test_unbiased_rejects(spark):
    for n, c in ((5, 1), (8, 9)):
        with pytest.raises(Exception, match="out of range"):
            spark.range(1).select(passk.unbiased(F.lit(n), F.lit(c), 8)).collect()


def test_passk_grouping_and_spread(spark):
    df = spark.createDataFrame([("a", s, s == 9) for s in range(16)] + [("b", s, None) for s in range(16)], "item string, slot int, correct boolean")
    assert rows(passk.grouped(df)) == [(0, 2, 0.0, 0.0), (1, 2, 0.5, 1 / 16)]
    assert rows(passk.grouped(df, exclude=[0]), "grp") == [(1,)]
    one = passk.spread(spark.createDataFrame([(1.0,)], "x double"), "x").first()
    assert one["mean"] == 1.0 and one["sd0"] == 0.0 and one["sd1"] != one["sd1"]
    order = spark.createDataFrame([("a", 2, 0), ("a", 1, 1), ("b", 1, 0), ("b", 1, 1)], "item string, attempt_id int, position int")
    assert rows(passk.in_order(order, "item", "attempt_id", "position"), "item", "position", "slot") == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1)]


def test_canonical(spark):
    data = [("concept", "Ideal Gas", "s1", 0, "x"), ("concept", "ideal gas!", "s2", 1, "x"), ("concept", "Ideal Gas", "s1", 2, "y"), ("technique", "Ideal gas", "s3", 3, "x"), ("concept", "  ", "s", 4, "x")]
    out = canon.by_frequency(canon.canonical(spark.createDataFrame(data, "type string, name string, sub_id string, position int, domain string"))).collect()
    assert [(r["type"], r["canonical_name"], r["aliases"], r["n_records"], r["n_subs"], r["subs"]) for r in out] == [
        ("concept", "Ideal Gas", ["ideal gas!"], 3, 2, ["s1", "s2"]), ("technique", "Ideal gas", [], 1, 1, ["s3"])]
    assert [tuple(x) for x in out[0]["domain_hint"]] == [("x", 2), ("y", 1)]
    tie = [("c", n, "s", i, "x") for i, n in enumerate(("bb", "aa", "a!a"))]
    assert canon.canonical(spark.createDataFrame(tie, "type string, name string, sub_id string, position int, domain string")).where("norm = 'aa'").first()["canonical_name"] == "aa"
    words = spark.createDataFrame([("t", "n", ["b", "a"], 0), ("t", "n", ["a", "c"], 1)], "type string, norm string, keywords array<string>, position int")
    assert canon.keywords_union(words).first()["keywords_union"] == ["a", "b", "c"]


@pytest.mark.parametrize(("kps", "want"), [
    ([], "no_kps"), ([None], "unverified"), ([(1, 0), (2, 1)], "strongly_covered"), ([(1, 0), (0, 1)], "covered"), ([(1, 0), (0, 0)], "partial"), ([(0, 0)], "uncovered"), ([(1, 0), None], "unverified"),
])
def test_status(spark, kps, want):
    data = [("s", "k", *(k or (None, None))) for k in kps] or [("s", None, None, None)]
    assert coverage.coverage_status(spark.createDataFrame(data, "sub_id string, name string, n_strong int, n_partial int")).first()["coverage_status"] == want


def test_top_matches(spark):
    data = [("k", "exposition", f"f{i}", s, v, r) for i, (s, v, r) in enumerate([(3, False, 1), (3, True, 9), (1, True, None), (0, True, 0), (1, True, 2)])]
    df = spark.createDataFrame(data, "kp_id string, kind string, fragment_id string, score int, quote_verified boolean, candidate_rank int")
    assert rows(coverage.top_matches(df), "rk", "fragment_id") == [(1, "f1"), (2, "f0"), (3, "f4")]


def test_bm25_is_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(1, 20)))) for i in range(30)]
    queries = [(0, "a a b"), (1, "j"), (2, "zz")]
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t.split()))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for q, qt in queries:
        for d, t in docs:
            tf, dl = Counter(t.split()), len(t.split())
            s = sum((low if idf[w] < 0 else idf[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * dl / avg)) for w in qt.split() if w in tf)
            if s > 0:
                want[q, d] = s
    got = retrieve.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")).collect()
    assert {(r["item_id"], r["doc_id"]): pytest.approx(r["score"]) for r in got} == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, a_rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "q int, d int, b_rank int")
    dom = spark.createDataFrame([(1, 11, False)], "q int, d int, in_domain boolean")
    assert rows(retrieve.fuse({"a": a, "b": b}, "q", "d"), "rank", "d") == [(1, 11), (2, 10), (3, 12)]
    got = retrieve.fuse({"a": a, "b": b}, "q", "d", domains=dom)
    assert rows(got, "d", "final_score") == [(10, 0.01639), (11, round(0.6 * 2 / 62, 5)), (12, 0.01639)] and retrieve.fuse({"a": a}, "q", "d", 1).count() == 1


def test_slots_and_densify(spark):
    sub = "array<struct<problem_id:string,problem:string,solution:string,answer:string,answer_type:string,type_sequence:string>>"
    df = spark.createDataFrame(
        [(0, "p0", "stem", "sol", "", "NV", None, None, None), (1, "p1", "stem", "sol", "a", "NV", None, [], [("x", "q", "s", "a", "EX", None), ("y", "q", "s", None, "EX", None)])],
        f"parent_index int, source_problem_id string, problem string, solution string, answer string, answer_type string, type_sequence string, sub_problems {sub}, problems {sub}",
    )
    assert rows(evalrun.slot_templates(df.withColumn("sub_problems", F.lit(None).cast(sub))), "parent_index", "slot_index", "problem_id", "stem") == [(0, 0, "p0", ""), (1, 0, "x", "stem"), (1, 1, "y", "stem")]
    assert rows(evalrun.missing_answers(df.withColumn("sub_problems", F.lit(None).cast(sub))), "parent_index", "slot_index") == [(0, 0), (1, 1)]
    parents = spark.createDataFrame([(0, 2)], "parent_index int, n_slots int")
    attempts = spark.createDataFrame([(0, 0, 0, ["old", "x"]), (0, 0, 1, ["a", "b"]), (0, 1, 2, ["a"]), (0, 7, 3, ["a", "b"])], "parent_index int, attempt_id int, position int, completions array<string>")
    assert [(r["attempt_id"], r["completions"], r["reused"]) for r in evalrun.densify(parents, attempts, 3).orderBy("attempt_id").collect()] == [(0, ["a", "b"], True), (1, None, False), (2, None, False)]


def test_rollups_and_resume(spark):
    slots = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, True), (1, 1, 0, None), (2, 0, 0, False)], "parent int, attempt int, slot int, correct boolean")
    assert rows(evalrun.parent_results(slots), "parent", "n_attempts", "n_correct", "any_correct") == [(1, 2, 1, 1), (2, 1, 0, 0)]
    assert rows(evalrun.sub_results(slots), "parent", "slot", "any_correct", "first_correct", "n_correct") == [(1, 0, 1, 1, 1), (1, 1, 1, 1, 1), (2, 0, 0, 0, 0)]
    fresh = spark.createDataFrame([("k", None), ("j", "own"), ("m", " ")], "key string, completion string")
    old = spark.createDataFrame([("k", 0, 1, "first"), ("k", 1, 9, "second"), ("k", 0, 2, "later"), ("m", 0, 0, "")], "key string, parent int, attempt int, completion string")
    assert rows(evalrun.resume(fresh, old, ["key"], ["parent", "attempt"]).na.fill("-"), "key", "completion", "resumed") == [("j", "own", False), ("k", "later", True), ("m", "-", False)]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "<think>x</think>"), (1, 3, "user", "r")], "conv_id int, turn int, role string, text string")
    last = evalrun.chat_prefix(turns).orderBy(F.desc("turn")).first()
    assert [tuple(m) for m in last["messages"]] == [("system", "s"), ("user", "q"), ("assistant", "(no answer)"), ("user", "r")]


def test_inventory(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert rows(inventory.count_with_total(df, "k", F.sum("v").alias("s"))) == [("TOTAL", 6), ("a", 3), ("b", 3)]
    assert rows(inventory.percent_of_total(df.groupBy("k").agg(F.sum("v").alias("v")), "v"), "k", "v_pct") == [("a", 50.0), ("b", 50.0)]
    assert rows(inventory.violations(df, "v", small=F.col("v") < 3, never=F.lit(None).cast("boolean")), "v", "rule") == [(1, "never"), (2, "never"), (3, "never"), (3, "small")]
    units = df.select(inventory.judgeable(F.lit("x"), F.lit("nv")).alias("a"), inventory.judgeable(F.lit(" "), F.lit("NV")).alias("b"), inventory.unit_count(F.array()).alias("n")).first()
    assert tuple(units) == (True, False, 1)


MD = """# Chapter 1
# VECTORS
Preamble text.

# 1.1 Balancing forces
Body one.
# Figure 3
Example verb inside.

Example (Block on a plane): A block.
more
# Solution:
It slides.
# Details
tiny
# 2-1 THE EFFECT
Last.
# Problems
never
"""


def test_fragments(spark):
    df = spark.createDataFrame([("c", "b", "ch1", MD)], "path string, book string, chapter string, text string")
    out = chunk.fragments(df).orderBy("idx").collect()
    assert [(r["anchor"], r["kind"], r["section_path"], r["heading"]) for r in out] == [
        ("", "exposition", [], "VECTORS"), ("", "exposition", ["VECTORS"], "VECTORS"), ("1.1", "exposition", ["1.1 Balancing forces"], "1.1 Balancing forces"),
        ("1.1", "example", ["1.1 Balancing forces"], "Example (Block on a plane): A block."), ("1.1", "exposition", ["1.1 Balancing forces", "Details"], "Details"),
        ("2-1", "exposition", ["2-1 THE EFFECT"], "2-1 THE EFFECT")]
    assert out[0]["chapter_title"] == "VECTORS" and "# Figure 3" in out[2]["text_md"] and "It slides." in out[3]["text_md"] and out[3]["example_title"] == "Block on a plane"
    assert out[0]["fragment_id"].startswith("b::ch1::top::000::") and out[2]["fragment_id"].startswith("b::ch1::1p1::002::") and not any("never" in r["text_md"] for r in out)


def test_merge_and_split(spark):
    frags = [("c", i, "1", [], k, None, None, t) for i, (k, t) in enumerate([("exposition", "a" * 300), ("exposition", "b"), ("exposition", "c"), ("example", "d"), ("exposition", "e")])]
    df = spark.createDataFrame(frags, "path string, seq int, anchor string, section_path array<string>, kind string, heading string, example_title string, text string")
    assert [t[0].replace("a" * 300, "A") for t in rows(chunk.merge_tiny(df), "text")] == ["A\n\nb\n\nc", "d", "e"]
    long = "\n\n".join("p%d " % i + "x" * 900 for i in range(9)) + "\n\n" + "Sentence number. " * 500
    one = df.where("seq = 0").withColumn("text", F.lit(long))
    parts = [r["text"] for r in chunk.split_oversize(one).orderBy("idx").collect()]
    assert len(parts) > 4 and all(len(p) <= chunk.MAX_CHARS + chunk.OVERLAP + 2 for p in parts) and parts[1].startswith(parts[0][-400:])
    assert all(f"p{i} " in "".join(parts) for i in range(9))


def test_verification(spark):
    replies = spark.createDataFrame([("k", '{"matches": [{"index": 1, "score": 7, "quote": "nope"}, {"index": 2, "score": "3", "quote": "exactly twenty letters in here"}, {"index": 2, "score": "x"}, {"index": 9, "score": 2}]}'), ("z", "??")], "kp_id string, reply string")
    parsed = verify.parsed_replies(replies)
    assert rows(parsed.where("error IS NOT NULL"), "kp_id") == [("z",)]
    cands = spark.createDataFrame([("k", 1, "text"), ("k", 2, "It is exactly twenty letters in here.")], "kp_id string, index int, text string")
    assert rows(verify.verified_matches(parsed, cands), "index", "score", "score_original", "quote_verified") == [(1, 1, 3, False), (2, 0, 0, False)]


def test_guidance(spark):
    picks = [("s", p, f"k{p}", 2 - p, 0, f, s, r) for p, f, s, r in [(0, "f1", 3, 1), (0, "f2", 2, 2), (0, "f3", 2, 3), (1, "f2", 3, 1), (1, "f4", 2, 2), (2, "f5", 3, 1)]]
    df = spark.createDataFrame(picks, "sub_id string, kp_pos int, kp_id string, n_strong int, n_partial int, fragment_id string, score int, rank int")
    assert rows(guidance.material(df), "kp_rank", "fragment_id") == [(1, "f1"), (1, "f2"), (2, "f4")]
    targets = spark.createDataFrame([("a", 2), ("b", 4), ("b", 4), ("b", 4)], "parent string, parent_sub_count int")
    assert rows(guidance.select_parents(targets, 1, 1), "parent") == [("b",)]


@settings(max_examples=30, deadline=None)
@given(st.integers(8, 30), st.data())
def test_unbiased_is_monotone(n, data):
    c = data.draw(st.integers(0, n - 1))

    def p(c, k):
        out = 1.0
        for i in range(k):
            out *= (n - c - i) / (n - i)
        return 1.0 if n - c < k else 1 - out

    assert 0 <= p(c, 8) <= p(c + 1, 8) <= 1 and p(c, 7) <= p(c, 8)


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(incremental.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")] and rows(incremental.pending(new, old, ["k"]), "k") == [(3,)]
    cache = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "c", 1)], "k int, v string, seq int")
    assert rows(incremental.latest(cache, ["k"]), "v") == [("b",)] and rows(incremental.import_missing(cache, new, ["k"]), "k") == [(2,), (3,)]


def test_file_stream_upserts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    step = incremental.upserting(out, ["k"], lambda df: df.withColumn("v", F.upper("v")))
    for data in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        df = spark.createDataFrame(data, "k int, v string")
        df.coalesce(1).write.mode("append").parquet(src)
        incremental.file_stream(spark, src, df.schema, str(tmp_path / "cp"), step).awaitTermination(60)
    assert rows(incremental.current(spark, out, ["k"]), "k", "v") == [(1, "A"), (2, "C"), (3, "D")]


def test_nesting(spark):
    slots = spark.createDataFrame([(1, 1, 0, True, "a"), (1, 0, 1, None, "c"), (1, 0, 0, True, "b"), (2, 0, 0, False, "d")], "parent_index int, attempt_id int, slot_index int, correctness boolean, completion string")
    nested = evalrun.nest_attempts(slots, ["completion", "correctness"])
    one = nested.where("parent_index = 1").first()["attempts"]
    assert [(a["attempt_id"], a["correctness"], [c["completion"] for c in a["completions"]]) for a in one] == [(0, False, ["b", "c"]), (1, True, ["a"])]
    assert rows(evalrun.flatten_attempts(nested).select("parent_index", "attempt_id", "slot_index", "completion")) == rows(slots.select("parent_index", "attempt_id", "slot_index", "completion"))
    assert rows(evalrun.slot_count_drift(slots), "parent_index") == [(1,)]
    parents = spark.createDataFrame([(1, [("x",)]), (9, [("keep",)])], "parent_index int, sub_problems array<struct<completion:string>>")
    out = evalrun.write_back(parents, slots.where("attempt_id = 0"), ["completion"])
    assert sorted((r["parent_index"], [s["completion"] for s in r["sub_problems"]]) for r in out.collect()) == [(1, ["b", "c"]), (9, ["keep"])]


def test_blocks_and_extremes(spark):
    m = spark.createDataFrame([("k", "exposition", "f1", 3, True, 1), ("k", "example", "f2", 2, True, 1)], "kp_id string, kind string, fragment_id string, score int, quote_verified boolean, candidate_rank int")
    e = spark.createDataFrame([("k", 5), ("z", 9)], "kp_id string, n_sub_problems int")
    out = {r["kp_id"]: r for r in coverage.match_blocks(m, coverage.score_counts(m), e).collect()}
    assert [x["fragment_id"] for x in out["k"]["top_exposition"]] == ["f1"] and [x["fragment_id"] for x in out["k"]["top_example"]] == ["f2"] and out["k"]["verifier_error"] is None
    assert out["z"]["top_exposition"] == [] and out["z"]["verifier_error"] == coverage.NOT_VERIFIED
    scored = e.join(coverage.score_counts(m), "kp_id", "left")
    assert rows(coverage.extremes(scored, True, 5), "kp_id") == [("k",)] and rows(coverage.extremes(scored, False, 5), "kp_id") == [("z",)]


def test_hot_terms_are_split(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the " + " ".join(f"w{(i * k) % 7}" for k in range(5))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the w1 w2"), (2, "w3 the the")], "item_id long, text string")
    scores = lambda: sorted((r["item_id"], r["doc_id"], round(r["score"], 9)) for r in retrieve.bm25(docs, asked).collect())
    plain = scores()
    monkeypatch.setattr(retrieve, "POSTINGS", 10)
    assert scores() == plain


def test_scratch_goes(spark):
    import os

    from loomspan import storage

    with storage.temporary():
        made = storage.materialize(spark.range(3), "x")
        at = made.scratch.removeprefix("file:")
        assert os.path.isdir(at) and made.count() == 3
    assert not os.path.isdir(at) and spark.sparkContext.applicationId in at


def test_requests_in_a_window(spark):
    import random

    rng = random.Random(2)
    calls = [(rng.uniform(-200, 900), rng.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(calls, "ts double, who string")
    for by in (None, "who"):
        got = {(r["ts"], r["who"]): r["n_recent"] for r in incremental.window_requests(df, by=by).collect()}
        assert got == {(t, w): sum(t - 60 <= u <= t and (by is None or v == w) for u, v in calls) for t, w in calls}


def test_products_in_bounded_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    q, d = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (20_000, 4)).astype(float)  # very many ties
    tracemalloc.start()
    row, col, score = map(np.concatenate, zip(*retrieve.top_products(q, d, 7, cells=1 << 17)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = q @ d.T  # 48 MB, and its ranks as much
    best = np.argsort(-whole, axis=1, kind="stable")[:, :7]
    assert most < 12e6 and (row == np.repeat(np.arange(300), 7)).all() and (col == best.ravel()).all() and (score == np.take_along_axis(whole, best, 1).ravel()).all()
    assert [len(x) for x in next(retrieve.top_products(q[:3], d[:5], 7))] == [15, 15, 15]
    monkeypatch.setattr(retrieve, "BLOCK", 4 * 64)  # 64 vectors a block
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d[:500])], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    norm = np.linalg.norm(d[:500], axis=1)
    unit = d[:500] / np.where(norm > 0, norm, 1)[:, None]
    s = np.round(unit[::5] @ unit.T, 9)
    want = {(5 * i, j) for i in range(100) for j in np.lexsort((np.arange(500), -s[i]))[:9].tolist()}
    assert {(r["query_id"], r["vec_id"]) for r in retrieve.dense(df, asked, k=9).collect()} == want


def test_fused_queries_search_once(spark, sf):
    from loomspan.plans import driver_queries

    made = driver_queries.rrf_topk(spark, sf)
    assert "CoGroups" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 30 * spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").count()


def test_best_of_each_task_are_enough(spark, monkeypatch):
    texts = [(i % 90, " ".join(f"w{(i * k) % 7}" for k in range(i % 5 + 1))) for i in range(100)]  # ids 0 to 9 twice
    docs = spark.createDataFrame([*texts, (None, "w1 w2"), (200, None), (201, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w0 w1 w1"), (2, "w3 w0"), (None, "w6"), (3, "absent"), (4, None)], "item_id long, text string")
    best = lambda scores: rows(retrieve.ranked(scores, "item_id", "doc_id", 4, "bm25", 6).withColumn("bm25_score", F.round("bm25_score", 9)).fillna(-1), "item_id", "doc_id", "bm25_score", "bm25_rank")
    whole = best(retrieve.bm25(docs, asked))
    few = retrieve.bm25(docs, asked, k=4, digits=6)
    assert best(few) == whole and len(whole) > 8 and few.count() <= 3 * 4 * few.rdd.getNumPartitions() and "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(retrieve, "CELLS", 7)  # two rows at a time
    assert best(retrieve.bm25(docs, asked, k=4, digits=6)) == whole == best(retrieve.bm25(docs, asked))


def test_redaction_searches_once(spark, sf):
    from loomspan.plans import driver_queries

    made = driver_queries.redacted_docs(spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "xxhash64" not in plan and made.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
