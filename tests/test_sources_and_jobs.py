from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.plans import jobs
from loomspan.sources import clients, readers, sinks


def rows(df, *names):
    return sorted(tuple(r[n] for n in names or df.columns) for r in df.collect())


SCHEMA = "id string, n int"


def test_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"id": "z", "n": 3}]}))
    assert rows(readers.read_many(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")], schemas.schema(SCHEMA)).na.fill(0), "source_index", "id", "n") == [(0, "z", 3), (1, "x", 1), (2, "y", 0)]
    (tmp_path / "c.jsonl").write_text('{"id": "p", "n": 1}\n\n  \n{"id": "q", "n": 2}\n')
    df = readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), schemas.schema(SCHEMA))
    assert rows(df) == [("p", 1), ("q", 2)]
    sinks.write_json(df.withColumn("source_index", F.col("n")), str(tmp_path / "out"), ["n"], wrap=True)
    assert rows(readers.read_json(spark, str(tmp_path / "out"), schemas.schema(SCHEMA)), "position", "id") == [(0, "p"), (1, "q")]
    sinks.write_jsonl(df, str(tmp_path / "lines"), ["n"])
    assert rows(readers.read_jsonl(spark, str(tmp_path / "lines"), schemas.schema(SCHEMA))) == rows(df)


def test_parents_schema(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"source": "s", "year": 2020, "problems": [{"problem_id": "1", "answer": "a"}]}]))
    r = readers.read_json(spark, str(tmp_path / "p.json"), schemas.parents()).first()
    assert r["year"] == "2020" and r["problems"][0]["answer"] == "a"


def test_trees(spark, tmp_path):
    for name in ("b1/full.md", "b1/a.md", "b1/ocrfix.md", "b2/z.md", "b2/y.md", "b1/x.pdf", "b3/new.pdf"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("text")
    md, pdf = readers.listing(spark, str(tmp_path), "*.md"), readers.listing(spark, str(tmp_path), "*.pdf")
    assert rows(readers.preferred_markdown(md), "name") == [("full.md",), ("y.md",)] and rows(readers.unparsed_pdfs(pdf, md), "name") == [("new.pdf",)]
    assert rows(readers.books(md, str(tmp_path)), "book") == [("b1",)]
    folders = spark.createDataFrame([("x_solution_manual_by_chapter",), ("x_by_chapter",), ("other",)], "folder string")
    assert rows(readers.resolve_books(folders, spark.createDataFrame([("x", "X")], "book string, display string")), "is_solution_manual", "display") == [(False, "X"), (True, "X")]
    with pytest.raises(ValueError):
        readers.read_config(spark, str(tmp_path), "nope")


def test_bytes_and_history(spark, tmp_path):
    data = [(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),), (bytearray("é".encode("utf-16")),), (None,)]
    assert [r[0] for r in spark.createDataFrame(data, "b binary").coalesce(1).select(readers.decode_bytes("b")).collect()] == ["é", "é", "é", None]
    (tmp_path / "h.jsonl").write_text("\n".join(json.dumps({"iteration": i, "rollouts": 10 * i, "system_prompt": f"p{i}"}) for i in range(3)))
    (tmp_path / "t.txt").write_text(" be kind \n")
    h = readers.prompt_history(spark, str(tmp_path / "h.jsonl"))
    pick = lambda **k: readers.select_prompt(h, **k).first()[0]
    assert pick() == "p2" and pick(iteration=1) == "p1" and pick(rollouts=9) == "p0"
    assert readers.select_prompt(readers.prompt_history(spark, str(tmp_path / "t.txt"))).first()[0] == "be kind"
    with pytest.raises(Exception, match="no prompt"):
        pick(iteration=-1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("c", "y\n")], "book string, text string")
    sinks.write_texts(df, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "text") == [("x\n",), ("y\n",)]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert "| book | text |" in sinks.table_text(df.limit(1), "T") and spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.append_cache(df, str(tmp_path / "k"), 1)


def test_clients(spark):
    sleeps = []
    reply, error = clients.call(clients.StubClient(lambda m: "ok", failures=2), [], sleep=sleeps.append)
    assert (reply, error, sleeps) == ("ok", None, [2.0, 2.0])
    assert clients.call(clients.StubClient(lambda m: ""), [])[1] == "unusable reply"
    now = [0.0]
    window = clients.SlidingWindow(2, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        window.acquire()
    assert now[0] == 120.0
    assert clients.adapt_options({"max_tokens": 5}, "use max_completion_tokens") == {"max_completion_tokens": 5} and clients.adapt_options({"temperature": 1}, "temperature unsupported") == {}
    for code, kind in ((-60018, clients.QuotaError), ("A0202", clients.AuthError), (7, RuntimeError)):
        with pytest.raises(kind):
            clients.check_response(code)
    df = spark.createDataFrame([("p", r"\boxed{1}", r"\boxed{1}", "NV", None), ("p", r"\boxed{a b}", r"\boxed{b a}", "QL", None)], "problem string, pred string, gold string, answer_type string, type_sequence string")
    out = clients.judge_with_fallback(df, lambda: clients.StubClient(lambda m: "## Equivalence Judgement\nTRUE"))
    assert rows(out, "correctness", "rule") == [(True, False), (True, True)]


def test_parse_service(spark):
    class Service:
        def submit(self, names):
            self.names = names
            return "t"

        def state(self, ticket):
            return {n: "failed" if "bad" in n else "running" if "slow" in n else "done" for n in self.names}

        def result(self, ticket, name):
            return "# " + name

    files = spark.createDataFrame([("a.pdf",), ("bad.pdf",), ("slow.pdf",)], "path string").coalesce(1)
    out = clients.parse_pdfs(files, Service, poll=1, timeout=2, sleep=lambda s: None)
    assert {r["path"]: r["state"] for r in out.collect()}["bad.pdf"] == "failed" and out.where("state = 'done'").count() >= 1


def test_guidance_gate(spark):
    df = spark.createDataFrame([([("user", "q")], r"\boxed{42}")], "messages array<struct<role:string,content:string>>, answer string")
    good = clients.gated_guidance(df, lambda: clients.StubClient(lambda m: "### Guidance\nUse energy."), lambda: clients.StubClient(lambda m: "PASS")).first()
    bad = clients.gated_guidance(df, lambda: clients.StubClient(lambda m: r"final answer \boxed{42}"), lambda: clients.StubClient(lambda m: "PASS")).first()
    assert (good["guidance"], good["passed"], good["tries"]) == ("Use energy.", True, 1) and bad["tries"] == 3 and "42" not in bad["guidance"]


def test_job_control(spark, tmp_path):
    calls = []

    def stage(name, f):
        def run(made):
            calls.append(name)
            return f(made)

        return name, run

    job = jobs.Job(spark, str(tmp_path), [stage("one", lambda m: spark.range(3)), stage("two", lambda m: m["one"].where("id > 0"))])
    assert job.run(dry_run=True) == ["one", "two"] and not calls
    assert job.run()["two"].count() == 2 and calls == ["one", "two"] and job.run(start_at="two")["two"].count() == 2 and calls[2:] == ["two"]
    with pytest.raises(ValueError):
        job.run(start_at=9)
    old = spark.createDataFrame([(1, "x"), (2, "err")], "id int, r string")
    out = jobs.resumable(old, spark.createDataFrame([(1,), (2,), (3,)], "id int"), ["id"], lambda df: df.withColumn("r", F.lit("new")), lambda o: o.where("r = 'err'"))
    assert rows(out) == [(1, "x"), (2, "new"), (3, "new")]


def test_coverage_job(spark, tmp_path):
    md = "# 1.1 Energy\n\nEnergy conservation means the total energy stays constant in closed systems.\n"
    others = [(f"o{i}", "b", f"o{i}", f"# 1.{i} Other\n\nPlain words number {i} about nothing in particular here.\n") for i in range(4)]
    chapters = spark.createDataFrame([("c", "b", "ch", md), *others], "path string, book string, chapter string, text string")
    subs = spark.createDataFrame([("s1", "A ball", "use energy", "mech"), ("s2", "A cart", "use energy", "mech"), ("s3", "x", "y", "z")], "sub_id string, problem string, solution string, domain string")

    def extract(m):
        return "{}" if "x\n\ny" in m[0]["content"] else '{"knowledge_points": [{"type": "concept", "name": "energy conservation", "description": "d", "keywords": ["energy"]}]}'

    def check(m):
        return '{"matches": [{"index": 1, "score": 3, "quote": "total energy stays constant in closed systems"}]}'

    made = jobs.coverage_job(spark, str(tmp_path), chapters, subs, lambda: clients.StubClient(extract), lambda: clients.StubClient(check)).run()
    assert rows(made["covered"], "sub_id", "coverage_status") == [("s1", "strongly_covered"), ("s2", "strongly_covered"), ("s3", "no_kps")]


def test_coverage_job_asks_once_and_uses_both_channels(spark, tmp_path):
    """Calls are counted in files: a second run makes none; a match that no word finds comes from the dense channel."""
    calls = tmp_path / "calls"
    calls.mkdir()
    chapters = spark.createDataFrame([("c", "b", "ch", "# 1.1 Force\n\nKraft ist Masse mal Beschleunigung in allen Systemen der Mechanik hier.\n"),
                                      ("o", "w", "o", "# 1.2 Other\n\nPlain words about nothing in particular here at all, really.\n")], "path string, book string, chapter string, text string")
    subs = spark.createDataFrame([("s1", "A ball", "use it", "mech")], "sub_id string, problem string, solution string, domain string")
    domains = spark.createDataFrame([("b", "mech"), ("w", "optics")], "book string, domain string")

    def counting(reply):
        def said(messages):
            (calls / str(time.time_ns())).touch()
            return reply

        return said

    points = '{"knowledge_points": [{"type": "concept", "name": "newton", "description": "second", "keywords": ["zzz"]}]}'
    matches = '{"matches": [{"index": 1, "score": 3, "quote": "Masse mal Beschleunigung in allen Systemen"}]}'

    def embed():
        def run(texts):
            (calls / str(time.time_ns())).touch()
            return [[1.0, 0.0] if "newton" in t or "kraft" in t.lower() else [0.0, 1.0] for t in texts]

        return run

    for dense in (embed, None):
        root = str(tmp_path / str(dense is None))
        job = jobs.coverage_job(spark, root, chapters, subs, lambda: clients.StubClient(counting(points)), lambda: clients.StubClient(counting(matches)), dense, domains)
        made = job.run()
        assert rows(made["covered"], "coverage_status") == ([("strongly_covered",)] if dense else [("unverified",)])
        if dense:
            found = {r["book"]: (r["in_domain"], r["rank"]) for r in made["candidates"].collect()}
            assert found["b"] == (True, 1) and found["w"] == (False, 2)
            before = len(list(calls.iterdir()))
            assert before >= 3 and rows(job.run()["covered"], "coverage_status") == [("strongly_covered",)]
            assert len(list(calls.iterdir())) == before


def test_budget_holds_over_tasks(spark):
    df = spark.range(20).withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")))).repartition(8)
    out = clients.complete(df, lambda: clients.StubClient(lambda m: "x"), per_minute=40, tasks=3)
    assert out.rdd.getNumPartitions() == 3 and out.where("reply = 'x'").count() == 20


def test_reports_are_whole(spark):
    assert sinks.table_text(spark.range(3)).count("\n") == 5
    with pytest.raises(ValueError):
        sinks.table_text(spark.range(3), most=2)


def test_corpus_job(spark, tmp_path):
    p = tmp_path / "in" / "bookA" / "full.md"
    p.parent.mkdir(parents=True)
    passage = " ".join(f"word{i}" for i in range(20))
    p.write_text(f"Intro text.\n\nOCR result should be empty\n\nBefore {passage} after Coloumb.")
    items = spark.createDataFrame([("bookA", "i1", passage)], "source string, item_id string, problem string")
    made = jobs.corpus_job(spark, str(tmp_path / "out"), str(tmp_path / "in"), items, ["problem"]).run()
    assert made["redacted"].first()["text"] == "Intro text.\n\nBefore [REDACTED] after Coulomb."


def test_sidecars_and_tokens(spark, tmp_path):
    from loomspan.functions import text as T

    assert sinks.run_name("org/Model 8B", "data/set.json", "playbook", iteration=3, rollouts=None) == "Model-8B_set_playbook_iteration3"
    sinks.write_sidecar(spark, str(tmp_path / "meta"), {"b": 1, "a": "é"})
    assert spark.read.text(str(tmp_path / "meta")).first()[0] == '{"a": "é", "b": 1}'
    df = spark.createDataFrame([("a" * 9,), (None,)], "t string")
    assert [r[0] for r in df.select(T.count_tokens("t")).collect()][0] == 2
