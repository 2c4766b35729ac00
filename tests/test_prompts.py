from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspan.operators import prompts
from loomspan.sources import catalogue


def test_system_text():
    assert prompts.system_text() == prompts.BASE and prompts.system_text(skills=" s ") == "s" and "## PLAYBOOK\n\np" in prompts.system_text("zh", playbook="p")
    with pytest.raises(ValueError):
        prompts.system_text(playbook="p", evolved="e")


def test_conversations(spark):
    rows = [(0, 0, 0, "stem", "q0", None, "<think>t</think>a0"), (0, 0, 1, "stem", "q1", "hint", None), (0, 0, 2, "stem", "q2", None, "a2")]
    df = spark.createDataFrame(rows, "parent_index int, attempt_id int, slot_index int, stem string, problem string, guidance string, completion string")
    last = prompts.conversations(df).where("slot_index = 2").first()["messages"]
    assert [m["role"] for m in last] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert last[1]["content"].endswith("stem\n\nq0") and last[2]["content"] == "a0" and "hint" in last[3]["content"] and last[4]["content"] == prompts.PLACEHOLDER["en"] and last[5]["content"] == "q2"
    assert prompts.earlier_statements(df).where("slot_index = 2").first()["context"] == ["q0", "q1"]


def test_options():
    assert prompts.backend("auto", "a/b") == "local" and prompts.backend("auto", "gpt") == "api" and prompts.backend("api", "a/b") == "api"
    for bad in ({"playbook": 1, "skills": 1}, {"iteration": 1}, {"history": 1, "iteration": 1, "rollouts": 2}):
        with pytest.raises(ValueError):
            prompts.check_options(**bad)
    prompts.check_options(history="h", iteration=3)
    with pytest.raises(ValueError):
        prompts.backend("x", "y")


def test_catalogue(spark):
    df = spark.createDataFrame([(["Oscillations & Waves", "Relativity"],), (["?"],)], "t array<string>").coalesce(1)
    assert [r[0] for r in df.select(catalogue.expected_domains("t")).collect()] == [["classical_mechanics", "special_relativity", "waves_and_oscillations"], []]
    a, b, c = (spark.createDataFrame(r, f"source string, {n} long") for r, n in (([("Georgi_Waves", 5)], "tokens"), ([("Purcell_EM", 2), ("x", 9)], "instr"), ([("x", 1)], "tests")))
    out = catalogue.per_book(a, b, c, catalogue.book_sources(spark)).collect()
    assert [(r["source"], r["sub_discipline"], r["tokens"], r["instr"], r["tests"]) for r in out] == [("Purcell_EM", "Electromagnetism", 0, 2, 0), ("Georgi_Waves", "Waves", 5, 0, 0), ("x", "-", 0, 9, 1)]
    assert df.select(prompts.answer_types(F.lit("TUP"), F.lit("NV,EX"))).first()[0] == "in this order: a number, an expression"
