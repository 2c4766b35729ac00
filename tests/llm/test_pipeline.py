from __future__ import annotations

import pytest

from loomspan.llm import line_dedup, packing, quality_mil, quality_rules, simhash


def test_stages_act_on_what_was_kept(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    for before, after in zip(kept, kept[1:]):
        assert set(after) <= set(before)
    good, ruled, lined, single = kept[1:]
    tables = [spark.createDataFrame([(i, t) for i, t in k.items()], "doc_id long, text string") for k in (ruled, lined)]
    assert lined.keys() == ruled.keys()
    want = line_dedup.reference_dedup(list(ruled.items()))
    import hashlib

    assert all(hashlib.sha256(lined[i].encode()).hexdigest() == want[i][2] for i in lined)
    classes = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(tables[1]).collect()}
    assert single.keys() == {i for i, c in classes.items() if i == c}
    assert {r["doc_id"] for r in docs.collect()} == single.keys() and docs.where("piece = 0").count() == len(single)
    assert len(good) < len(kept[0]) and packing and quality_mil and quality_rules


def test_run_is_the_stages(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 0


ODD = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "a b c", None), (None, "a b c", "xx"), (3, "long " * 30_000, "de"), (4, "the of and to in " * 30, "en"), (4, "the of and to in " * 30, "en")]


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_odd_tables(spark, sf, stage):
    """Nulls, empty and long texts, repeated rows, clashing column names, and no rows at all."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    extra = ["'T' AS TEXT", "1 AS __fp", "'i' AS __id", "'d' AS __drop", "2 AS __row", "3 AS __c0", "4 AS fp", "5 AS n_words", "6 AS kept", "7 AS root", "'k' AS key", "8 AS Doc_Id"]
    clashing = docs.selectExpr("*", *extra)
    plain = sorted(map(str, (tuple(r) for r in run(spark, docs, sf).collect())))
    out = run(spark, clashing, sf)
    assert out.columns == clashing.columns
    rows = [tuple(r) for r in out.collect()]
    assert sorted(str(r[:3]) for r in rows) == plain and all(r[3:] == ("T", 1, "i", "d", 2, 3, 4, 5, 6, 7, "k", 8) for r in rows)
    assert run(spark, clashing.limit(0), sf).collect() == []
    texts = sorted(str(r[0]) + str(r[1])[:9] for r in rows)
    if name == "line_dedup":
        assert len(rows) == len(ODD) and sum(r[1] is None for r in rows) == 1
    if name == "simhash_near_dedup":
        assert texts == ["1", "2a b c", "3long long", "4the of an"]
    if name == "quality_rules":
        assert rows == []  # all are short or repeat themselves


def test_last_stage_takes_odd_tables(spark, sf):
    import corpus_pipeline

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").selectExpr("*", "'T' AS TEXT", "1 AS piece", "2 AS length", "3 AS __salt")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r["piece"] == 0 for r in out) == len(ODD)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).collect() == []


def test_workers_drop_what_packing_learned(spark):
    """Workers outlive a stage: the tokenizer's words must not stay beside what the next one needs."""
    from loomspan.llm.common import map_batches, map_rows

    docs = spark.range(64).selectExpr("id AS doc_id", "concat('word', id) AS text").repartition(8)

    def held():
        import gc
        import time

        time.sleep(0.3)  # so that all workers take part
        return sum(type(x).__name__ == "Encoder" for x in gc.get_objects())

    def by_row():
        n = held()
        return lambda doc_id: [(n,)]

    def by_batch():
        import pyarrow as pa

        n = held()
        return lambda batch: pa.record_batch([pa.array([n] * len(batch), pa.int64())], ["doc_id"])

    for probe in (lambda: map_rows(docs.select("doc_id"), "n long", by_row, 1), lambda: map_batches(docs.select("doc_id"), by_batch)):
        assert packing.pieces(docs).count() == 64
        assert {r[0] for r in probe().collect()} == {0}


def test_tasks_of_one_worker_share_the_encoder():
    from loomspan.llm.common import fresh

    path = packing.tokenizer_path()
    first = packing.shared_encoder(path)
    assert packing.shared_encoder(path) is first
    fresh()
    assert packing.shared_encoder(path) is not first
    fresh()
