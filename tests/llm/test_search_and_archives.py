from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from loomspan.llm import topk_search, warc

VEC = "vec_id long, embedding array<float>"


def vectors(n, dim=8, seed=0, kinds=None):
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(kinds or n, dim)).astype(np.float32)
    return [(int(i), [float(x) for x in pool[i % len(pool)]]) for i in range(n)]


def clustered(n, centres=20, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 50
    return np.floor(middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))).astype(np.int64)


@pytest.mark.parametrize("rows", [
    vectors(230), vectors(300, kinds=7, seed=1), vectors(3), [], [(int(i), [float(c) / 256 for c in v]) for i, v in enumerate(clustered(700))],
    vectors(120, seed=2) + [(500, None), (550, [None] * 8), (600, [float("nan")] * 8), (650, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (700, [0.0] * 8), (750, [1000.0] * 8)],
    vectors(90, seed=3) + [(i, [float(i)] * 3) for i in range(100, 137)] + [(200, []), (201, []), (250, [1.0, 2.0])],
])
def test_topk_is_brute_force(spark, rows):
    for sample in (4096, 20) if len(rows) == 130 else (4096,):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(spark.createDataFrame(rows, VEC), rows_per_block=70, queries_per_block=2, sample=sample).collect())
        assert got == topk_search.brute_force(rows)


def test_repeated_rows_and_clashing_names(spark):
    rows = vectors(60) + vectors(60)[:10]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "'x' AS v", "1 AS d", "2 AS cell", "'y' AS VEC_ID2")
    got = topk_search.top_k(df).collect()
    assert len(got) == 10 and all(r["vec_id"] != r["query_id"] for r in got)


def test_pivots_eliminate_candidates():
    """On clustered vectors the bounds leave little to evaluate; with no pivots all of it."""
    x = clustered(4000)
    p = topk_search.choose_pivots(x)
    d = topk_search.distances(x, p)
    table = topk_search.PivotTable(np.arange(4000), x, d)
    scores = x @ x[7]
    want = sorted(((int(s), i) for i, s in enumerate(scores) if i != 7), key=lambda t: (-t[0], t[1]))[:5]
    assert table.search(7, x[7], d[7], 5) == want and table.evaluated < 1000
    assert topk_search.evaluated_share(x) < 0.3 and topk_search.evaluated_share(x, n_pivots=0) > 0.6
    upper = table.bounds(float(x[7] @ x[7]), d[7])
    assert (upper >= scores).all()


def test_large_components_stay_exact():
    x = np.array([[3_000_000_000, 1], [2_999_999_999, 5]], dtype=np.int64)
    assert topk_search.PivotTable(np.arange(2), x, np.zeros((2, 0))).search(9, np.array([1, 1]), np.zeros(0), 5) == [(3_000_000_004, 1), (3_000_000_001, 0)]


NASTY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ny"
PAGES = [(1, "http://a/1", "p" * 2000), (2, "http://a/2", "p" * 2000), (9, "http://b/\r\nevil", "p" * 2000), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
         (7, "u", NASTY), (8, "u", NASTY * 40), (10, "u", "ends\r\n"), (11, "u", "ends\r"), (12, "u", "\r\n\r\n"), (13, "u", "é" * 700), (14, "u", "\r\n"), (None, "u", "n" * 1500)]


def expected(rows):
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h in last and i != last[h]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    out = warc.archive_digest(df, str(tmp_path / "w"), compress)
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(PAGES)


def test_warc_splits_are_stitched(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "".join(rng.choice(["ab\r\n", NASTY, "c" * 50, "\r\n\r\n"]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, compress=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "5k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read_warc(spark, path, keep_body=True).select(warc.header_field("X-Page-ID").cast("long").alias("i"), "length", "digest", "body").collect()
            assert sorted(r["i"] for r in got) == list(range(150))
            for r in got:
                revisit = r["length"] == 0 and rows[r["i"]][2] != ""
                assert revisit or (bytes(r["body"]).decode() == rows[r["i"]][2] and r["digest"] == hashlib.sha1(rows[r["i"]][2].encode()).hexdigest())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_jumps_decide_what_stays(spark, tmp_path):
    """Plain archives of several segments take several rounds; candidates inside payloads are there, and none stays."""
    rows = [(i, f"http://h/{i}", (NASTY + str(i)) * 30) for i in range(120)]
    rounds = []
    out = warc.archive_digest(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), segment=20_000, rounds=rounds)
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(rows)
    assert len(rounds) > 3 and rounds == sorted(rounds)


def test_warc_empty(spark, tmp_path):
    assert warc.archive_digest(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).collect() == []


def test_pointer_jumping(spark):
    edges = [("f", i * 10, i * 10 + 10) for i in range(33)] + [("f", 15, 20), ("f", 17, 999), ("g", 5, 9)]
    got = {(r["file"], r["at"]) for r in warc.on_chain(spark.createDataFrame(edges, "file string, at long, next long")).collect()}
    assert got == {("f", i * 10) for i in range(33)}
