from __future__ import annotations

import pytest

from loomspan import cli
from loomspan.operators import slices


def test_positions_and_slices(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x" * i) for i in range(101)], "k long, t string").repartition(5)
    placed = {r["k"]: r["index"] for r in slices.positions(df, "k").collect()}
    assert placed == {k: k for k in range(101)}
    keys = lambda d: sorted(r["k"] for r in d.collect())
    assert keys(slices.sliced(df, ["k"], 3, 6)) == [3, 4, 5] and keys(slices.sliced(df, ["k"], 10, limit=2)) == [10, 11]
    assert keys(slices.sliced(df, ["k"], indices=[0, 100, 500])) == [0, 100] and slices.sliced(df.limit(0), ["k"], 0, 5).collect() == []
    with pytest.raises(ValueError):
        slices.sliced(df, ["k"], -1)


def test_values_and_snippets(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "book string")
    assert [r[0] for r in slices.distinct_sorted(df, "book").collect()] == ["a", "b"]
    out = spark.createDataFrame([("y" * 300,), (None,)], "t string").select(slices.snippet("t"), slices.snippet("t", "quote")).collect()
    assert [tuple(map(len, r)) for r in out] == [(240, 200), (0, 0)]


def test_commands(spark, tmp_path, capsys):
    source = tmp_path / "in" / "b"
    source.mkdir(parents=True)
    passage = " ".join(f"word{i}" for i in range(20))
    (source / "full.md").write_text(f"Coloumb\n\n{passage} end")
    items = spark.createDataFrame([(1, passage), (2, "other words")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "items"))
    assert cli.main(["clean", str(tmp_path / "in"), "--out", str(tmp_path / "clean")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "clean")).first()["text"].startswith("Coulomb")
    for extra, hit in ((["--end", "1"], True), (["--indices", "1"], False)):
        assert cli.main(["redact", str(tmp_path / "in"), "--items", str(tmp_path / "items"), "--out", str(tmp_path / "red"), *extra], spark) == 0
        assert ("[REDACTED]" in spark.read.parquet(str(tmp_path / "red")).first()["text"]) == hit
    spark.createDataFrame([("i", s, s == 0) for s in range(16)], "item string, slot int, correct boolean").write.parquet(str(tmp_path / "att"))
    assert cli.main(["passk", str(tmp_path / "att"), "--group", "8"], spark) == 0 and "| 1   |" in capsys.readouterr().out
    assert cli.main(["passk", str(tmp_path / "att"), "--dry-run"]) == 0 and "passk" in capsys.readouterr().out
