"""Line dedup, quality rules, SimHash: small fixtures against brute force, and the edge cases."""

from __future__ import annotations

import random

import pytest
import xxhash

from loomspan.llm import components, line_dedup, quality_rules, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)


EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c"), (5, "a b c"), (6, "x " * 60), (None, "a b c"), (7, "Ä é\t\x0b z\r\nq"), (4, "a b c"), (8, "long " * 40_000)]


def random_docs(n=120, seed=1):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("the of and to thon reing ATION ed. ### x").strip() or "w" for _ in range(rng.randint(0, 6))) for _ in range(30)]
    words = "the of and to in thon reing ation ed. ### stion".split()
    return [(i, "\n".join(rng.choice(lines) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("rows", [EDGES, random_docs(), [(i, f"  Same Line \nown {i}\n") for i in range(10)]])
def test_line_dedup_is_brute_force(spark, rows):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.dedup_lines_digest(table(spark, rows)).collect()}
    if len({i for i, _ in rows}) == len(rows):
        assert got == {(i, *v) for i, v in line_dedup.reference_dedup(rows).items()}
    else:
        assert len(line_dedup.dedup_lines_digest(table(spark, rows)).collect()) == len(rows)


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, "same")] * 12 + [(2, "same")]
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(table(spark, rows)).collect()} == {0}
    rows = [(i, "same\nkeep %d" % i) for i in range(10)] + [(0, "same\nkeep 0")]
    out = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(out) == 11 and {r["text"] for r in out} == {f"keep {i}" for i in range(10)}


def test_line_dedup_in_place_keeps_columns(spark):
    rows = [(i, "Dup \nown %d" % i, "en", "s", 9) for i in range(12)] + [(99, None, None, None, None)]
    out = line_dedup.dedup_lines_in_place(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[3] == ("own 3", 5) and got[99] == (None, None)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.dedup_lines_digest(empty).collect() == []
    assert quality_rules.quality_rules(empty).collect() == []
    assert simhash.near_duplicates_digest(empty).collect() == []


def base_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("rows", [EDGES, random_docs(80, 2), [(1, "a b c a b c"), (2, "a a a a"), (3, "q r s t q r s u r s t")]])
def test_quality_base_is_brute_force(spark, rows):
    out = quality_rules.quality_rules(table(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in out) == sorted((str(i), *base_counts(t)) for i, t in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_quality_verdict(spark):
    rng = random.Random(5)
    words = quality_rules.COMMON_WORDS["en"] + [f"w{chr(97 + i)}rd" for i in range(26)]
    clean = [(i, " ".join(rng.choices(words, k=120)), "en") for i in range(40)]
    junk = [(100, " ".join(rng.choice(words) + "###" for _ in range(120)), "en"), (101, " ".join(rng.choice(words).upper() + "$$!" for _ in range(120)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(table(spark, clean + junk)).collect()}
    assert all(got[i] for i, *_ in clean) and not got[100] and not got[101]
    kept = quality_rules.keep_good(table(spark, clean + junk))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in clean}


def test_js_distance_bounds(spark):
    df = spark.sql("SELECT array(1L, 0L, 3L) AS a, array(2L, 0L, 6L, 0L) AS b, array(0L, 5L) AS c, array(0L) AS zero")
    r = df.select(quality_rules.js_distance("a", "b").alias("same"), quality_rules.js_distance("a", "c").alias("apart"), quality_rules.js_distance("a", "zero").alias("none")).first()
    assert abs(r["same"]) < 1e-9 and abs(r["apart"] - 1) < 1e-9 and r["none"] is None


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("max_bucket", [4096, 1])
def test_simhash_is_brute_force(spark, max_bucket):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, t) for i, (_, t) in enumerate(random_docs(40, 9))]
    for g in range(6):
        text = rng.choices(words, k=300)
        for _ in range(8):
            made = list(text)
            made[rng.randrange(300)] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(made)))
    rows += [(5000, None), (5001, "  "), (5002, "A B"), (5003, "a b")]
    out = simhash.near_duplicates(table(spark, rows), max_bucket=max_bucket).collect()
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in out} == fps
    assert {r["doc_id"]: r["component_id"] for r in out} == slow_classes(fps)


def test_simhash_pairs_of_planted_distances(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 2, 3)}
    signed = lambda v: v - 2**64 if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = {frozenset((signed(a), signed(b))) for a in values for b in values if a != b and bin(a ^ b).count("1") <= 2}
    for most in (4096, 1):
        assert {frozenset((r["u"], r["v"])) for r in simhash.near_pairs(fps, most).collect()} == want


def test_keep_first(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "A b c d"), (2, "other words here now"), (9, None), (8, "")]
    out = simhash.keep_first(table(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 8]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)]
    got = {(r["node"], r["root"]) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, "same\nline %d" % i) for i in range(12)]
    df = table(spark, rows).selectExpr("*", "'x' AS fp", "'y' AS component_id", "1 AS n_words", "'z' AS key", "3 AS n_lines", "'q' AS __id", "'t' AS TEXT2")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(df).collect()} == {1}
    assert len(simhash.near_duplicates(df).collect()) == 12 and len(quality_rules.quality_rules(df).collect()) == 12


def test_keep_first_by_class(spark):
    """Classes without ids, and classes that share their smallest id, keep one row each."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "bravo", "carol", "delta"))
    rows = [(None, a), (None, a), (None, b), (1, c), (1, d), (2, c), (3, d)]
    out = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, a), (0, b), (1, c), (1, d)]
