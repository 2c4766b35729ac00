from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from loomspan.llm import packing

TEXTS = ["don't  STOP it's 3.14, x-y İstanbul ΣΑΣ é́ ﬁ c'll 'S  <|endoftext|> a<|startoftext|>b 日本語, ß!! ÉTÉ... naïve'd \x1c z", "", "  ", "_a_b 12ab ab12 ½ ²",
         "hello,world! (foo) [x]… “q”", "THE!! thonble### a|b | c", "word " * 5000]


def test_encoder_is_the_tokenizer():
    encode = packing.Encoder(packing.tokenizer_path(), limit=20)
    for t in TEXTS * 2:
        assert np.frombuffer(encode(t), "<u4").tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def check_plan(plan, counts, capacity):
    used = defaultdict(int)
    for filling, bins in plan:
        assert sum(filling) <= capacity and bins > 0
        for n in filling:
            used[n] += bins
    assert dict(used) == {n: c for n, c in counts.items() if c}
    return sum(b for _, b in plan)


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_every_piece_and_respect_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 100, 2048])
    counts = defaultdict(int)
    for _ in range(rng.choice([10, 60, 2000])):
        counts[rng.randint(1, capacity)] += 1
    bins = check_plan(packing.plan_bins(dict(counts), capacity), counts, capacity)
    bfd = check_plan(packing.best_fit(dict(counts), capacity), counts, capacity)
    assert packing.lower_bound(counts, capacity) <= bins <= bfd


def test_bin_completion_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 1, 3: 3, 2: 1}  # best fit decreasing needs 4 bins of 10 or more; 31 needs 4
    plan = packing.plan_bins(counts, 10)
    assert check_plan(plan, counts, 10) == packing.lower_bound(counts, 10) == 4
    hard = {7: 1, 6: 1, 5: 1, 4: 1, 3: 2, 2: 1}  # 30 in three bins of 10: 7+3, 6+4, 5+3+2
    assert check_plan(packing.plan_bins(hard, 10), hard, 10) == 3


def brute(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_small_cases_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(2, 12) for _ in range(9)), reverse=True)
    counts = {n: lengths.count(n) for n in lengths}
    assert check_plan(packing.plan_bins(counts, 15), counts, 15) == brute(lengths, 15)


def test_completion_is_optimal_where_best_fit_is_not():
    """All random cases that best fit leaves above the bound are searched to the end, and come out best."""
    rng = random.Random(1)
    met = 0
    while met < 1000:
        capacity = rng.choice([15, 20, 30, 50, 100])
        lengths = [rng.randint(max(1, capacity // 10), capacity * 2 // 3) for _ in range(rng.randint(8, 13))]
        counts = dict(Counter(lengths))
        first, bound = packing.best_fit(counts, capacity), packing.lower_bound(counts, capacity)
        if sum(b for _, b in first) == bound:
            continue
        met += 1
        plan, ended = packing.complete_bins(counts, capacity, first, bound)
        assert ended and check_plan(plan, counts, capacity) == brute(sorted(lengths, reverse=True), capacity)
    counts = dict(Counter([4, 5, 7, 9, 9, 11, 12, 15, 15, 16, 17]))
    assert check_plan(packing.plan_bins(counts, 30), counts, 30) == 4


def all_fillings(largest, counts, capacity):
    """Brute force: every multiset around ``largest`` that no other one dominates in one swap."""
    have = Counter(counts)
    have[largest] -= 1
    found = {()}
    for n in have.elements():
        found |= {tuple(sorted((*f, n), reverse=True)) for f in found if sum(f) + n + largest <= capacity}
    good = []
    for f in found:
        waste = capacity - largest - sum(f)
        left = have - Counter(f)
        swaps = [t for k in range(len(f) + 1) for t in combinations(f, k)]
        if not any(sum(t) <= c <= sum(t) + waste and (c > sum(t) or len(t) > 1) for c in left for t in swaps):
            good.append((largest, *f))
    return sorted(good)


@pytest.mark.parametrize("seed", range(40))
def test_fillings_are_the_undominated_ones(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.randint(2, 14) for _ in range(9)))
    top = max(counts)
    assert sorted(packing.fillings(top, counts, 24, 24)) == all_fillings(top, counts, 24)


def test_the_plan_is_the_completion_s():
    """Also where best fit meets the bound, the plan comes from bin completion."""
    rng = random.Random(3)
    counts = dict(Counter(min(2047, int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(500)))
    first = packing.best_fit(counts, 2048)
    plan = packing.plan_bins(counts, 2048)
    assert plan != first and check_plan(plan, counts, 2048) == packing.lower_bound(counts, 2048)


def test_many_equal_pieces_need_few_groups():
    counts = {n: 10**9 + n for n in range(1, 2048, 7)}
    plan = packing.plan_bins(counts, 2048)
    bins = check_plan(plan, counts, 2048)
    assert len(plan) < 5000 and bins <= packing.lower_bound(counts, 2048) * 1.02


def test_pack_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, None), (0, TEXTS[0]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_documents(docs)
    out = packed.collect()
    tok = packing.Encoder(packing.tokenizer_path()).tokenizer
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    at = defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(at) == packing.lower_bound({n: [r["length"] for r in out].count(n) for n in {r["length"] for r in out}}, 2048)
    ids = {r["sequence_id"]: r["ids"] for r in packing.packed_ids(docs, packed).collect()}
    for r in out:
        assert zlib.crc32(np.array(ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
