from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import packing


def test_fill_is_the_fullest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = [int(x) for x in rng.integers(1, 40, rng.integers(1, 9))]
        cap = int(rng.integers(1, 90))
        got = packing.fill(Counter(sizes), cap)
        best = max((sum(c) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= cap), default=0)
        assert sum(s * k for s, k in got.items()) == best
        assert not Counter(got) - Counter(sizes)


def first_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(capacity - s)
        else:
            room[k] -= s
    return len(room)


def test_pack_takes_everything_once():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 257, 500)]
    bins = packing.pack(sizes, 256)
    assert sorted(k for b in bins for k in b) == list(range(500))
    used = [sum(sizes[k] for k in b) for b in bins]
    assert max(used) <= 256 and len(bins) <= first_fit_decreasing(sizes, 256)


def words(n):
    return " ".join(["w"] * n)


def test_bins_of_documents(spark):
    rows = [(k, words(int(n))) for k, n in enumerate(np.random.default_rng(2).integers(1, 60, 150))]
    rows += [(500, words(333)), (501, None), (None, words(4)), (502, ""), (503, "   "), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, used string, id int")
    out = packing.best_fit(df, capacity=100).collect()
    assert len({r["bin"] for r in out}) == len(out)
    got = Counter()
    for r in out:
        assert sum(r["lengths"]) == r["used"] <= 100 and len(r["doc_ids"]) == len(r["starts"]) == len(r["lengths"])
        for d, n in zip(r["doc_ids"], r["lengths"]):
            got[d] += n
    want = Counter()
    for i, t in rows:
        if i is not None and t and t.split():
            want[i] += len(t.split())
    assert got == want
    pieces = sorted((s, n) for r in out for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]) if d == 500)
    assert pieces == [(0, 100), (100, 100), (200, 100), (300, 33)]
    assert packing.best_fit(df.where("false")).count() == 0
    assert packing.best_fit(df, capacity=100, length=F.lit(50)).agg(F.min("used")).first()[0] >= 50
