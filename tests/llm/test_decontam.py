import re

import numpy as np
import pyarrow as pa

from quillspark.llm import decontam

TOL, LEAST = 0.15, 8


def plain_words(t):
    return re.findall(r"[^\W_]+", t.lower())


def plain_distance(item, doc):
    """Least word edit distance of the item to any run of the document."""
    row = [0] * (len(doc) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(doc):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(600)]
    say = lambda n: list(rng.choice(vocab, n))
    items = [say(int(rng.integers(8, 50))) for _ in range(12)] + [say(5)]
    docs = [say(int(rng.integers(5, 120))) for _ in range(60)]
    for k in range(60):
        if k % 2:
            own = list(items[k % 12])
            for _ in range(int(rng.integers(0, int(len(own) * 0.2) + 2))):
                p = int(rng.integers(len(own)))
                kind = rng.integers(3)
                if kind == 0:
                    own[p] = str(rng.choice(vocab))
                elif kind == 1:
                    own.insert(p, str(rng.choice(vocab)))
                else:
                    own.pop(p)
            at = int(rng.integers(len(docs[k]) + 1))
            docs[k] = docs[k][:at] + own + docs[k][at:]
    return [" ".join(i) for i in items], [", ".join(d).upper() if k % 5 == 0 else " ".join(d) for k, d in enumerate(docs)]


def test_against_brute_force(spark):
    found = wanted = 0
    for seed in range(2):
        items, docs = corpus(seed)
        d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leaks(d, b).collect()}
        want = {}
        for j, i in enumerate(items):
            w = plain_words(i)
            if len(w) >= LEAST:
                for k, t in enumerate(docs):
                    dist = plain_distance(w, plain_words(t))
                    if dist <= int(len(w) * TOL):
                        want[k, j] = dist
        assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
        found, wanted = found + len(got), wanted + len(want)
    assert wanted > 20 and found >= 0.9 * wanted


def test_slices_agree(spark):
    items, docs = corpus(3)
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    pairs = [sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b, slice_rows=n, slice_words=m).collect()) for n, m in ((1000, 10**6), (4, 10**6), (1000, 60))]
    assert len(pairs[0]) > 5 and pairs[0] == pairs[1] == pairs[2]


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (None, "x " + item), (3, "a " * 150_000 + item + " b" * 150_000), (4, item.upper()), (4, item.upper()), (5, "one two three")]
    d = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, item_id string, distance int")
    b = spark.createDataFrame([(7, item), (8, item), (9, None), (10, ""), (11, "short one"), (None, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()), key=str)
    assert got == sorted([(k, i) for k in (None, 3, 4, 4) for i in (7, 8, None)], key=str)
    kept = decontam.drop_leaks(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert decontam.leaks(d.where("false"), b).count() == 0
    assert decontam.leaks(d, b.where("false")).count() == 0 and decontam.drop_leaks(d, b.where("false")).count() == 7


def test_short_items_match_exactly(spark):
    items = ["red fox", "one two three four five", "alpha beta gamma delta epsilon zeta eta", "quokka", "..."]
    docs = ["a RED, fox ran", "red foxes", "zero one two three four five six", "one two three four six", "alpha beta gamma delta epsilon zeta eta", "the quokka", "quokkas", "Quokka", "red", "fox red", ""]
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.leaks(d, b).collect())
    assert got == [(0, 0, 0), (2, 1, 0), (4, 2, 0), (5, 3, 0), (7, 3, 0)]
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(d, b).collect()) == [1, 3, 6, 8, 9, 10]


def test_target_is_held_where_keys_seldom_agree():
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    easy, hard = [say(8) for _ in range(200)], [say(200) for _ in range(3)]
    docs = []
    for k in range(60):
        t = list(hard[k % 3])
        for p in sorted(rng.choice(200, 30, replace=False))[::-1]:
            if p % 2:
                t.pop(p)
            else:
                t.insert(p, "new")
        docs.append(" ".join(say(20) + t + say(20)))
    for rows, most in ((hard, 1), (easy + hard, 64)):
        items = decontam.Items([(k, " ".join(t)) for k, t in enumerate(rows)], TOL, LEAST, 0.97, most=most)
        row, item, _ = items.search(pa.array(docs))
        want = {(k, len(rows) - 3 + k % 3) for k in range(60)}
        assert len(want & set(zip(row.tolist(), item.tolist()))) >= 0.97 * len(want)


def test_very_long_items():
    """Items of thousands of words beside short ones: no table is as wide as the longest for all."""
    rng = np.random.default_rng(9)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    long, short = say(20_000), [say(12) for _ in range(2000)]
    items = decontam.Items([(k, " ".join(t)) for k, t in enumerate([long, *short])], TOL, LEAST, 0.97)
    copy = list(long)
    for p in sorted(rng.choice(20_000, 2500, replace=False))[::-1]:
        copy[p] = "changed"
    row, item, dist = items.search(pa.array([" ".join(say(50) + copy), " ".join(say(30) + short[7] + say(3)), " ".join(long[:9000])]))
    assert list(zip(row.tolist(), item.tolist(), dist.tolist())) == [(0, 0, 2500), (1, 8, 0)]
