from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import lm
from quillspark.llm.kernel import words


def corpus(n=120, seed=0):
    rng = np.random.default_rng(seed)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(1, 7))) for _ in range(400)])
    p = 1 / np.arange(1, len(vocab) + 1)
    return [" ".join(rng.choice(vocab, rng.integers(1, 80), p=p / p.sum())) for _ in range(n)]


def exact(texts, order=2, weight=0.8, discount=0.75, floor=0.05):
    """The same model with exact look-ups of the quantised counts."""
    seq = [t.split() for t in texts]
    runs = [Counter(tuple(["<s>"] * n + s)[i : i + n + 1] for s in seq for i in range(len(s))) for n in range(order)]
    level = lambda c: int(np.floor(np.log2(c))) + 1

    def means(counts):
        sums, n = Counter(), Counter()
        for c in counts.values():
            sums[level(c)] += c
            n[level(c)] += 1
        return {q: sums[q] / n[q] for q in n}

    mean = [means(c) for c in runs]
    count = lambda n, g: mean[n][level(runs[n][g])]
    tokens, starts = sum(runs[0].values()), sum(bool(s) for s in seq)
    out = []
    for s in seq:
        total = 0.0
        for i, w in enumerate(s):
            p = (1 - floor) * count(0, (w,)) / tokens + floor / len(runs[0])
            for n in range(1, order):
                g = tuple(["<s>"] * n + s)[i : i + n + 1]
                context = count(n - 1, g[:-1]) if i else starts
                p = weight * min(1.0, max(0.0, count(n, g) - discount) / context) + (1 - weight) * p
            total += np.log2(p)
        out.append((len(s), total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_exact_counts(spark, order):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(df, order=order).collect()}
    want = exact(texts, order)
    off = []
    for k, (n, total) in enumerate(want):
        assert got[k]["tokens"] == n
        off.append(abs(got[k]["log2_prob"] - total) / n)
    assert np.mean(off) < 0.1 and len(got) == len(texts)  # bits a word: false positives only


def test_looking_up_by_shuffle_agrees_with_broadcast(spark):
    df = spark.createDataFrame(list(enumerate([*corpus(60), "", "zz qq", None])), "doc_id long, text string")
    for order in (2, 3):
        one = sorted(map(tuple, lm.score(df, order=order).collect()), key=str)
        many = sorted(map(tuple, lm.score(df, most_bytes=0, order=order).collect()), key=str)
        assert one == many and len(one) == 63
    assert lm.score(df.where("false"), most_bytes=-1).count() == 0


def test_texts_wait_compressed_while_look_ups_are_shuffled(spark, monkeypatch):
    """Rows of a batch's plain texts took more of an executor's memory than it has, at gigabytes of input."""
    held = {}
    monkeypatch.setattr(lm, "written", lambda df, name, own=lm.written: held.setdefault(name, own(df, name)))
    texts = [" ".join(corpus(40, k)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm.score(df, most_bytes=0).count() == 60
    kept = held["lm-batches"]
    assert [t for _, t in kept.dtypes] == ["bigint", "binary"]
    assert kept.selectExpr("sum(length(held))").first()[0] < 0.7 * sum(map(len, texts))


def test_repeated_texts_are_told_apart(spark):
    texts = corpus(200, 3)
    texts += texts[:50]
    got = {r["doc_id"]: r["perplexity"] for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    long = [k for k, t in enumerate(texts) if len(t.split()) > 20]
    twice, once = [got[k] for k in long if k < 50], [got[k] for k in long if 50 <= k < 200]
    assert np.quantile(twice, 0.9) < np.quantile(once, 0.1)


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 48, 3000).astype(np.uint64))
    c = rng.integers(1, 500, len(h))
    for bits in (8, 12):
        parts = []
        for bucket, a, z, block in lm._blocks(h, bits):
            batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bucket], pa.int32()), pa.array([[block + c[a:z].astype("<u4").tobytes()]], pa.list_(pa.binary()))], names=["n", "bucket", "blocks"])
            parts.append(next(lm._build(iter([batch]))))
        held = lm.Filter(pa.Table.from_batches(parts), bits)
        got, want = held.levels(h, 0).astype(int), lm.level(c)
        assert (got >= want).all() and (got == want).mean() > 0.9
        absent = rng.integers(0, 1 << 48, 20_000).astype(np.uint64)
        assert (held.levels(absent, 0) > 0).mean() < 0.05


def test_pairs_do_not_cross_documents():
    a = next(words(pa.array(["x y", "z"])))
    b = next(words(pa.array(["z"])))
    assert lm.grams(a)[1][2] == lm.grams(b)[1][0]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "w " * 120_000)]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, tokens int, perplexity string")
    out = lm.score(df).collect()
    assert len(out) == 7
    by = {r["doc_id"]: r for r in out}
    assert all(by[k]["tokens"] == 0 and by[k]["log2_prob"] is None and by[k]["perplexity"] is None for k in (1, 2, 3))
    assert by[None]["log2_prob"] == by[4]["log2_prob"] < 0 and by[5]["tokens"] == 120_000
    assert lm.score(df.where("false")).count() == 0
