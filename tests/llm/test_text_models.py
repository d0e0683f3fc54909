import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import quality, toxicity
from quillspark.llm.kernel import hash_words, words
from quillspark.llm.trees import fit_boosted, fit_isotonic

SF = "/root/testdata/sf0.1"


def held_out(spark):
    """Labelled documents apart from every fourth, and that fourth."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0").dropDuplicates(["doc_id"])


def test_kernel_words():
    texts = ["Hello, Wörld a-b", "", None, "x", "ÀÉ é"]
    out = {}
    for w in words(pa.array(texts, pa.string()), 8):
        for s, e, d in zip(w.start, w.end, w.doc):
            out.setdefault(w.lo + d, []).append(w.low[s:e].tobytes().decode())
    assert out == {0: ["hello", "wörld", "a", "b"], 3: ["x"], 4: ["àé", "é"]}
    assert hash_words(["Hello"])[0] == hash_words(["hello"])[0] != hash_words(["hell"])[0]


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    raw = fit_boosted(x[:1500], y[:1500], 40).raw(x[1500:])
    assert ((raw > 0) == (y[1500:] > 0)).mean() > 0.95
    iso = fit_isotonic(raw, y[1500:])
    grid = iso(np.linspace(-5, 5, 50))
    assert (np.diff(grid) >= 0).all() and grid[0] < 0.2 and grid[-1] > 0.8
    assert (fit_boosted(x, np.zeros(2000)).raw(x) < 0).all()


def test_toxicity_on_held_out_labels(spark):
    docs, train, test = held_out(spark)
    model = toxicity.fit_toxicity(spark, docs, train)
    got = toxicity.toxicity(docs, model).join(test.select("doc_id", test.toxic.alias("label")), "doc_id").toPandas()
    bad = got.label == 1
    assert got.toxic[bad].mean() >= 0.85 and got.toxic[~bad].mean() <= 0.02


def test_quality_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs, train, test = held_out(spark)
    model = quality.fit_ordinal(docs, train, F.expr(quality.GRADE))
    assert (np.diff(model.cuts) > 0).all()
    got = quality.quality(docs, model).join(test.select("doc_id", test.quality.alias("label")), "doc_id").toPandas()
    good = got.label == 1
    assert got.keep[good].mean() >= 0.97 and got.keep[~good].mean() <= 0.1
    assert got.expected_grade.between(0, 2).all() and got.tail_probability.between(0, 1).all()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (None, "you idiot you stupid moron " * 5), (3, "word " * 200_000), (4, "fine text here"), (4, "fine text here"), (5, "... !!! ???")]
    return spark.createDataFrame([(i, t, 1.0, "z", True) for i, t in rows], "doc_id long, text string, toxicity double, keep string, toxic boolean")


def test_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    tox = toxicity.fit_toxicity(spark, docs, labels)
    out = toxicity.toxicity(odd, tox).collect()
    assert len(out) == 7 and [r["toxic"] for r in out if r["doc_id"] in (1, 2, 5)] == [False] * 3
    assert len({(r["toxicity"], r["toxic"]) for r in out if r["doc_id"] == 4}) == 1
    kept = toxicity.drop_toxic(odd, tox)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2, 5)").count() == 3
    assert toxicity.toxicity(odd.where("false"), tox).count() == 0 and toxicity.drop_toxic(odd.where("false"), tox).count() == 0
    none = toxicity.fit_toxicity(spark, docs, labels.where("false"))
    assert toxicity.toxicity(odd, none).where("toxic").count() == 0

    q = quality.fit_ordinal(docs, labels, F.expr(quality.GRADE))
    out = quality.quality(odd, q).collect()
    assert len(out) == 7 and len({r["tail_probability"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert quality.keep_good(odd, q).columns == odd.columns and quality.keep_good(odd.where("false"), q).count() == 0
    one = quality.fit_ordinal(docs, labels.where("quality = 1 AND toxic = 0"), F.expr(quality.GRADE))
    assert quality.keep_good(odd, one).count() == 7 and quality.quality(odd, one).where("keep").count() == 7
    unlabelled = quality.fit_ordinal(docs, labels.where("false"), F.expr(quality.GRADE))
    assert quality.keep_good(odd, unlabelled).count() == 7 and quality.quality(odd, unlabelled).count() == 7


def test_ordinal_likelihood_by_hand():
    """The likelihood as written down, and its gradients by finite differences."""
    import math

    rng = np.random.default_rng(4)
    n, size, k = 30, 12, 4
    x = rng.random((n, size)) * (rng.random((n, size)) < 0.4)
    y, w, theta, balance = rng.integers(0, k, n), rng.normal(size=size), rng.normal(size=k - 1), rng.random(n) + 0.5
    row, f = np.nonzero(x)

    def plain(w, theta):
        cuts = [theta[0]]
        for gap in theta[1:]:
            cuts.append(cuts[-1] + math.exp(gap))
        tail = lambda s, j: 1.0 if j == 0 else 0.0 if j == k else 1 / (1 + math.exp(cuts[j - 1] - s))
        return -sum(b * math.log(tail(float(r @ w), g) - tail(float(r @ w), g + 1)) for r, g, b in zip(x, y, balance)) / n

    loss, gw, gt = quality.gradient(w, theta, f, x[row, f], row, y, balance)
    assert abs(loss - plain(w, theta)) < 1e-9
    step = 1e-6
    for g, at in ((gw, w), (gt, theta)):
        for j in range(len(at)):
            up, down = at.copy(), at.copy()
            up[j], down[j] = up[j] + step, down[j] - step
            a, b = ((u, theta) if at is w else (w, u) for u in (up, down))
            assert abs(g[j] - (plain(*a) - plain(*b)) / (2 * step)) < 1e-5


def test_marks_of_repetition():
    texts = ["word " * 40, " ".join(f"w{k}" for k in range(40)), "a b c\n" * 10, "", "one"]
    got = np.concatenate([quality.marks(w) for w in words(pa.array(texts))]) - (1 << quality.BITS) - np.arange(quality.MARKS) * quality.LEVELS
    top = quality.LEVELS - 1
    assert got[1, 0] == got[1, 1] == top and got[1, 2] == got[1, 4] == 0
    assert got[0, 0] < 4 and got[0, 1] < 4 and got[0, 2] == top and got[0, 3] == top
    assert got[2, 4] == top and got[2, 2] == 0
    assert (got[3] == 0).all() and got[4, 0] == top


def test_isotonic_against_brute_force():
    """Pool-adjacent-violators against the minimax formula of isotonic regression."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        raw = rng.integers(0, 9, 14).astype(float)
        y = rng.integers(0, 2, 14).astype(float)
        u = np.unique(raw)
        weight, mean = np.array([(raw == v).sum() for v in u]), np.array([y[raw == v].mean() for v in u])
        average = lambda i, j: (weight[i : j + 1] @ mean[i : j + 1]) / weight[i : j + 1].sum()
        want = [max(min(average(i, j) for j in range(k, len(u))) for i in range(k + 1)) for k in range(len(u))]
        assert np.allclose(fit_isotonic(raw, y)(u), want)


def test_first_split_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(10):
        x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
        p = y.mean()
        g, h = y - p, np.full(60, p * (1 - p))
        gain = lambda left: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
        best = max(gain(x[:, j] <= c) for j in range(3) for c in np.unique(x[:, j])[:-1] if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 1)
        m = fit_boosted(x, y, trees=1, depth=1)
        assert abs(gain(x[:, m.feature[0][0]] <= m.cut[0][0]) - best) < 1e-9


def test_toxicity_without_seed_words(spark, monkeypatch):
    """The lexicon is learned: the words written by hand may be none."""
    monkeypatch.setattr(toxicity, "SEEDS", [])
    docs, train, test = held_out(spark)
    got = toxicity.toxicity(docs, toxicity.fit_toxicity(spark, docs, train)).join(test.select("doc_id", test.toxic.alias("label")), "doc_id").toPandas()
    bad = got.label == 1
    assert got.toxic[bad].mean() >= 0.85 and got.toxic[~bad].mean() <= 0.02


def test_repeated_rows_are_learned_from_once(spark):
    """A table whose ids stand several times gives the sample, and the models, of the table without repeats."""
    from pyspark.sql import functions as F

    from quillspark.llm.work import labelled
    from quillspark.session import scratch

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    often = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    with scratch(spark):
        for sample in (100, 10_000):
            once, many = (sorted(map(tuple, labelled(spark, d, labels, sample).collect())) for d in (docs, often))
            assert once == many and len(once) <= sample
        texts = often.withColumn("text", F.concat_ws(" ", "text", F.col("k").cast("string")))  # one id, five texts
        got = labelled(spark, texts, labels, 100).collect()
        assert len(got) == len({(r["doc_id"], r["text"]) for r in got}) == 100
    a, b = (quality.fit_ordinal(d, labels, F.expr(quality.GRADE)) for d in (docs, often))
    assert (a.weight == b.weight).all() and (a.cuts == b.cuts).all()
    a, b = (toxicity.fit_toxicity(spark, d, labels) for d in (docs, often))
    assert (a.lexicon.hash == b.lexicon.hash).all() and (a.lexicon.weight == b.lexicon.weight).all()
    assert (a.calibration(a.trees.raw(np.eye(len(toxicity.FEATURES)))) == b.calibration(b.trees.raw(np.eye(len(toxicity.FEATURES))))).all()


def test_quality_sample_beyond_memory(spark, monkeypatch):
    """Features that wait in a file and come in slices give the model that all of them at once give."""
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.repeat("text", 50)))  # one text alone is beyond the room
    want = quality.fit_ordinal(docs, labels, F.expr(quality.GRADE), steps=60)
    monkeypatch.setattr(quality, "ROOM", 900)
    monkeypatch.setattr(quality, "SLICE", 1 << 16)
    got = quality.fit_ordinal(docs, labels, F.expr(quality.GRADE), steps=60)
    assert np.abs(want.weight).max() > 0.1 and np.allclose(got.weight, want.weight, atol=1e-9) and np.allclose(got.cuts, want.cuts, atol=1e-9)
