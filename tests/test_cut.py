"""Texts cut in one pass over plain strings, against the Column expressions."""

import random
import re

from pyspark.sql import functions as F

from quillspark.config import NormalizationConfig
from quillspark.functions import text as T
from quillspark.operators import vocab
from quillspark.operators.scorer import KneserNey
from quillspark.session import dense_ids

PARTS = ["One", "two", "x.y", "a_b", "it's", "v1.2", "ＡＢ", "ﬁn", "é", "é", "İstanbul", "ıſ", "K", "„q“", "a—b", "…", "½", "Ω", "ΟΔΟΣ", "?", "!", ".", "--", "3", "​", "😀", "ｶﾞ"]
GAPS = [" ", "  ", "\n", "\r\n", "\r", "\t", "\x0b", "\x0c", "\x1c", "\x1e", "\x1f", "\x85", " ", " ", " ", "　", ". ", "! ", "? ", ".\n", ""]


def odd_texts():
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) + rng.choice(GAPS) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "\n", ". A", "..  B", "a. B. C.\n\nD", "A. B"]


def test_segments_as_by_columns(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE", 500)
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_ord long, text string").coalesce(2)
    for cfg in (NormalizationConfig(), NormalizationConfig(lowercase=False), NormalizationConfig(unicode_nfkc=False), NormalizationConfig(strip_accents=True), NormalizationConfig(split_sentences=False)):
        cut = docs.where("text IS NOT NULL AND text <> ''").select("doc_ord", F.posexplode(T.raw_segments(F.col("text"), cfg)).alias("seg_no", "raw"))
        want = cut.select("doc_ord", "seg_no", T.tokens(F.col("raw"), cfg).alias("tok")).where(F.size("tok") > 0)
        both = [sorted((r["doc_ord"], r["seg_no"], r["tok"]) for r in x.collect()) for x in (T.segments(docs, cfg), want)]
        assert len(both[1]) > 400 and both[0] == both[1]
        counts = [sorted(map(tuple, x.collect())) for x in (vocab.text_counts(docs, cfg), vocab.token_counts(want))]
        assert counts[0] == counts[1]


def test_pairs_as_by_columns(spark, monkeypatch):
    cfg = NormalizationConfig()
    texts = spark.createDataFrame([(t,) for t in odd_texts()], "text string").coalesce(2)
    lines = texts.where("text IS NOT NULL").select(T.tokens(F.col("text"), cfg).alias("tok"))
    for one, other in ((KneserNey.from_texts(texts, cfg), KneserNey.from_lines(lines)),):
        for name in ("unigrams", "bigrams"):
            a, b = (sorted(map(tuple, getattr(x, name).collect())) for x in (one, other))
            assert len(b) > 20 and a == b


def test_stride_prompts_sort_no_lines(spark, monkeypatch):
    """Running totals of lines, block by block, for ids out of order; before, every line went through a range sort."""
    from quillspark.plans import prompts

    monkeypatch.setattr(prompts, "BLOCK", 7)
    sorted_rows = []
    monkeypatch.setattr(prompts, "dense_ids", lambda df, *a: (sorted_rows.append(df.count()), dense_ids(df, *a))[1])
    rng = random.Random(8)
    rows = [((i * 37) % 101, "\n".join(" ".join(rng.choice(["alpha", "be", "it's", "x", "…"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 30)))) for i in range(101)]
    got = [(r["ord"], r["query"]) for r in prompts.stride_prompts(spark.createDataFrame(rows, "doc_id long, text string"), 40).orderBy("ord").collect()]
    words = [w for _, t in sorted(rows) for line in t.split("\n") if len(w := re.findall(prompts.WORD, line.lower())) >= 4]
    stride = max(1, len(words) // 120)
    part = lambda t: t[:1] if len(t) <= 2 else t[: max(2, min(len(t) - 1, -(-len(t) * 6 // 10)))]
    first = {}
    for n in range(0, len(words), stride):
        for k in (1, 2, 3):
            first.setdefault(" ".join([*words[n][:k], part(words[n][k])]), n * 4 + k)
    assert got == sorted((o, q) for q, o in first.items())[:40]
    assert sorted_rows == [sum(any(len(re.findall(prompts.WORD, x.lower())) >= 4 for x in t.split("\n")) for _, t in rows)]


def test_cutting_has_no_lambdas_on_texts(spark):
    """Texts go to Python once, as they are; nothing is split by expressions that Spark can't compile."""
    docs = spark.createDataFrame([(1, "A b. C d")], "doc_ord long, text string")
    plan = T.segments(docs, NormalizationConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "split" not in plan
