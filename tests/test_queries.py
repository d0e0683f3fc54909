"""Every query with SQL against DuckDB on the smallest tables, and parts against plain Python."""

import os
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.config import NormalizationConfig
from quillspark.functions import text as T
from quillspark.operators import fuzzy, vocab
from quillspark.operators.beam import collapse
from quillspark.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        f = Path(SF) / f"{t}.parquet"
        if f.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f if f.is_file() else str(f) + '/*.parquet'}')")
    return con


def rows_of(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    mine, its = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(its.columns)
    assert rows_of(mine) == rows_of(its)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


GOLDEN = {
    "We're at version 3.5 today.": "we're at version 3.5 today",
    "Email dev@example.com about src/app.py and build_runner-v2.": "email dev@example.com about src/app.py and build_runner-v2",
    "“Build”—it’s live…": "build it's live",
    "Ａpple  BUILD": "apple build",
    "Hello, build-it!": "hello build-it",
}


def test_normalisation(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", T.normalize_text(F.col("t"), NormalizationConfig()).alias("n")).collect()}
    assert got == GOLDEN


def plain_distance(a, b):
    """Unrestricted Damerau-Levenshtein."""
    last, inf = {}, len(a) + len(b)
    d = {(-1, -1): inf}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edit_distance(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(1500)] + [("ca", "abc"), ("biuld", "build"), ("", ""), ("ab", "ba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", fuzzy.edit_distance(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(fuzzy.deletions(F.col("a"), F.lit(2)), fuzzy.deletions(F.col("b"), F.lit(2))).alias("meet")).collect()
    for r in out:
        want = plain_distance(r["a"], r["b"])
        assert r["d"] == min(want, 3), (r["a"], r["b"], want, r["d"])
        assert r["meet"] or want > 2


def test_matches_against_plain_distance(spark):
    """Deletions from the first letters alone lose no match, short or long."""
    import random

    from quillspark.config import SuggestConfig

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 13)))
    prefixes = sorted({word() for _ in range(250)})
    changed = lambda w: "".join(rng.choice(["", c, c, c, c, c + "a", "d"]) for c in w)
    fragments = sorted({changed(rng.choice(prefixes)) for _ in range(120)} | {"biuld"} - {""})
    post = spark.createDataFrame([(p, 1) for p in prefixes], "prefix string, rank int")
    got = {(r["fragment"], r["matched"], r["dist"]) for r in fuzzy.match_prefixes(spark.createDataFrame([(f,) for f in fragments], "fragment string"), post, SuggestConfig()).collect()}
    want = set()
    for f in fragments:
        most = 0 if len(f) < 3 else 1 if len(f) < 6 else 2
        want |= {(f, f, 0)} if f in prefixes else {(f, p, d) for p in prefixes if 0 < (d := plain_distance(f, p)) <= most}
    assert got == want and sum(d == 2 for _, _, d in want) > 20


def fold(items):
    kept = []
    for w in items:
        if not any(w != k and (w[: len(k)] == k or k[: len(w)] == w) for k in kept):
            kept.append(w)
    return kept


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=3), min_size=1, max_size=7, unique_by=tuple))
def test_ladders(spark, items):
    df = spark.createDataFrame([(1, w, " ".join(w), float(-i)) for i, w in enumerate(items)], "prompt_id long, words array<string>, suggestion string, score double")
    got = [r["words"] for r in collapse(df, "best", 99).orderBy(F.col("score").desc()).collect()]
    assert got == fold(items)


def test_encoding_paths_agree(spark):
    seg = spark.createDataFrame([(0, 0, ["a", "b", "a"]), (0, 1, ["x"]), (1, 0, ["b", "x", "a"])], "doc_ord long, seg_no int, tok array<string>")
    voc = spark.createDataFrame([(0, "a"), (1, "b")], "token_id int, token string")
    both = [sorted(map(tuple, vocab.encode_segments(seg, voc, 2, limit).select("doc_ord", "seg_no", F.array_join("ids", " ")).collect())) for limit in (10, 0)]
    assert both[0] == both[1] == [(0, 0, "0 1 0"), (1, 0, "1 0")]
