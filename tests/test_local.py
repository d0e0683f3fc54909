"""The driver's server against the joins, prompt by prompt, under many settings; and parts of both in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.config import BuildConfig, NormalizationConfig, SuggestConfig
from quillspark.functions import text as T
from quillspark.operators import beam, rerank
from quillspark.operators.local import LocalServer, by_map, edits, words_of
from quillspark.plans.engine import Autocomplete

PROMPTS = ["", " ", "how to bui", "how to biuld", "how to ", "build a", "build the de", "python zzz ", "zzz python b", "3.5 x", "BUILD A D", "how", "alpha beta", "deck safe", "ho", "xx", "sfaely", "a", None]
DOCS = [
    "How to build a deck", "How to build a desk", "How to build with python", "how to build a deck safely", "build the deck safely with python 3.5", "how to bake bread. Build a deck!",
    "alpha beta gamma delta", "alpha beta gamma epsilon", "beta gamma alpha", "deploy srv.123/x now", "to to to build", "a a b a a b", "how to build a deck safely with a friend",
]


@pytest.fixture(scope="module")
def engine(spark):
    return Autocomplete.create(spark, DOCS * 2, BuildConfig(phrase_min_count=2, vocab_prune_min_total_tokens=None))


def plain(row):
    d = row.asDict(recursive=True)
    d["score"] = round(d["score"], 9)
    d["breakdown"] = {k: round(v, 9) for k, v in d["breakdown"].items()}
    return d


@pytest.mark.parametrize(
    "cfg",
    [
        SuggestConfig(),
        SuggestConfig(collapse_prefix_ladders=False, unknown_context_strategy="strict", normalize_phrase_scores_by_length=True),
        SuggestConfig(collapse_prefix_ladder_strategy="prefer_longest", max_suggestion_words=3, default_length_bias=0.9, fuzzy_prefix=True, suppress_redundant_continuations=False),
        SuggestConfig(collapse_prefix_ladder_strategy="prefer_shortest", beam_width=3, min_context_support_ratio=0.5, token_branch_limit=2, default_top_k=3, fuzzy_prefix=False),
    ],
)
def test_driver_and_joins_agree(spark, engine, cfg):
    server = engine.local()
    frame = spark.createDataFrame(list(enumerate(PROMPTS)), "prompt_id long, text string")
    joined = beam.inspect(frame, engine.index, cfg)
    want = [plain(r) for r in joined.orderBy("prompt_id", "rank").collect()]
    rows = engine.inspect(PROMPTS, suggest_config=cfg).orderBy("prompt_id", "rank")
    assert [plain(r) for r in rows.collect()] == want and len(want) > 10
    mapped = by_map(frame, engine.index, cfg)
    assert [plain(r) for r in mapped.orderBy("prompt_id", "rank").collect()] == want and by_map(frame, engine.index, cfg, most_bytes=10) is None
    assert server is not None and rows.schema.names == mapped.schema.names == joined.schema.names


def test_too_large_an_index_is_served_by_joins(engine):
    assert LocalServer.load(engine.index, 100) is None
    other = Autocomplete(engine.index)
    other._asked = True  # nothing on the driver
    assert other.complete("how to bui") == engine.complete("how to bui") != []
    assert other.warm().complete("how to bui") == engine.complete("how to bui")
    other.release()


def test_tokens_on_the_driver(spark):
    texts = ["We're at version 3.5 today.", "“Build”—it’s live…", "Ａpple  BUILD", "a b\x1cc", "", "ÀÉ café ſtop", "dev@example.com, src/app.py", "É é"]
    for cfg in (NormalizationConfig(), NormalizationConfig(strip_accents=True), NormalizationConfig(strip_punctuation=False, lowercase=False), NormalizationConfig(unicode_nfkc=False)):
        df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
        assert [r[0] for r in df.select(T.tokens(F.col("t"), cfg)).collect()] == [words_of(t, cfg) for t in texts]


def test_edits():
    from test_queries import plain_distance

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    for a, b in [(word(), word()) for _ in range(2000)]:
        assert edits(a, b, 2) == min(3, plain_distance(a, b))


def test_reranking_of_lists(spark):
    cases = [("how to", ["how to bbb", "how to build", "How to q", "how to track", "else 12", "how to", "how to a b"]), ("", ["x", "yes", "aaa b"]), ("ab ", ["ab", "abc", "ab cd"])]
    for prefix, texts in cases:
        df = spark.createDataFrame([(1, prefix, i, t) for i, t in enumerate(texts, 1)], "prompt_id long, prefix string, rank int, text string")
        table = [r["text"] for r in rerank.HeuristicReranker().apply(df).orderBy("rank").collect()]
        assert rerank.HeuristicReranker().rerank(prefix, texts) == table and sorted(table) == sorted(texts)
        for r in df.select("text", rerank.tail_penalty(F.col("prefix"), F.col("text")).alias("p")).collect():
            assert abs(rerank.plain_penalty(prefix, r["text"]) - r["p"]) < 1e-9


def test_score_of_any_text(spark, engine):
    texts = ["how to build a deck", "zzz", "", None, "build " * 3000, "alpha zzz beta", "Alpha BETA", "deck, (deck)"]
    got = {r["prompt_id"]: r["score"] for r in engine.score([t for t in texts]).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - engine.local().log_score((t or "").lower().split())) < 1e-6 * (1 + abs(got[k]))
    assert got[0] > got[5] and got[2] == got[3] == 0


def test_scorers_merge_and_survive_a_round_trip(spark, tmp_path):
    from quillspark.operators.scorer import KneserNey

    lines = [["alpha", "beta"]] * 2 + [["Omega", "gamma"]] * 20 + [["theta", "gamma"]] * 20 + [["one"], []]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "tok array<string>")
    whole = KneserNey.from_lines(frame(lines))
    merged = KneserNey.from_lines(frame(lines[:9])).merge(KneserNey.from_lines(frame(lines[9:])))
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "omega  GAMMA zz"), (4, ""), (5, None)], "prompt_id long, text string")
    got = {r["prompt_id"]: r["score"] for r in whole.score(texts).collect()}
    assert got[1] > got[2] and got[4] == got[5] == 0
    assert {r["prompt_id"]: r["score"] for r in merged.score(texts).collect()} == pytest.approx(got)
    where = str(tmp_path / "scorer")
    merged.save(where)
    assert {r["prompt_id"]: r["score"] for r in KneserNey.load(spark, where).score(texts).collect()} == pytest.approx(got)
    with pytest.raises(FileNotFoundError):
        KneserNey.load(spark, str(tmp_path / "none"))
    manifest = tmp_path / "scorer" / "manifest.json"
    for text in ("{", '{"kind": "other", "version": 1, "rows": {}}', manifest.read_text().replace('"bigrams": 3', '"bigrams": 4')):
        manifest.write_text(text)
        (tmp_path / "scorer" / ".manifest.json.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            KneserNey.load(spark, where)


def test_another_scorer_takes_the_place_of_the_own_one(engine):
    """The index's scorer, given as another one, changes nothing; one that likes long texts does."""
    own = [plain(r) for r in engine.inspect(PROMPTS).orderBy("prompt_id", "rank").collect()]
    again = [plain(r) for r in engine.inspect(PROMPTS, scorer=engine.scorer).orderBy("prompt_id", "rank").collect()]
    key = lambda d: (d["prompt_id"], d["rank"], d["text"], round(d["score"], 6), round(d["breakdown"]["scorer_score"], 6))
    assert list(map(key, again)) == list(map(key, own)) and own

    class Long:
        def score(self, texts):
            return texts.select("prompt_id", (F.length("text") * 100.0).alias("score"))

    rows = engine.inspect("how to ", scorer=Long()).orderBy("rank").collect()
    assert [len(r["text"]) for r in rows] == sorted((len(r["text"]) for r in rows), reverse=True) and len(rows) > 1
