import warnings

import pytest

from quillspark.config import BuildConfig, NormalizationConfig, SuggestConfig, apply_quality_profile
from quillspark.operators.rerank import BaseReranker, HeuristicReranker
from quillspark.plans.engine import Autocomplete, index_path
from quillspark.plans.index import load_index
from quillspark.plans.store import DocumentStore
from quillspark.sources.documents import Document, from_items, read_bytes, sample_documents

DECK = ["How to build a deck", "How to build a desk", "How to build with python"]


@pytest.fixture(scope="module")
def deck(spark):
    return Autocomplete.create(spark, DECK)


def test_prefix_and_typo(deck):
    rows = {(r["prompt_id"], r["text"]): r for r in deck.inspect(["how to bui", "how to biuld", "how to bx", "", "qqq zzz"], collapse_prefix_ladders=False).collect()}
    assert (0, "how to build") in rows and (0, "how to build a deck") in rows
    m = rows[1, "how to build"]["prefix_match"]
    assert (m["fragment"], m["matched"], m["edit_distance"], m["fuzzy"]) == ("biuld", "build", 1, True)
    assert {p for p, _ in rows} == {0, 1}
    b = rows[0, "how to build"]["breakdown"]
    assert abs(b["final_score"] - (b["scorer_score"] + 0.35 * b["prior_score"] - b["noise_penalty"] - b["context_support_penalty"] + b["length_adjustment"])) < 1e-9


def test_fuzzy_off_and_ladders(deck):
    assert deck.complete("how to biuld", suggest_config=SuggestConfig(fuzzy_prefix=False)) == []
    every = deck.complete("how ", collapse_prefix_ladders=False, topk=20)
    few = deck.complete("how ", topk=20)
    assert len(few) < len(every) and set(few) <= set(every)
    longest = deck.complete("how ", suggest_config=SuggestConfig(collapse_prefix_ladder_strategy="prefer_longest"), topk=20)
    assert not any(a != b and b.startswith(a + " ") for a in longest for b in longest)


def test_context_redundancy_and_gate(spark):
    e = Autocomplete.create(spark, ["alpha beta alpha", "alpha beta alpha", "alpha beta gamma"])
    got = e.complete("alpha beta ", max_words=1, collapse_prefix_ladders=False)
    assert got == ["alpha beta gamma"]
    assert "alpha beta alpha" in e.complete("alpha beta ", max_words=1, suggest_config=SuggestConfig(suppress_redundant_continuations=False))
    assert e.complete("gamma alpha x", suggest_config=SuggestConfig(min_context_support_ratio=0.75)) == []
    skip = e.complete("alpha beta unknown ", collapse_prefix_ladders=False)
    assert skip and e.complete("alpha beta unknown ", suggest_config=SuggestConfig(unknown_context_strategy="strict")) == []


def test_noise(spark):
    e = Autocomplete.create(spark, ["deploy stable package"] * 2 + ["deploy srv.123 package"] * 3)
    assert e.complete("deploy s", max_words=1, suggest_config=SuggestConfig(noise_penalty_weight=1.0))[0] == "deploy stable"


def test_save_load_and_damage(spark, deck, tmp_path):
    where = deck.save(tmp_path / "ix")
    again = Autocomplete.load(spark, tmp_path / "ix")
    assert again.complete("how to bui") == deck.complete("how to bui") and again.documents is None
    with pytest.raises(FileNotFoundError):
        Autocomplete.load(spark, tmp_path / "none")
    (tmp_path / "ix" / "manifest.json").write_text("{")
    with pytest.raises(ValueError):
        load_index(spark, where)
    assert index_path("name").endswith("/.quillspark_indexes/name")


def test_rerankers(deck):
    class Backwards(BaseReranker):
        def rerank(self, prefix, candidates):
            return candidates[::-1]

    plain = deck.complete("how to ", collapse_prefix_ladders=False)
    assert deck.complete("how to ", collapse_prefix_ladders=False, reranker=BaseReranker()) == plain
    assert deck.complete("how to ", collapse_prefix_ladders=False, reranker=Backwards()) == plain[::-1]
    assert sorted(deck.complete("how to ", collapse_prefix_ladders=False, reranker=HeuristicReranker())) == sorted(plain)


def test_warnings(deck):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        deck.suggest("how to " + "x" * 30, max_words=9, suggest_config=SuggestConfig(token_branch_limit=40, phrase_branch_limit=40))
    assert sum(issubclass(x.category, UserWarning) for x in w) == 4


def test_config():
    b, s = apply_quality_profile("precision", BuildConfig(phrase_min_count=2), SuggestConfig(beam_width=24))
    assert (b.phrase_min_count, b.phrase_min_doc_freq, s.beam_width, s.token_branch_limit) == (2, 2, 24, 6)
    with pytest.raises(ValueError):
        apply_quality_profile("none")
    with pytest.raises(ValueError):
        BuildConfig(max_context_tokens=7)
    with pytest.raises(ValueError):
        SuggestConfig(max_edit_distance=-1)
    with pytest.raises(ImportError):
        NormalizationConfig(pysbd_language="en")


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello \xff world")
    rows = from_items(spark, [Document("x", "1", {"k": 1}), "y", tmp_path / "a.txt"]).orderBy("doc_ord").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [("1", "x"), (None, "y"), ("a.txt", "hello � world")]
    with pytest.raises(TypeError):
        from_items(spark, [3])
    with pytest.raises(ValueError):
        read_bytes("a.csv", b"")
    assert sample_documents(spark).count() == 5


def test_empty_corpora(spark):
    for docs in ([], ["..."], [""]):
        with pytest.raises(ValueError):
            Autocomplete.create(spark, docs)


def test_store(spark, tmp_path):
    s = DocumentStore.open(spark, str(tmp_path / "store"))
    r = s.add_documents([Document("How to build a deck", "a"), Document("How to build a desk", "b"), Document("", "e"), Document("How to build a deck", "c"), Document("How to build a desk", "b")])
    assert (r.inserted_count, r.duplicate_doc_ids) == (2, ("b",)) and [(d.doc_id, d.text_preview) for d in r.duplicate_texts] == [("a", "How to build a deck")]
    with pytest.raises(ValueError):
        s.add_documents([Document("other", "a")])
    assert [d.doc_id for d in s.list_documents()] == ["a", "b"]
    assert any("how to build" in x["text"] for x in s.suggest("how to bui").collect())
    assert s.engine() is s.engine()
    assert s.add_documents(["How to bake bread"]).inserted_count == 1
    assert any("bake" in x["text"] for x in s.suggest("how to ba").collect())
    again = DocumentStore.open(spark, str(tmp_path / "store"))
    assert again.documents().count() == 3 and again.remove_document("a") == 1 and again.remove_document("zz") == 0
    with pytest.raises(ValueError):
        DocumentStore.open(spark, str(tmp_path / "store"), BuildConfig(phrase_min_count=7))
    other = again.migrate(str(tmp_path / "other"))
    assert other.documents().count() == 2 and len(again.history("ingest_log")) == 2 and len(again.history("build_history")) == 2
    other.clear()
    assert other.documents().count() == 0
    with pytest.raises(NotImplementedError):
        DocumentStore.open(spark, "postgres://x/y")
