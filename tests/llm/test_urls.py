import itertools
import math

import numpy as np
import pyarrow.parquet as pq

from quillspark.llm import urls


def all_splits(label):
    for cuts in itertools.product([0, 1], repeat=len(label) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(label)]
        yield [label[a:b] for a, b in zip(at, at[1:])]


def test_segmentation_is_the_most_probable():
    rng = np.random.default_rng(0)
    for _ in range(60):
        vocab = {"".join(rng.choice(list("abc"), rng.integers(1, 5))): float(np.log(rng.random())) for _ in range(12)}
        label = "".join(rng.choice(list("abcd"), rng.integers(1, 10)))
        unknown = -4.0
        score = lambda ws: sum(vocab.get(w, unknown - len(w) * math.log(10)) for w in ws)
        got = urls.segment(label, vocab, unknown)
        assert "".join(got) == label
        assert abs(score(got) - max(map(score, all_splits(label)))) < 1e-9


def test_naive_bayes():
    seeds = [("win casino", True), ("daily news", False)]
    nb = urls.NaiveBayes([(s.split(), y) for s, y in seeds])
    v = len(set("win casino daily news".split()) | set(urls.NEUTRAL))
    n = 2 + len(urls.NEUTRAL) + v
    assert abs(nb.score(["win", "casino", "zzz"]) - 2 * (math.log(2 / n) - math.log(1 / n))) < 1e-9
    assert nb.score(["daily"]) < 0 and nb.score(["www"]) == 0


def test_filter(spark):
    body = "<p>free casino win bonus news daily library science journal city</p>" * 30
    rows = [(1, "http://freecasinowin.com/bonus", body), (2, "https://dailynews.org/science", body), (3, None, body), (4, "no scheme casino", None), (None, "http://freecasinowin.com/bonus", ""),
            (5, "http://USER:pw@CityLibrary.org:80/a", body), (5, "http://USER:pw@CityLibrary.org:80/a", body), (6, "", body), (7, "http://" + "x" * 3000 + ".com/", body), (8, "http:///path", body)]
    df = spark.createDataFrame([(*r, "extra", 1.0) for r in rows], "page_id long, url string, html string, host string, score double")
    out = urls.url_filter(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[1]["host_words"] == ["free", "casino", "win", "com"] and by[1]["blocked"]
    assert by[2]["host_words"] == ["daily", "news", "org"] and not by[2]["blocked"]
    assert by[3]["host"] is None and by[3]["score"] is None and not by[3]["blocked"]
    assert by[4]["host"] == "" and by[4]["blocked"]
    assert by[None]["score"] == by[1]["score"]
    assert by[5]["host_words"] == ["city", "library", "org"]
    assert "".join(by[7]["host_words"]) == "x" * 3000 + "com"
    assert urls.url_filter(df.where("false")).count() == 0


def test_seeds_are_not_the_hosts_of_the_tables():
    hosts = {urls.re.sub(r"^[^/]*//([^/?#]*).*$", r"\1", u) for u in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["url"]).column("url").to_pylist() if u}
    assert not [s for s, _ in urls.SEEDS for h in hosts if s.replace(" ", "-") in h or s.replace(" ", "") in h]


def test_concatenated_names_outside_the_seeds(spark):
    names = {"onlinepokerwin": True, "cheapviagrapharmacy": True, "fastloanscasino": True, "adultsextube": True, "citysciencenews": False, "schoolmusicarchive": False, "healthybread": False}
    assert not {s.replace(" ", "") for s, _ in urls.SEEDS} & set(names)
    df = spark.createDataFrame([(k, f"http://{n}.com/", "<p>the healthy bread is here</p>" * 30) for k, n in enumerate(names)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in urls.url_filter(df).collect()}
    assert [out[k]["blocked"] for k in range(len(names))] == list(names.values())
    assert out[0]["host_words"] == ["online", "poker", "win", "com"]


def test_words_of_any_length(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    assert urls.segment(long + "news", {long: -9.0, "news": -6.0, "donau": -8.0}, -14.0) == [long, "news"]
    df = spark.createDataFrame([(1, f"http://{long}news.de/", f"<p>{long} news straße</p>" * 50), (2, "http://straßenews.de/", None)], "page_id long, url string, html string")
    out = {r["page_id"]: r["host_words"] for r in urls.url_filter(df).collect()}
    assert out == {1: [long, "news", "de"], 2: ["straße", "news", "de"]}


def test_learns_from_labelled_urls(spark):
    """Words that no seed has are learned from labelled hosts; hosts held out, of the same words in other order, are told apart."""
    bad, good = "gizmo blarg quonk zlorp".split(), "fable meadow harbor violin".split()
    pairs = [(a, b) for k in (bad, good) for a in k for b in k if a != b]
    rows = [(f"http://{a}{b}.com/", int(a in bad)) for a, b in pairs if a < b]
    held = [(k, f"http://{a}{b}.com/", "<p>" + " ".join(bad + good) + "</p>") for k, (a, b) in enumerate(pairs) if a > b]
    table = spark.createDataFrame([*rows, (None, 1), ("http://x.com", None)], "url string, unwanted int")
    out = {r["page_id"]: r["blocked"] for r in urls.url_filter(spark.createDataFrame(held, "page_id long, url string, html string"), labelled=table).collect()}
    assert out == {k: pairs[k][0] in bad for k, _, _ in held} and len(set(out.values())) == 2
