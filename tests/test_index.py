"""The stored index against plain versions, and what it reads."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import analyze as A
from corpusloom.operators import federation as FED
from corpusloom.operators import index as X
from corpusloom.operators import search as S
from corpusloom.storage import Files, fresh_folder

BODIES = ["the fox runs over the old house", "Foxes and a FOX", "", None, "over the hills the house stands", "the the the", "one 🎉 東京都 fox", "house of the fox of the house"]
ROWS = [(f"{'abc'[i % 3]}.md", ("t1", None, "t0")[i % 3], i, b, f"title {i % 3}") for i, b in enumerate(BODIES)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "source string, topic string, chunk_index long, body string, title string")


@pytest.fixture(scope="module")
def ix(spark, chunks):
    return X.open_or_build(spark, fresh_folder(spark, "test-index"), lambda: chunks, positions=True)


def bm25(words, query, k1=1.2, b=0.75):
    """Plain scores of lists of words."""
    n, average = len(words), sum(map(len, words)) / len(words)
    df = {t: sum(t in w for w in words) for t in query}
    out = []
    for w in words:
        c = Counter(w)
        out.append(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(w) / average)) for t in query if c[t]))
    return out


def test_scores_and_pages_equal_the_scan(chunks, ix):
    for q in ({"terms": ["fox", "the"]}, {"terms": ["house"], "excluded": ["hills"]}, {"required": ["the", "house"]}, {"phrases": [["the", "fox"]]}, {"terms": ["nothing"]}, {"phrases": [["the", "house"], ["of", "the"]], "terms": ["fox"]}):
        query = S.Query(**q)
        more = ({"limit": 2, "offset": 1}, {"max_per_source": 1}, {"sort": "topic"}, {"sort": "source", "reverse": True}, {"source": "b"}, {"equal": {"topic": "t1"}}, {"limit": 0}) if q == {"terms": ["fox", "the"]} else ()
        for options in ({}, *more):
            names = ["source", "chunk_index", "score", "rank", "total", "body"]
            assert ix.search(query, **options).select(*names).collect() == S.search(chunks, query, **options).select(*names).collect(), (q, options)


def test_stemmed_scores_equal_a_plain_version(spark, chunks):
    ix = X.open_or_build(spark, fresh_folder(spark, "test-index"), lambda: chunks, fields=("body",), analyze=A.analyzed("english"), analyzer="english")
    stops = A.stop_words("english")
    want = bm25([A.analyze(b, "english", stops) for b in BODIES], ["fox", "hous"])
    got = {r.chunk_index: r.score for r in ix.search(A.parse("foxes houses", "english", stops), boosts={"body": 1.0}).collect()}
    assert got == {i: round(x, 6) for i, x in enumerate(want) if x}
    with pytest.raises(X.IndexOutdated):
        X.SearchIndex(spark, ix.path, "none")


def test_postings_equal_a_plain_version(ix):
    got = {(r.field, r.term, r.source, r.chunk_index): (r.tf, r.len, r.positions) for r in ix.postings.join(ix.docs.select("did", "source"), "did").collect()}
    want = {}
    for source, _, i, body, title in ROWS:
        for field, text in (("body", body), ("title", title)):
            words = A.analyze(text, "none")
            for t in set(words):
                at = [k for k, w in enumerate(words) if w == t]
                want[field, t, source, i] = (len(at), len(words), at)
    assert got == want
    assert {(r.term, r.df, r.cf) for r in ix.terms.where("field = 'body'").collect()} == {(t, sum(k[:2] == ("body", t) for k in want), sum(v[0] for k, v in want.items() if k[:2] == ("body", t))) for t in {k[1] for k in want if k[0] == "body"}}


def test_a_search_reads_its_terms_only(ix):
    plan = ix.score(S.Query(["fox"]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (= \d+|IN \()", plan) and re.search(r"PushedFilters: \[.*(In|EqualTo)\(term", plan) and "regexp_extract_all" not in plan


def test_an_empty_table(spark, chunks):
    ix = X.open_or_build(spark, fresh_folder(spark, "test-index"), lambda: chunks.limit(0))
    assert ix.search(S.Query(["fox"])).count() == 0 and ix.total(S.Query(["fox"])).first().total == 0


def test_a_broken_build_leaves_no_index(spark, chunks):
    path = fresh_folder(spark, "test-index")
    with pytest.raises(Exception):  # noqa: B017
        X.open_or_build(spark, path, lambda: chunks.withColumn("body", F.raise_error(F.lit("broken"))))
    assert not Files(spark, path).exists()
    assert X.open_or_build(spark, path, lambda: chunks).meta["n"] == len(ROWS)


def test_stores_together(spark, chunks, ix):
    one = FED.search_stores({"x": ix}, S.Query(["fox"]))
    assert [r.norm for r in one.collect()] == [r.score for r in ix.search(S.Query(["fox"])).collect()]
    two = FED.search_stores({"x": ix, "y": ix}, S.Query(["fox"]), limit=3).collect()
    assert [r.norm for r in two[:2]] == [1.0, 1.0] and two[0].total == two[1].total
    docs = spark.createDataFrame([("a", 3), ("b", 1)], "source string, n int")
    other = spark.createDataFrame([("a", 2)], "source string, n int")
    got = FED.union_docs({"x": docs, "y": other}, [F.desc("n"), F.asc("source")], 2).collect()
    assert [(r.source, r.store) for r in got] == [("a", "x"), ("a", "y")]
    answer = lambda *rows: spark.createDataFrame(rows, "source string, tier int, ambiguous boolean")
    got = FED.pool_sources({"x": answer(("d/a", 3, True), ("d/b", 3, True)), "y": answer(("e/a", 0, False))}).collect()
    assert [tuple(r) for r in got] == [("e/a", 0, False)]
    got = FED.pool_sources({"x": answer(("a", 0, False)), "y": answer(("b", 2, False), )}).collect()
    assert [tuple(r) for r in got] == [("a", 0, True), ("b", 2, True)]
    maps = spark.createDataFrame([({"en": 1},), ({"en": 2, "de": 1},)], "counts map<string, long>")
    assert FED.merge_maps(maps).first().counts == {"de": 1, "en": 3}
