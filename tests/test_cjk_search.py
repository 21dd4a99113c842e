"""Han, kana and emoji from query to hit."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import analyze as A
from corpusloom.operators import search as S

BODIES = ["今日は東京都に行きました", "rust コード 🎉🎉 done", "京", "Plain words, x_y 42 ½ café ☃", "한국어 단어 日本語ABC", "カ・タカナ 日々 ❶a", None, ""]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"{i}.md", f"{i}", 0, b) for i, b in enumerate(BODIES)], "source string, source_id string, chunk_index long, body string")


def test_tokens_are_those_of_the_analyzer(chunks):
    got = chunks.orderBy("source").select(S.tokens(F.col("body")).alias("t")).collect()
    assert [r.t for r in got] == [A.analyze(b, "none") for b in BODIES]


@pytest.mark.parametrize(("query", "want"), [("東京都", {"0.md"}), ('"東京都"', {"0.md"}), ("京", {"2.md"}), ("コード", {"1.md"}), ("🎉", {"1.md"}), ("日本 AND abc", {"4.md"}), ('"京東都"', set()), ("plain NOT ☃", set())])
def test_search(chunks, query, want):
    assert {r.source for r in S.search(chunks, A.parse(query)).collect()} == want


def test_postings_and_analyze(chunks):
    terms = {(r.term, r.tf) for r in S.build_postings(chunks, ("body",)).collect()}
    assert {("東京", 1), ("京都", 1), ("🎉", 2), ("日本", 1)} <= terms
    assert {r.source for r in S.search(chunks, A.parse("word", "english"), analyze=A.analyzed("english")).collect()} == {"3.md"}
