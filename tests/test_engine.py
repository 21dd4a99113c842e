import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import analyze as A
from corpusloom.functions import chunker as C
from corpusloom.functions import metadata as M
from corpusloom.functions import text as X
from corpusloom.operators import enrich, incremental, lists, search
from corpusloom.plans import queries as Q
from corpusloom.sources import readers as R


@pytest.mark.parametrize(("query", "want"), [("source:(foo bar)", "foo bar"), ("body:https://evil.com", "https://evil.com"), ("+a -b", "a b"), ("[x]", "x"), ('"a b"', '"a b"'), ("a AND b", "a AND b"), ("((a", "a"), ("", "")])
def test_sanitize(query, want):
    assert A.sanitize(query) == want


@pytest.mark.parametrize(("text", "want"), [("Hello, World", ["Hello", "World"]), ("量子力学", ["量子", "子力", "力学"]), ("水", ["水"]), ("한국어 문서", ["한국어", "문서"]), ("ok 🚀🚀", ["ok", "🚀", "🚀"]), ("", [])])
def test_tokenize(text, want):
    assert A.tokenize(text) == want


@pytest.mark.parametrize(("word", "want"), [("foxes", "fox"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("cries", "cri"), ("skies", "sky"), ("happily", "happili"), ("agreed", "agre"), ("national", "nation")])
def test_stem(word, want):
    assert A.stem(word) == want


def test_parse():
    q = A.parse('a AND b NOT c "d e"')
    assert (q.required, q.excluded, q.phrases) == (["a", "b"], ["c"], [["d", "e"]])
    with pytest.raises(A.EmptyQuery):
        A.parse(" () ")


def test_snippet_and_splice():
    text, ranges = A.snippet("one fox and two foxes here", ["fox"])
    assert A.splice(text, ranges) == "one **fox** and two **foxes** here"
    assert A.snippet("nothing", ["fox"]) is None
    assert A.splice("abc", [(2, 9), (1, 1)]) == "abc"


def test_chunker():
    body = "word " * 12
    got = C.chunk(f"﻿\n# A\n\n{body}\n\n## B\n\n{body}\n\n```\n# not a heading\n```\n\n## C\n\n{body}", least=10)
    assert [c.section for c in got] == ["A", "A > B", "A > C"]
    assert [c.section for c in C.chunk(f"# A\n{body}\n## Refs\n{body}\n### Deep\n{body}\n# Z\n{body}", least=10, drop=("refs",))] == ["A", "Z"]
    assert all(len(c.body) <= 100 for c in C.chunk("x" * 1000 + "\n\n" + body * 20, most=100, least=5))
    assert C.chunk("short", least=30) == []  # a last short chunk is dropped
    assert len(C.presplit("# a\n" + "x\n" * 99 + "# b\ny", 50)) == 2


def test_metadata():
    assert M.extract("---\ntitle: T\nauthor: A B\ntags:\n  - x\n---\nbody")["tags"] == "- x"
    assert M.extract('+++\ntitle = "T"\n+++\n')["title"] == "T"
    assert M.extract("#+TITLE: Org\n#+AUTHOR: Me")["author"] == "Me"
    assert M.extract("Title: The Book\nAuthor: Jane Doe [x]\n\n*** START")["author"] == "Jane Doe"
    assert M.extract("A Plain Title\n\nby Mary Anne Smith\n")["author"] == "Mary Anne Smith"
    assert M.extract("x\nCopyright 2020 Acme Corp. All rights reserved")["created_at"] == "2020"


def test_text_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(X.lang_code(F.lit("English; German"))) == "en"
    assert get(X.lang_code(F.lit("no language"))) is None
    assert get(X.maildir_flags(F.lit("a/cur/1:2,FS"))) == "seen, flagged"
    assert get(X.html_strip(F.lit("<p>a</p> > b<"))) == "a  b"
    assert get(X.normalize_url(F.lit("HTTP://A.com:80/x/"))) == "http://a.com/x"
    assert get(X.strip_lines(F.lit("a\r\nb\r\nc"), 1, 1)) == "b"
    assert get(X.is_text(F.lit("é").cast("binary"))) and not get(X.is_text(F.unhex(F.lit("00ff"))))
    assert get(X.clean_body(F.lit("a\r \r"))) == "a"


def test_archives_and_mail(tmp_path, spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "A")
        f.writestr("../evil", "x")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("d/b.txt")
        info.size = 1
        f.addfile(info, io.BytesIO(b"B"))
    assert list(R.members("x.zip", z.getvalue())) == [("a.txt", b"A")]
    assert list(R.members("x.tgz", t.getvalue())) == [("d/b.txt", b"B")]
    rows = spark.createDataFrame([("x.zip", bytearray(z.getvalue())), ("bad.gz", bytearray(b"nope"))], "source string, content binary")
    got = {r.source: r for r in R.expand_archives(rows).collect()}
    assert got["x.zip#a.txt"].content == b"A" and got["bad.gz"].reason
    (tmp_path / "cur").mkdir()
    (tmp_path / "cur" / "1:2,S").write_bytes(b"Subject: Hi\nFrom: a@b.c\n\nbody")
    (tmp_path / "cur" / "2:2,T").write_bytes(b"Subject: gone\n\nx")
    mails = R.maildir(spark.createDataFrame([(str(p), bytearray(p.read_bytes())) for p in (tmp_path / "cur").iterdir()], "source string, content binary")).collect()
    assert [(m.title, m.tags) for m in mails] == [("Hi", "seen")]


def test_local_files(tmp_path, spark):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("﻿# A")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    got = R.decode_text(R.local_files(spark, str(tmp_path))).collect()
    assert [(r.relative, r.content, r.kind) for r in got] == [("d/a.md", "# A", "document")]


def test_exec_feed_sitemap(spark):
    lines = ['{"source":"s","content":"c","tags":["a","b"]}', '{"source":"","content":"c"}', "bad"]
    docs, failed = R.exec_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.source, r.tags, r.kind) for r in docs.collect()] == [("s", "a, b", "document")] and failed.count() == 2
    xml = spark.createDataFrame([("<feed><entry><link href='https://a/1'/></entry></feed><rss><item><link>https://a/2</link></item><item><link>ftp://x</link></item></rss>",)], "x string")
    assert xml.select(R.feed_urls(F.col("x")).alias("u")).first().u == ["https://a/1", "https://a/2"]
    site = spark.createDataFrame([("<urlset><url><loc><![CDATA[https://a/1]]></loc></url></urlset>",)], "x string")
    assert site.select(R.sitemap_urls(F.col("x")).alias("u")).first().u == ["https://a/1"]


def test_search_caps_and_totals(spark):
    rows = [("a.md", i, "rust code") for i in range(3)] + [("b.md", i, "rust") for i in range(2)]
    chunks = spark.createDataFrame(rows, "source string, chunk_index long, body string")
    got = search.search(chunks, search.Query(["rust"]), max_per_source=1).collect()
    assert len(got) == 2 and got[0].total == 5
    assert search.search(chunks, search.Query(["rust"]), limit=0).count() == 0
    assert lists.clamp(0) == 1 and lists.clamp(99_999) == 500 and lists.clamp(None) == 10


def test_versioned_table_and_repair(tmp_path, spark):
    table = incremental.VersionedTable(spark, str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "source_id string, v int")
    table.commit(make([("a", 1), ("b", 1)]))
    table.upsert(make([("b", 2), ("c", 2)]))
    table.delete(make([("a", 0)]))
    assert sorted(map(tuple, table.read().collect())) == [("b", 2), ("c", 2)]
    docs = spark.createDataFrame([("a", 2), ("b", 1), ("d", 1)], "source_id string, chunk_count long")
    chunks = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "source_id string, chunk_index long")
    assert {(r.source_id, r.issue) for r in incremental.consistency(docs, chunks).collect()} == {("a", "mismatch"), ("c", "orphaned"), ("d", "missing")}
    d, c = incremental.repair(docs, chunks)
    assert [r.source_id for r in d.collect()] == ["b"] and [r.source_id for r in c.collect()] == ["b"]


def test_loose_json():
    assert enrich.loose_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert enrich.loose_json('so: {"a": 2} ok') == {"a": 2}
    assert enrich.loose_json("no") == {}


def test_every_oracle_has_a_query():
    assert Q.ORACLES.keys() <= Q.QUERIES.keys()
