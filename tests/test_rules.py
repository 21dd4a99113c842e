"""Metadata, language, kind and JSON-line rules on known cases."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions import text as X
from corpusloom.plans import queries as Q
from corpusloom.sources import readers as R

BOOK = """The Project Gutenberg eBook of The Declaration of Independence

This eBook is for the use of anyone anywhere in the United States and
most other parts of the world at no cost and with almost no restrictions
whatsoever.

Title: The Declaration of Independence of the United States of America

Author: Thomas Jefferson


        \nRelease date: December 1, 1971 [eBook #1]
                Most recently updated: September 2, 2025

Language: English

*** START OF THE PROJECT GUTENBERG EBOOK ***

Title: not this one."""

CASES = [
    ("---\ntitle: My Document\nauthor: Alice\ndate: 2024-01-15\n---\n\nBody text.", {"title": "My Document", "author": "Alice", "created_at": "2024-01-15"}),
    ('+++\ntitle = "My Document"\nauthor = "Bob"\ndate = "2024-06-01"\n+++\n\nBody.', {"title": "My Document", "author": "Bob", "created_at": "2024-06-01"}),
    ('+++\ntitle = "TOML Lang"\nlanguage = "German"\n+++\n\nContent here.', {"title": "TOML Lang", "lang": "de"}),
    ("#+TITLE: Org Document\n#+AUTHOR: Carol\n#+DATE: 2024-02-20\n#+LANGUAGE: French\n\n* Heading\nBody.", {"title": "Org Document", "author": "Carol", "created_at": "2024-02-20", "lang": "fr"}),
    ("Title: Project Gutenberg\nAuthor: Various\nLanguage: English\n\nThe actual content.", {"title": "Project Gutenberg", "author": "Various", "lang": "en"}),
    ("Title: Some Book [Volume 1]\nDate: 2024-03-15 [revised]\n\nBody.", {"title": "Some Book", "created_at": "2024-03-15"}),
    ("Some introductory paragraph...\n\nTitle: My Document\nAuthor: Jane Doe\nLanguage: French\n\nContent.", {"title": "My Document", "author": "Jane Doe", "lang": "fr"}),
    ("The Great Novel\n\nby Herman Melville\n\nChapter 1...", {"title": "The Great Novel", "author": "Herman Melville"}),
    ("Some Manual\n\nCopyright (c) 2024 Jane Smith. All rights reserved.\n\nContent here.", {"title": "Some Manual", "author": "Jane Smith", "created_at": "2024"}),
    ("My Important Document\n\nThis is the body...", {"title": "My Important Document"}),
    ("This is a normal sentence.\n\nFollowed by more text.", {}),
    (BOOK, {"title": "The Declaration of Independence of the United States of America", "author": "Thomas Jefferson", "created_at": "December 1, 1971", "lang": "en"}),
    ("A" * 130 + "\n\nBody.", {}),
    ("", {}),
    ("pub struct Foo {\n    topic: Option<String>,\n    author: Option<String>,\n    title: String,\n}", {}),
    ("topic: Some(Arc::from(topic)),\nauthor: Vec<String>,\ntitle: doc.topic.take(),\n", {}),
    ("\ttopic: something\n", {}),
    ("//! Module documentation\n\nBody text.", {}),
    ("use std::io;\n\nfn main() {}", {}),
    ("#!/usr/bin/env python\n\nprint('hello')", {}),
    ("Category: birds\nEditor: Ann Lee\nLast Updated: May 2020\nPublication date: 1999\n\nBody", {"tags": "birds", "author": "Ann Lee", "created_at": "May 2020"}),
    ("Subject: owls\n\nBody", {"tags": "owls"}),
    ("---\nfoo: bar\ntitle broken\n---\nAuthor: Nobody\n", {}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_metadata(text, want):
    got = M.extract(text)
    assert {k: got.get(k) for k in M.FIELDS} == {k: want.get(k) for k in M.FIELDS}


@pytest.mark.parametrize(("head", "want"), [("Copyright © 2024 Acme Corp", ("Acme Corp", "2024")), ("Copyright 2024 Acme Corp", ("Acme Corp", "2024")), ("Copyright Â© 2024 Stray Corp", None), ("copyright © 2023-2024 Example Inc", ("Example Inc", "2023-2024"))])
def test_copyright(head, want):
    assert M._copyright(head) == want


def test_columns_agree_with_the_cases(spark):
    rows = spark.createDataFrame([(n,) for n, _ in Q.LANGUAGE_CASES], "x string")
    assert [r.c for r in rows.select(X.lang_code(F.col("x")).alias("c")).collect()] == [c for _, c in Q.LANGUAGE_CASES] == [M.language_code(n) for n, _ in Q.LANGUAGE_CASES]
    mime = [("a", "text/x-python", "code", None), ("a", "text/csv", "data", "csv"), ("a", "application/xhtml+xml", "document", None), ("a", "application/atom+xml", "data", None), ("a", "application/mbox", "email", None), ("a", "text/markdown", "document", "md"), ("a.RS", "text/csv", "code", "rs"), ("a", None, "document", None)]
    got = spark.createDataFrame(mime, "p string, m string, k string, f string").select(X.kind_of(F.col("p"), F.col("m")).alias("kind"), X.format_of(F.col("p"), F.col("m")).alias("format"), "k", "f").collect()
    assert all((r.kind, r.format) == (r.k, r.f) for r in got), got


def test_json_lines(spark):
    whole = {"source": "doc/1", "content": "hello world", "title": "Hello", "author": "alice", "lang": "en", "format": "md", "kind": "code", "tags": ["a", "b"], "created_at": "2026-01-01T00:00:00Z"}
    lines = [json.dumps(whole), '{"content":"hello"}', '{"source":"doc/1"}', '{"source":"","content":"hello"}', "{bad json", '{"source":"x","content":"y","tags":"a, b"}', '{"source":"z","content":"y","kind":"odd"}']
    docs, failed = R.exec_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"), topic="topic", format="txt")
    got = {r.source: r.asDict() for r in docs.collect()}
    assert got["doc/1"] == whole | {"tags": "a, b", "topic": "topic"}
    assert (got["x"]["tags"], got["x"]["kind"], got["x"]["format"], got["z"]["kind"]) == ("a, b", "document", "txt", "document")
    assert sorted(r.reason for r in failed.collect()) == ["no content", "no source", "no source", "not a document"]


def test_metadata_of_two_finds(spark):
    fields = ", ".join(f"{f}: string" for f in M.FIELDS)
    own, other = ("T", None, "en", None, "t", None), ("U", "A", "fr", None, "u", "2001")
    rows = spark.createDataFrame([(1, own, other, "document", None), (2, own, other, "code", "set"), (3, None, other, "document", ""), (4, None, None, "document", None)], f"id int, own struct<{fields}>, other struct<{fields}>, kind string, topic string")
    found = rows.select("id", M.settled(M.merged(F.col("own"), F.col("other")), F.col("kind"), F.col("topic")).alias("m"))
    assert {r.id: tuple(r.m) for r in found.collect()} == {
        1: ("T", "A", "en", None, "t", "2001"), 2: (None, "A", "en", None, "set", "2001"), 3: ("U", "A", "fr", None, "", "2001"), 4: (None,) * 6}
