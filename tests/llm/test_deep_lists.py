"""List entries of every depth and kind."""

import datetime as dt

import pytest

from corpusloom.llm import url_lists

DAY = dt.datetime(2024, 1, 2)


@pytest.mark.parametrize(
    ("kind", "pattern", "url", "blocked"),
    [
        ("domain", "tracker.example.co.uk", "http://a.tracker.example.co.uk/x", True),
        ("domain", "d.tracker.example.co.uk", "http://a.b.c.d.tracker.example.co.uk", True),
        ("domain", "acker.example.co.uk", "http://a.tracker.example.co.uk/x", False),
        ("domain", "zip", "https://some.zip/", True),
        ("domain", "localhost", "http://localhost:8080/x", True),
        ("path", "h.com/a/b", "http://H.com/a/b/c?q", True),
        ("path", "h.com/a/b/c", "http://h.com/a/b/c/", True),
        ("path", "h.com/a/b", "http://h.com/a/bc", False),
        ("path", "h.com/a/b", "http://h.com/a", False),
        ("path", "h.com/a", "http://h.com/a/b", True),
        ("path", "h.com/", "http://h.com//", False),
        ("url", "https://h.com/a/b?q=1", "HTTPS://h.com:443/a/b?q=1#top", True),
        ("url", "https://h.com/a/b", "https://h.com/a/b/c", False),
        ("host", "h.com", "https://x.h.com/", False),
    ],
)
def test_entry(spark, kind, pattern, url, blocked):
    entries = spark.createDataFrame([(kind, pattern, "bad", "add", DAY)], url_lists.ENTRY_SCHEMA)
    got = url_lists.filter_urls(spark.createDataFrame([(1, url, DAY)], "page_id long, url string, fetched_at timestamp"), entries).collect()
    assert [(r.blocked, r.matched) for r in got] == [(blocked, f"{kind}:{pattern}" if blocked else "")]
