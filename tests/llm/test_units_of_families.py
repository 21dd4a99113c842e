"""Units of large blocks stay within their size, and sets hashed together are those of each text alone."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join


def test_units_of_a_family_stay_within_their_size(spark, monkeypatch):
    """Independent edits of one text share its smallest grams: by ranges of these hashes they all came to one unit. Many link with nothing."""
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    largest, real = [], ngram_join._search

    def search(sets, rule):
        largest.append(sets.groupBy("block", "unit").agg(F.countDistinct("key").alias("n")).agg(F.max("n")).first()[0] or 0)
        return real(sets, rule)

    monkeypatch.setattr(ngram_join, "_search", search)
    ngram_join.prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, rule=ngram_join.Rule(5, 80), unit=20).collect()}
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    label = list(range(len(sets)))
    for _ in rows:
        low = [min(label[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)) for a in sets]
        if low == label:
            break
        label = low
    assert got == dict(enumerate(label)) and len(set(label)) > 20
    assert largest[0] <= 20 and max(largest) <= 40, largest  # a unit, and two that meet; all 90 before


def _plain(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode("utf-8", "surrogatepass").lower())
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("n", [1, 3, 5, 11])
def test_sets_hashed_together(n):
    rng = random.Random(2)
    letters = ["a", "b", "A", " ", "\t", "\v", "\f", "\n", "é", "\u0085", "\0", "\ud800", "longer-than-8"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["", "  ", "y" * 70_000, "y" * 70_001, "z " + "y" * 200_000 + " q r s t", "k" * 256, "k" * 257, "k" * 255 + "\0", "k" * 8, "k" * 7 + "\0", "K" * 9, " ".join(f"w{i}" for i in range(20_000))]
    sets = list(ngram_join.gram_sets(texts, n))
    key_of = {}
    for t, s in zip(texts, sets, strict=True):
        assert len(s) == len(_plain(t, n)) and (s[1:] > s[:-1]).all()
        assert np.array_equal(s, ngram_join.gram_set(t, n))
        assert key_of.setdefault(_plain(t, n), ngram_join.set_key(s)) == ngram_join.set_key(s)
    assert len(set(key_of.values())) == len(key_of)
    for i in range(0, 600, 2):
        assert len(np.intersect1d(sets[i], sets[i + 1])) == len(_plain(texts[i], n) & _plain(texts[i + 1], n))


@pytest.mark.parametrize("high", [1, 50, 1 << 39, (1 << 64) - 1])
def test_numbered(high):
    x = np.random.default_rng(1).integers(0, high, 500, np.uint64, endpoint=True)
    assert ngram_join._numbered(x).tolist() == np.unique(x, return_inverse=True)[1].tolist()
    assert ngram_join._numbered(x[:0]).tolist() == []
