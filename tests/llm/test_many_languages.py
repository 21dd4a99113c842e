"""Language identification with more languages than a hundred."""

import random

from corpusloom.llm import language_id

N = 130


def _words(k):
    rng = random.Random(k)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(40)]


def test_every_language_is_learned(spark):
    rng, rows = random.Random(1), []
    for k in range(N):
        words = _words(k)
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=30)), f"l{k}") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs)
    assert model.languages == sorted(f"l{k}" for k in range(N))
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in language_id.language_ids(docs).collect()}
    held = [(got[i][1], lang) for i, _, lang in rows if got[i][0]]
    assert len({lang for _, lang in held}) > 100
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_rows_of_a_language_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "solve", lambda rows: seen.extend(rows))
    docs = spark.createDataFrame([(None, f"text {'ab' * (i % 50)}", "xx") for i in range(300)] + [(7, "other", "yy")], "doc_id long, text string, lang string")
    language_id.fit(docs, per_language=20)
    assert [lang for lang, _ in seen].count("xx") <= 40 and ("yy" in {lang for lang, _ in seen})
