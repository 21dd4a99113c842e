"""corpus_pipeline.run() against the stages in plain Python."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import pii
from corpusloom.llm.queries import public_vocabulary


def _near(rows):
    """Ids that stay of documents connected by a Jaccard similarity of 0.8 of five-word shingles."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    return [(i, t) for (i, t), g in zip(rows, group, strict=True) if i == least[g]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = "stone river the wind carries over old houses and people walk slowly home again by night".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(6, 90))), "en", "s", 0) for i in range(60)]
    for i in range(60, 90):  # near copies
        w = rows[i - 60][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(i, rows[i - 90][1], "en", "s", 0) for i in range(90, 110)]  # exact copies
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "12 ½ 34", "en", "s", 0), (203, "mail ann@mail.com or call +1 (415) 555-1234 now", "en", "s", 0), (204, "word " * 9000, "en", "s", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_run_equals_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    import corpus_pipeline

    path, rows = folder
    left = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for i, t in left:
        last[t] = max(last.get(t, i), i)
    left = _near(sorted((i, t) for t, i in last.items()))
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == {i for i, _ in left}
    tokenizer = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(by.setdefault(r.doc_id, [])) and r.length <= 2048
        by[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for i, t in left:
        base = pii.find_base(t)[0]
        for kind, a, b in reversed(base):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        assert by[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_empty_and_extra_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key int, _gid int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(i, f"some longer text number {i} of its own kind {i * i}", "en", "s", 0, 7, 8) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, _gid int").checkpoint()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = after.checkpoint()
    assert {(r.key, r._gid) for r in docs.collect()} == {(7, 8)}
