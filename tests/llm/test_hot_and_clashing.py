"""Sets that share half a key, ranges in slices, leaders over several units, long common headers, and columns named like the operators' own."""

import random
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import exact_dedup, ngram_join
from tests.llm.test_operators import _join


@pytest.fixture(scope="module")
def family(spark):
    """Texts of a few families, near and far within them."""
    rng = random.Random(8)
    rows = []
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(60)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 12, 25])):
                w[rng.randrange(60)] = rng.choice(base)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "one", "one", "a b"])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()


def _check(rows, df, n, percent, **options):
    got = ngram_join.jaccard_components(df, rule=ngram_join.Rule(n, percent), **options)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _join(rows, n, percent)


def test_sets_that_share_half_a_key(family, monkeypatch):
    real = ngram_join.set_key

    def weak(grams):
        a, b = real(grams)
        return a & 7, b

    monkeypatch.setattr(ngram_join, "set_key", weak)
    _check(*family, 2, 80)


def test_ranges_in_slices(family, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 50)
    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", 400)
    monkeypatch.setattr(ngram_join, "LEAST_RANGES", 2)
    monkeypatch.setattr(ngram_join, "MOST_CHUNK_GRAMS", 400)
    _check(*family, 2, 80)


@pytest.mark.parametrize("unit", [3, 25])
def test_leaders_over_several_units(family, unit):
    _check(*family, 1, 70, unit=unit)


def _groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return by


@pytest.mark.parametrize("leaf", [exact_dedup.LEAF_BYTES, 300])
def test_long_common_headers(spark, leaf, monkeypatch):
    rng = random.Random(2)
    head = "".join(rng.choices("abcdef", k=70_000))
    rows = [(i, head + "".join(rng.choices("ab", k=rng.randint(0, 6)))) for i in range(60)] + [(99, head), (98, head[:-1]), (97, None), (96, "")]
    jobs = []
    real = exact_dedup._round
    monkeypatch.setattr(exact_dedup, "_round", lambda t, trie: jobs.append(1) or real(t, trie))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = _groups(rows)
    got = exact_dedup.assign_groups(df, leaf_bytes=leaf).collect()
    assert sorted((r.doc_id, r._keep_id, r._group_size) for r in got) == sorted((i, max(by[t or ""]), len(by[t or ""])) for i, t in rows)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(df, leaf_bytes=leaf).collect()) == sorted(max(x) for x in by.values())
    assert len(jobs) < 60  # of 256 bytes a round, the header alone would take 270 a run


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "_gid", "_here", "_n", "_max", "_leaf", "_bytes", "_keep_id", "_kept", "_GONE_ID", "key", "leaf"]
    rows = [(i, f"some words {i % 3} and more words to tell it apart", *[7] * 11) for i in range(9)] + [(None, None, *[None] * 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:]))
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == names and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 6, 7, 8]
    all_rows = exact_dedup.assign_groups(df)
    assert all_rows.columns[: len(names)] == names and all_rows.count() == 10
    near = ngram_join.drop_near_copies(df.checkpoint(), rule=ngram_join.Rule(1, 90))
    assert near.columns == names and near.where("doc_id is not null").count() == 3


def test_values_of_rows_that_stay(spark):
    rows = [(5, "same", "five"), (9, "same", "nine"), (None, "same", "none"), (9, "same", "nine too"), (None, "other", "kept")]
    got = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(4)).collect()
    assert {(r.doc_id, r.text) for r in got} == {(9, "same"), (None, "other")} and len(got) == 2 and all(r.note in ("nine", "nine too", "kept") for r in got)
