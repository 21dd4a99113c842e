"""Families of near copies that grow with the input, and the layout of chunks over ranges of prints."""

import random
import time

import numpy as np
import pytest

from corpusloom.llm import ngram_join


def _family(n, words=300, seed=3):
    """Texts that are each an edit of an earlier one, as near copies of near copies are."""
    rng = random.Random(seed)
    texts = [[f"w{i}" for i in range(words)]]
    while len(texts) < n:
        w = list(rng.choice(texts))
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(3000)}"
        texts.append(w)
    sets = {ngram_join.set_key(s): s for s in (ngram_join.gram_set(" ".join(w), 3) for w in texts)}
    return [s for _, s in sorted(sets.items(), key=lambda x: (len(x[1]), x[0]))]


def _components(sets, percent):
    """By a table of all pairs."""
    grams = np.unique(np.concatenate(sets))
    has = np.zeros((len(sets), len(grams)), np.float32)
    for i, s in enumerate(sets):
        has[i, np.searchsorted(grams, s)] = 1
    both = has @ has.T
    size = has.sum(1)
    linked = 100 * both >= percent * (size[:, None] + size - both)
    label = np.arange(len(sets))
    while (low := np.where(linked, label, len(sets)).min(1)).tolist() != label.tolist():
        label = low
    return label.tolist()


@pytest.mark.parametrize(("percent", "merge", "table"), [(80, 4096, 64_000_000), (90, 0, 64_000_000), (90, 0, 50_000), (70, 0, 0), (60, 200, 5_000), (40, 0, 50_000)])
def test_components_of_a_family(percent, merge, table, monkeypatch):
    monkeypatch.setattr(ngram_join, "SORT_MERGE", merge)
    monkeypatch.setattr(ngram_join, "TABLE_BYTES", table)
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    sets = _family(500)
    unit = ngram_join.Unit(ngram_join.Rule(3, percent), sets)
    for i in range(len(sets)):
        unit.add(i)
    assert [unit.find(i) for i in range(len(sets))] == _components(sets, percent)


def test_time_of_a_large_family():
    sets = _family(3000)
    unit = ngram_join.Unit(ngram_join.Rule(3, 80), sets)
    start = time.process_time()
    for i in range(len(sets)):
        unit.add(i)
    assert time.process_time() - start < 6  # list by list it took 17 s, where this takes 1


@pytest.mark.parametrize("gb", [0.9, 10, 50, 200])
def test_rows_of_chunks_and_ranges(gb):
    """The rows of the exchange are in proportion to the input: of a thousand grams at least, but for the largest inputs."""
    bits, grams = ngram_join._layout(int(gb * 1e9))
    assert grams >> bits >= min(900, ngram_join.MOST_CHUNK_GRAMS >> bits)
    assert gb * 1e9 / (1 << bits) <= 16_000_000 and grams <= ngram_join.MOST_CHUNK_GRAMS


def test_large_blocks_read_their_texts_once(spark):
    """The pipeline's stage on a family of many units: the rounds of leaders don't make sets from the texts again."""
    rng = random.Random(5)
    texts = [[f"w{i}" for i in range(80)]]
    while len(texts) < 160:
        w = list(rng.choice(texts))
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ngram_join.prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).checkpoint().mapInArrow(count, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, rule=ngram_join.Rule(5, 80), unit=10).collect()}
    by_text = {ngram_join.set_key(ngram_join.gram_set(t, 5)): ngram_join.gram_set(t, 5) for _, t in rows}
    label = dict(zip(by_text, _components(list(by_text.values()), 80), strict=True))
    least = {}
    for i, t in rows:
        least.setdefault(label[ngram_join.set_key(ngram_join.gram_set(t, 5))], i)
    assert got == {i: least[label[ngram_join.set_key(ngram_join.gram_set(t, 5))]] for i, t in rows}
    assert read.value <= 3 * len(rows), read.value  # its size, the chunks, the sets
