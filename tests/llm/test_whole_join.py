"""The n-gram join with ids that are null or repeat, and at low percents."""

import random
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import ngram_join
from tests.llm.test_operators import _join

SCHEMA = "doc_id long, text string"


def _wanted(rows, n, percent):
    """Of _join over row numbers: components by text, named by their smallest id that isn't null."""
    label = {i: (size, low) for i, size, low in _join([(i, r[1]) for i, r in enumerate(rows)], n, percent)}
    ids = defaultdict(list)
    for i, (_, low) in label.items():
        ids[low].append(rows[i][0])
    # rows without a word link with nothing
    return Counter((r[0], label[i][0], min((x for x in ids[label[i][1]] if x is not None), default=None) if label[i][0] else r[0]) for i, r in enumerate(rows))


def _got(spark, rows, n, percent, unit=5000):
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint(), rule=ngram_join.Rule(n, percent), unit=unit)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    ngram_join.prepare(spark)


def _text(changed, base="w"):
    return " ".join(f"{changed[i]}{i}" if i in changed else f"{base}{i}" for i in range(40))


@pytest.mark.parametrize("unit", [5000, 1])
def test_null_id_bridge(spark, unit):
    a, bridge, b = _text({0: "a", 1: "a", 2: "a"}), _text({}), _text({39: "b", 38: "b", 37: "b"})
    rows = [(7, a), (None, bridge), (None, bridge), (3, b), (None, "all alone here"), (None, _text({}, "v")), (None, _text({5: "c"}, "v")), (None, ""), (9, None)]
    got = _got(spark, rows, 1, 80, unit)
    assert got == _wanted(rows, 1, 80)
    assert got[7, 40, 3] == got[3, 40, 3] == 1 and got[None, 40, 3] == 2


@pytest.mark.parametrize("unit", [5000, 1])
def test_one_id_with_two_texts(spark, unit):
    rows = [(5, _text({})), (5, _text({}, "v")), (1, _text({0: "a"})), (2, _text({0: "a"}, "v")), (5, "something else")]
    got = _got(spark, rows, 1, 80, unit)
    assert got == _wanted(rows, 1, 80) and got.total() == len(rows)


@pytest.mark.parametrize(("percent", "unit"), [(1, 5000), (10, 5000), (40, 5000), (50, 10), (51, 5000)])
def test_low_percent(spark, percent, unit):
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choices([f"g{i % 9}_{k}" for k in range(60)], k=rng.choice([5, 40, 200])) + [f"own{i}_{k}" for k in range(rng.choice([0, 30, 300]))])) for i in range(90)]
    assert _got(spark, rows, 1, percent, unit) == _wanted(rows, 1, percent)


def test_percent_out_of_bounds():
    for percent in (0, 101):
        with pytest.raises(ValueError):
            ngram_join.Rule(5, percent)
