"""Segmentations that score the same, and texts that score the same."""

import numpy as np

from corpusloom.llm import quality_fm, sentencepiece_nbest
from corpusloom.llm.queries import public_vocabulary


def test_equal_segmentations():
    path = public_vocabulary("piece_bpe_32k.model")
    first, again = sentencepiece_nbest.Segmenter(path), sentencepiece_nbest.Segmenter(path)
    texts = ["aaa", "aaaaaaa", "the the the the", "zzzzzzzzz zzzzzzzzz", "1111111", "😀😀😀", "xyxyxyxyx"]
    want = [first.segment(t) for t in texts]
    for t in reversed(texts):  # what is kept before doesn't count
        again.segment(t)
    assert [again.segment(t) for t in texts] == want == [first.segment(t) for t in texts]
    tied = 0
    for found in want:
        scores = [round(s, 9) for s, _ in found]
        assert scores == sorted(scores, reverse=True) and len({ids for _, ids in found}) == len(found)
        tied += len(set(scores)) < len(scores)
    assert tied


def test_parts_are_kept_in_bounds():
    s = sentencepiece_nbest.Segmenter(public_vocabulary("piece_bpe_32k.model"))
    s.LIMIT = 20_000
    fresh = sentencepiece_nbest.Segmenter(public_vocabulary("piece_bpe_32k.model"))
    for k in range(300):
        t = f"word{k} other{k * 7} " + "q" * (k * 40 % 9000)
        assert s.segment(t) == fresh.segment(t) and s.held <= s.LIMIT + 50_000


def test_batched_scores():
    rng = np.random.default_rng(3)
    m = quality_fm.Machine(0.2, rng.normal(size=quality_fm.SIZE).astype(np.float32), rng.normal(0, 0.1, (quality_fm.SIZE, quality_fm.RANK)).astype(np.float32))
    f = quality_fm.Featurizer()
    rows = [f(t) for t in ["", "a word", "a word", "Many more words, 12 of them!" * 30, "x" * 100_000]]
    got = m.scores(rows)
    assert np.abs(got - [m.score(*r) for r in rows]).max() < 1e-4 and got[1] == got[2] and m.scores([]).size == 0
    for (i, x), p in zip(rows[:2], got, strict=False):  # all pairs, one by one
        pairs = sum(float(m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        margin = m.bias + float(m.linear[i] @ x) + pairs
        assert abs(1 / (1 + np.exp(-np.clip(margin, -30, 30))) - p) < 1e-4
