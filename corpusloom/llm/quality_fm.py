"""Quality classifier: a factorisation machine.

Inputs of a text: its distinct hashed words, the hashed shapes of its words, and structure statistics with its length as
metadata. Score: logistic of w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the inputs.
Fitted by AdaGrad on at most MAX_ROWS labelled rows, taken by a hash of the id; classes weigh alike. Texts are scored some at a time,
by one gather and sums over each text's inputs.

Defined results: null and empty texts are scored from their statistics; very long texts are read whole; equal texts score equally; of several labels of an
id the largest counts; a label for a text that is missing is unused; with no labels every score is 0.5; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_and_text, is_held_out, map_batches, prepare

BITS, RANK = 15, 8
MAX_ROWS, EPOCHS, RATE, DECAY = 6000, 8, 0.08, 1e-4
THRESHOLD = 0.3
WORDS = 1 << BITS
N_STATS = 16
SIZE = WORDS + N_STATS
_SHAPES = ((re.compile(r"[a-zß-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0"))


def _share(n: int, of: int) -> float:
    return n / of if of else 0.0


_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    raw = text.encode()
    n = len(raw)
    lower, upper, digit, space, high = (n - len(raw.translate(None, s)) for s in (_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH))
    lines = text.split("\n")
    symbols = n - lower - upper - digit - space - high
    return [
        np.log1p(n) / 10, np.log1p(len(words)) / 8, np.log1p(len(lines)) / 6, _share(lower, n), _share(upper, n) * 4, _share(digit, n) * 10, _share(space, n) * 5, _share(high, n) * 5, _share(symbols, n) * 8,
        _share(distinct, len(words)), _share(n, len(words)) / 8, _share(len(set(lines)), len(lines)), _share(raw.count(b"."), len(words)) * 5, _share(raw.count(b"|"), len(words)) * 3, _share(raw.count(b"!"), len(words)) * 2, 1.0 if not n else 0.0,
    ]


class Featurizer:
    """Text to (numbers, values). Keeps hashes of words it has met, at most LIMIT."""

    LIMIT = 200_000

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _hash(self, word: str) -> tuple[int, int]:
        shape = word
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        return zlib.crc32(word.lower().encode()) & WORDS - 1, zlib.crc32(b"shape " + shape.encode()) & WORDS - 1

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        distinct = Counter(words)
        known, numbers, shapes = self.known, set(), Counter()
        for word, n in distinct.items():
            if (pair := known.get(word)) is None:
                pair = self._hash(word)
                if len(word) <= 40:
                    known[word] = pair
            numbers.add(pair[0])
            shapes[pair[1]] += n
        if len(known) > self.LIMIT:
            known.clear()
        stats = statistics(text, words, len(distinct))
        a = np.fromiter(numbers, np.int64, len(numbers))
        b = np.fromiter(shapes.keys(), np.int64, len(shapes))
        order = np.argsort(b)
        share = np.fromiter(shapes.values(), np.float32, len(shapes))[order] / max(1, len(words))
        index = np.concatenate([np.sort(a), b[order], np.arange(WORDS, SIZE)])
        value = np.concatenate([np.full(len(a), 1 / np.sqrt(max(1, len(a))), np.float32), np.sqrt(share), np.array(stats, np.float32)])
        return index, value


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        s = v.sum(0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (s @ s - (v * v).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, value), -30, 30))))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of many texts at once: one gather, and sums by text. No text is without inputs."""
        if not rows:
            return np.zeros(0)
        index, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        at = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        v = self.factors[index] * value[:, None]
        s = np.add.reduceat(v, at, axis=0, dtype=np.float64)
        margin = self.bias + np.add.reduceat(self.linear[index] * value, at, dtype=np.float64) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at, dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32))
    n = [sum(y == c for y, _, _ in rows) for c in (0, 1)]
    if not all(n):
        m.factors[:] = 0
        m.bias = 0.0 if not rows else 4.0 if n[1] else -4.0
        return m
    weight = [len(rows) / (2 * x) for x in n]
    past_b, past_w, past_v = 1.0, np.ones(SIZE, np.float32), np.ones((SIZE, RANK), np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, index, x = rows[i]
            v = m.factors[index]
            s = (v * x[:, None]).sum(0)
            g = weight[y] * (m.score(index, x) - y)
            gw = g * x + DECAY * m.linear[index]
            gv = g * (x[:, None] * s - v * (x * x)[:, None]) + DECAY * v
            past_b += g * g
            past_w[index] += gw * gw
            past_v[index] += gv * gv
            m.bias -= RATE * g / past_b**0.5
            m.linear[index] -= RATE * 3 * gw / np.sqrt(past_w[index])
            m.factors[index] -= RATE * gv / np.sqrt(past_v[index])
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """Learns from rows outside the held-out fold; the sampled labels, at most max_rows, are broadcast."""
    prepare(docs.sparkSession)
    wanted = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out())
    n = wanted.count()
    if n > max_rows:
        wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 900_000 * max_rows // n)
    wanted = wanted.limit(max_rows).groupBy("doc_id").agg(F.max("label").alias("label"))

    def run(batches):
        features = Featurizer()
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in found], pa.binary())], names=["doc_id", "label", "a", "b"])

    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(wanted), "doc_id").mapInArrow(run, "doc_id long, label int, a binary, b binary").limit(max_rows).collect()  # rows may share an id
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.a)))
    return train([(r.label, np.frombuffer(r.a, "<i4").astype(np.int64), np.frombuffer(r.b, "<f4")) for r in rows])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    features: list[Featurizer] = []

    def per_batch(batch):
        features or features.append(Featurizer())
        found = [features[0](t) for t in batch.column(1).to_pylist()]
        # some texts at a time, so that what is gathered stays small whatever the batch
        return {"doc_id": batch.column(0), "score": np.concatenate([shared.value.scores(found[k : k + 64]) for k in range(0, len(found), 64)] or [np.zeros(0)])}

    scored = map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
