"""Language identification with a string kernel.

Kernel: blended-spectrum presence of byte n-grams (1 to 3) of the lower-cased text, letters only, normalised:
k(x, y) = |grams(x) & grams(y)| / sqrt(|grams(x)| |grams(y)|); grams are numbered, not hashed. Nyström landmarks give features of rank <= m; one-versus-rest
kernel ridge regression is solved on them. The landmarks' presence matrix times the solution is one (grams x languages)
matrix, so a batch is scored by one product of its presence matrix with that matrix.

The fit learns every language there is, from a bounded sample of about PER_LANGUAGE rows of each, chosen by a hash of the id.
The sample's grams, not texts, come to the driver. Landmarks are LANDMARKS, or LEAST_LANDMARKS a language where that is more.

Defined results: a null text or one without a letter (as str.isalpha() has it) is `und` with score 0; equal texts score equally;
of languages that score the same the first by name is predicted; very long texts are read whole; with nothing to learn
from, every text is `und`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import id_and_text, is_held_out, map_batches, prepare

PER_LANGUAGE, LANDMARKS, LEAST_LANDMARKS = 300, 256, 4
RIDGE, SHARPNESS = 1e-3, 6.0
UNKNOWN = "und"
#: A letter is what str.isalpha() takes for one: not numbers such as a half or a roman numeral's sign.
_LETTER = regex.compile(r"\p{L}")
#: Bytes by sign: a to z, those of other letters, and one for all between words. A gram's number is exact: 1, 2 and 3 signs follow one another.
_FOLD = bytes(b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in range(256))
SIGNS = 155
SIZE = SIGNS + SIGNS**2 + SIGNS**3


def grams(text: str, place: np.ndarray) -> np.ndarray:
    """Numbers of the different n-grams of a text, in any order; place: SIZE numbers of any value, which are written over."""
    a = np.frombuffer(b"\0" + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b"\0", np.uint8).astype(np.int32)
    two = a[:-1] * SIGNS + a[1:]
    every = np.concatenate([a, two + SIGNS, two[:-1] * SIGNS + a[2:] + (SIGNS + SIGNS**2)])
    # of equal numbers the one that wrote last stays
    own = np.arange(len(every), dtype=np.int32)
    place[every] = own
    return every[place[every] == own]


@dataclass
class Model:
    """Weights of the grams that landmarks have; others weigh nothing, but count in a text's norm."""

    languages: list[str]
    used: np.ndarray  # numbers of grams, ascending
    weights: np.ndarray  # used grams, and one row of zeros, x languages

    def __post_init__(self) -> None:
        self.rows = self.place = None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Products of the texts' normalised presence rows with the weights."""
        if self.rows is None:  # made where it is used, not sent
            self.rows, self.place = np.full(SIZE, len(self.used), np.int32), np.zeros(SIZE, np.int32)
            self.rows[self.used] = np.arange(len(self.used), dtype=np.int32)
        found = [grams(t, self.place) for t in texts]
        starts = np.cumsum([0, *(len(r) for r in found[:-1])])
        sums = np.add.reduceat(self.weights[self.rows[np.concatenate(found)]], starts, axis=0)
        return sums / np.sqrt([len(r) for r in found])[:, None]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if _LETTER.search(t)] if self.languages else []
        for k in range(0, len(known), 64):
            part = known[k : k + 64]
            s = self.scores([texts[i] for i in part])
            p = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for i, j, x in zip(part, p.argmax(1), p.max(1), strict=True):
                out[i] = self.languages[j], float(x)
        return out


def solve(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS) -> Model:
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros(0, np.int32), np.zeros((1, 0), np.float32))
    by = defaultdict(list)
    for lang, r in rows:
        by[lang].append(r)
    each = max(LEAST_LANDMARKS, landmarks // len(languages))
    marks = [r for lang in languages for r in by[lang][:each]]
    used = np.unique(np.concatenate(marks))
    presence = np.zeros((len(used), len(marks)), np.float32)
    for j, r in enumerate(marks):
        presence[np.searchsorted(used, r), j] = 1 / np.sqrt(len(r))

    def kernel(r: np.ndarray) -> np.ndarray:
        at = np.searchsorted(used, r)
        at = at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] == r)]
        return presence[at].sum(0) / np.sqrt(len(r))

    values, vectors = np.linalg.eigh((presence.T @ presence).astype(np.float64))
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    # language by language, so that nothing has as many entries as rows times landmarks; a row's weight is one by the rows of its language and the languages
    square, sums = RIDGE * np.eye(half.shape[1]), []
    for lang in languages:
        phi = np.array([kernel(r) for r in by[lang]], np.float64) @ half
        w = 1 / len(phi) / len(languages)
        square += w * (phi.T @ phi)
        sums.append(w * phi.sum(0))
    # targets are 1 for a row's language and -1 for the others
    right = np.array(sums).T
    solution = half @ np.linalg.solve(square, 2 * right - right.sum(1, keepdims=True))
    weights = np.zeros((len(used) + 1, len(languages)), np.float32)
    weights[:-1] = presence @ solution
    return Model(languages, used.astype(np.int32), weights)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = F.greatest(F.lit(1), F.least(F.lit(1_000_000), F.floor(1_000_000 * per_language / F.count(F.lit(1)))))
    shares = rows.groupBy("lang").agg(share.alias("share"))

    def run(batches):
        place = np.zeros(SIZE, np.int32)
        for batch in batches:
            found = [np.sort(grams(t, place)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.astype("<i4").tobytes() for f in found], pa.binary())], names=["doc_id", "lang", "grams"])

    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("doc_id", "text", "lang")
    # where ids are null or repeat, a hash of them bounds nothing
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "grams"))
    found = sample.mapInArrow(run, "doc_id long, lang string, grams binary").withColumn("place", place).where(F.col("place") <= 2 * per_language).collect()
    return solve([(r.lang, np.frombuffer(r.grams, "<i4")) for r in sorted(found, key=lambda r: (r.lang, r.doc_id, bytes(r.grams)))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch):
        found = shared.value.predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": [l for l, _ in found], "score": [s for _, s in found]}

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, lang_pred string, score double")


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is predicted, or with nothing to learn from those with a letter; rows and columns are otherwise unchanged."""
    model = fit(docs, text_col=text_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if shared.value.languages:
                stays = [l != UNKNOWN for l, _ in shared.value.predict(texts)]
            else:
                stays = [_LETTER.search(t) is not None for t in texts]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
