"""Letters, the kernel solved directly, addresses as hosts, ids of sequences, ties."""

import datetime as dt

import numpy as np
import pytest

from corpusloom.llm import language_id, packing, url_lists
from corpusloom.llm.queries import public_vocabulary

DAY = dt.datetime(2024, 1, 2)


def _plain_grams(text):
    fold = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in f" {text.lower()} ").encode()
    return {fold[i : i + n] for n in (1, 2, 3) for i in range(len(fold) - n + 1)}


def test_grams_are_exact():
    place = np.zeros(language_id.SIZE, np.int32)
    for text in ["", "a", "Aé!", "the the the", "ß" * 50, "x" * 3000, "日本語 and more"]:
        found = language_id.grams(text, place)
        assert len(set(found.tolist())) == len(found) == len(_plain_grams(text))


def test_the_kernel_solved_directly():
    texts = [("de", "der hund und die katze"), ("de", "das haus und der baum"), ("en", "the dog and the cat"), ("en", "the house by the tree"), ("fr", "le chien et le chat"), ("fr", "la maison et les arbres"), ("en", "a cat on a mat")]
    place = np.zeros(language_id.SIZE, np.int32)
    model = language_id.solve([(lang, np.sort(language_id.grams(t, place))) for lang, t in texts], landmarks=6)
    kernel = lambda a, b: len(_plain_grams(a) & _plain_grams(b)) / np.sqrt(len(_plain_grams(a)) * len(_plain_grams(b)))
    languages = ["de", "en", "fr"]
    marks = [t for lang in languages for t in [x for y, x in texts if y == lang][:4]]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(t, m) for m in marks] for _, t in texts]) @ half
    n = {lang: sum(x == lang for x, _ in texts) for lang in languages}
    w = np.array([1 / n[lang] / 3 for lang, _ in texts])
    y = np.array([[1.0 if lang == l else -1.0 for l in languages] for lang, _ in texts])
    beta = np.linalg.solve(phi.T @ (w[:, None] * phi) + language_id.RIDGE * np.eye(phi.shape[1]), phi.T @ (w[:, None] * y))
    new = ["die katze", "the mat", "les chats", "qqq zzz", "x"]
    want = np.array([[kernel(t, m) for m in marks] for t in new]) @ half @ beta
    assert np.abs(model.scores(new) - want).max() < 1e-3


def test_letters_and_ties():
    model = language_id.Model(["aa", "bb"], np.zeros(0, np.int32), np.zeros((1, 2), np.float32))
    got = model.predict(["½ ² 12", "Ⅷ ①", "٣", "", "word", "日", "x" * 400_000])
    assert [g[0] for g in got] == ["und"] * 4 + ["aa"] * 3 and got[4][1] == 0.5


@pytest.mark.parametrize(
    ("kind", "pattern", "url", "blocked"),
    [
        ("domain", "0.1", "http://10.0.0.1/", False),
        ("host", "10.0.0.1", "http://10.0.0.1:80/", True),
        ("host", "a.com", "http://a.com./x", True),
        ("host", "a.com", "http://user:p@ss@a.com/", True),
        ("host", "[2001:db8::1]", "http://[2001:db8::1]:8080/x", True),
        ("domain", "db8::1]", "http://[2001:db8::1]/", False),
        ("path", "[::1]/a", "http://[::1]/a/b", True),
        ("domain", "com", "http://a.com", True),
        ("path", "h.com/" + "/".join("abcdefgh"), "http://h.com/" + "/".join("abcdefghij") + "x" * 50_000, True),
    ],
)
def test_hosts(spark, kind, pattern, url, blocked):
    entries = spark.createDataFrame([(kind, pattern, "bad", "add", DAY)], url_lists.ENTRY_SCHEMA)
    got = url_lists.filter_urls(spark.createDataFrame([(1, url, DAY)], "page_id long, url string, fetched_at timestamp"), entries).collect()
    assert [r.blocked for r in got] == [blocked]


def test_ids_of_sequences(spark):
    from tokenizers import Tokenizer

    path = public_vocabulary("byte_bpe_50k.json")
    rows = [(i, "some words of a text " * (i * 7 % 40)) for i in range(60)] + [(60, None), (61, "word " * 6000), (61, "word " * 6000)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, with_ids=True).checkpoint()
    t, want = Tokenizer.from_file(path), {}
    for i, text in rows:
        want[i] = [*t.encode(text or "", add_special_tokens=False).ids, 0]
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and len(ids) == r.length
    whole = {r.sequence_id: (r.length, r.ids) for r in packing.sequences(packed).collect()}
    assert all(len(ids) == 4 * n <= 4 * 2048 for n, ids in whole.values())
    for r in packed.collect():
        assert whole[r.sequence_id][1][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
