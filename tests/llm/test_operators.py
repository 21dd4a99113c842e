import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import exact_dedup, language_id, mpeg_audio, ngram_join, packing, pii, quality_fm, repeats, sentencepiece_nbest, url_lists
from corpusloom.llm.queries import public_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, _max_x long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an extra column."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=60)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80))), rng.choice(["en", "de", None]), "s", 1) for i in range(120)]
    for i in range(120, 200):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(w), "en", "s", 2))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 1), (502, "Hi there", "en", "s", 1), (503, "hi THERE", "en", "s", 1), (504, "x" * 50_000, "en", "s", 1), (505, "7 7 7", "en", "s", 1)]
    rows += [rows[130]] * 3
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(odd, empty):
    rows, df = odd
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(by[text]), len(by[text]), hashlib.sha256(text.encode()).hexdigest())
        kept[text] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0
    small = exact_dedup.assign_groups(df, leaf_bytes=500)
    assert small.where("_kept").count() == len(by) and small.columns[:5] == df.columns


def test_radix_groups():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(500)]
    assert {frozenset(g) for g in exact_dedup.radix_groups(texts)} == {frozenset(i for i, t in enumerate(texts) if t == u) for u in set(texts)}


def _join(rows, n, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "unit"), [(3, 90, 5000), (5, 80, 20)])
def test_ngram_join(odd, empty, n, percent, unit):
    rows, df = odd
    got = ngram_join.jaccard_components(df, rule=ngram_join.Rule(n, percent), unit=unit)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _join(rows, n, percent)
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize(("n", "percent", "grams", "broadcast"), [(3, 90, 200, 0), (5, 80, 50, 500_000), (2, 60, 1, 0)])
def test_ngram_join_small_chunks(odd, n, percent, grams, broadcast, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", grams)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    got = ngram_join.jaccard_components(df.repartition(3, "doc_id").checkpoint(), rule=ngram_join.Rule(n, percent))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _join(rows, n, percent)


def test_packed_prints():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 1000):
        for top in (2, 300, 1 << 20, 1 << 48, 1 << 63):
            x = np.sort(rng.integers(0, top, n, np.uint64))
            assert (ngram_join.unpack(ngram_join.pack(x)) == x).all()


@pytest.mark.parametrize("merge", [0, 10**9])
def test_divide_skip(merge, monkeypatch):
    monkeypatch.setattr(ngram_join, "SORT_MERGE", merge)
    rng = random.Random(3)
    for _ in range(500):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 25))]
        need = rng.randint(1, len(lists) + 1)
        count = Counter(x for l in lists for x in l)
        assert ngram_join.divide_skip(lists, need) == sorted((k, v) for k, v in count.items() if v >= need)


def _repeats(rows, length=200):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[i : i + length] for _, t in raws for i in range(len(t) - length + 1))
    out = Counter()
    for d, t in raws:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        out[d, len(t), sum(mark), len(re.findall(b"\1+", mark)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("unit", [20_000, 10])
def test_repeats(odd, empty, unit):
    rows, df = odd
    assert Counter(map(tuple, repeats.repeat_digests(df, unit=unit).collect())) == _repeats(rows)
    assert repeats.repeat_digests(empty).count() == 0


def test_mpeg(odd, empty):
    rows, df = odd
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in mpeg_audio.media_digests(df).collect():
        payload = mpeg_audio.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert mpeg_audio.media_digests(empty).count() == 0
    stream = mpeg_audio.encode(b"abc" * 1000)
    s = mpeg_audio.parse_stream(stream)
    assert (s.samples, s.table["frames"], s.bad_crc, s.resyncs) == (6 * 576, 6, 0, 0)
    hurt = mpeg_audio.parse_stream(stream[: s.offsets[2]] + b"junk" + stream[s.offsets[2] :])
    assert (len(hurt.offsets), hurt.resyncs) == (6, 1)
    broken = bytearray(stream)
    broken[s.offsets[1] + 7] ^= 1
    assert mpeg_audio.parse_stream(bytes(broken)).bad_crc == 1
    assert mpeg_audio.parse_stream(b"no audio").offsets == []


def test_pii(spark, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..-_ 0123455+()é") for _ in range(rng.randint(0, 40)))
        want = []
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                    want.append((k, *m.span()))
        assert pii.find_base(t)[0] == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    df = spark.createDataFrame([(1, "call 415-555-1234 or mail joe (at) mail (dot) com"), (2, None), (3, "10.0.0.1 +1 (415) 555-1234")] + [(9 + i, f"phone: 415-555-{1000 + i}") for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_spans(df).collect()}
    assert got[3].spans == "ip:0:8,phone:9:26" and got[2].spans == "" and "phone:5:17" in got[1].spans
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[3] == "[IP] [PHONE]"
    assert pii.pii_spans(empty).count() == 0


def test_segments(odd, empty):
    rows, df = odd
    path = public_vocabulary("piece_bpe_32k.model")
    s = sentencepiece_nbest.Segmenter(path)
    v = s.vocabulary

    def paths(edges, at):
        if at == 0:
            yield 0.0, ()
        for a, own, ids in edges[at] if at else ():
            for x, p in paths(edges, a):
                yield x + own, p + ids

    rng = random.Random(2)
    for _ in range(150):
        t = "".join(rng.choice("the and. ñ😀\n,x  ing") for _ in range(rng.randint(0, 9)))
        got, edges = s.segment(t), v.edges(s.normalize(t))
        want = sorted((x for x, _ in paths(edges, len(edges) - 1)), reverse=True)[:4]
        assert [round(x, 9) for x, _ in got] == [round(x, 9) for x in want] and len({i for _, i in got}) == len(got)
        assert all(v.decode(np.frombuffer(i, "<u4").tolist()) == t for _, i in got)
    assert all(r.decoded_equal for r in sentencepiece_nbest.n_best_digests(df, path).collect())
    assert sentencepiece_nbest.n_best_digests(empty, path).count() == 0


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    rows, df = odd
    path = public_vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encode = packing.Encoder(path)
    for text in ["it's  two\n\n spaces \t", "naïve 12³ café!", "日本 <|endoftext|>", "", "a\x1cb", *(r[1] or "" for r in rows[:20])]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    got = packing.pack_documents(df, path).toPandas()
    assert got["length"].sum() == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert packing.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.pack_documents(empty, path).count() == 0
    rng = random.Random(5)
    lengths = [rng.randint(300, 1200) for _ in range(600)]
    before = packing.best_fit(lengths)
    after = packing.improve([list(b) for b in before], lengths)
    assert len(after) <= len(before) and sorted(i for b in after for i in b) == list(range(600)) and all(sum(lengths[i] for i in b) <= 2048 for b in after)


def test_learned(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = language_id.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    scored = quality_fm.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((scored["score"] >= 0.3) == (scored["quality"] == 1)).mean() > 0.93
    und = {r.doc_id: r.lang_pred for r in language_id.language_ids(odd[1]).collect()}
    assert und[500] == und[501] == und[505] == "und"
    assert language_id.language_ids(empty).count() == 0 and quality_fm.quality_scores(empty, labels.limit(0)).count() == 0
    m = quality_fm.Machine(0.1, np.arange(4, dtype=np.float32) / 10, np.arange(8, dtype=np.float32).reshape(4, 2) / 9)
    i, x = np.array([0, 1, 3]), np.array([1.0, 2.0, 0.5], np.float32)
    pairs = sum(float(m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(3), 2))
    assert abs(m.margin(i, x) - (0.1 + float(m.linear[i] @ x) + pairs)) < 1e-5


def test_urls(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    entries = spark.createDataFrame([("host", "a.com", "spam", "add", day(5)), ("host", "a.com", "spam", "remove", day(9)), ("domain", "b.org", "bad", "add", day(1)), (None, "x", "y", "add", day(1))], url_lists.ENTRY_SCHEMA)
    rows = [(1, "http://A.com/x", day(4)), (1, "http://A.com/x", day(4)), (2, "http://a.com:80/", day(5)), (3, "https://a.com", day(9)), (4, "https://x.y.b.org/p", day(2)), (5, None, day(2)), (6, "nonsense", day(2)), (7, "http://a.com", None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp")
    got = sorted((r.page_id, r.blocked) for r in url_lists.filter_urls(captures, entries).collect())
    assert got == [(1, False), (1, False), (2, True), (3, False), (4, True), (5, False), (6, False), (7, False)]
    assert url_lists.filter_urls(captures.limit(0), entries).count() == 0 and not any(r.blocked for r in url_lists.filter_urls(captures, entries.limit(0)).collect())


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, d).cache()
        assert rows.columns == docs.columns and 0 < rows.count() <= before.count()
    texts = [r.text for r in rows.collect()]
    assert len(set(texts)) == len(texts) and not any(pii.find_base(t)[0] for t in texts)
