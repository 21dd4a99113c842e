"""EM against a version over single candidates, planted spans, and odd tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import pii

SCHEMA = "doc_id long, text string"


def plain_em(rows, rounds=100):
    """Dawid and Skene over single candidates, in plain loops with the operator's priors."""
    labelers = len(rows[0])
    start = pii.Kind().chance
    share, chance = 0.5, [[list(start[c][j]) for j in range(labelers)] for c in (0, 1)]

    def truth(v):
        a = math.log(share) + sum(math.log(chance[0][j][x + 1]) for j, x in enumerate(v))
        b = math.log(1 - share) + sum(math.log(chance[1][j][x + 1]) for j, x in enumerate(v))
        return 1 / (1 + math.exp(min(700, b - a)))

    for _ in range(rounds):
        p = [truth(v) for v in rows]
        share = (sum(p) + pii.PRIOR_SHARE / 2) / (len(rows) + pii.PRIOR_SHARE)
        for c in (0, 1):
            for j in range(labelers):
                seen = [pii.PRIOR * start[c][j][k] + sum((q if c == 0 else 1 - q) for q, v in zip(p, rows, strict=True) if v[j] == k - 1) for k in range(3)]
                chance[c][j] = [x / sum(seen) for x in seen]
    return share, chance, [truth(v) for v in rows]


def test_em_equals_a_plain_version():
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        true = rng.random() < 0.3
        rows.append(tuple(rng.choices((-1, 0, 1), (1, 2, 7) if true else (6, 3, 1))[0] for _ in pii.LABELERS))
    share, chance, p = plain_em(rows)
    model = pii.estimate(Counter(("card", *v) for v in rows))["card"]
    assert abs(model.share - share) < 1e-9 and np.abs(model.chance - np.array(chance)).max() < 1e-9
    assert np.abs(pii.posterior(model, np.array(rows)) - np.array(p)).max() < 1e-9


def _card(rng):
    digits = "4" + "".join(rng.choices("0123456789", k=14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def _planted(rng, kind):
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "email":
        name, host, top = rng.choice(["ann", "joe.b", "info"]), rng.choice(["mail", "firma", "site"]), rng.choice(["com", "de", "org"])
        return rng.choice([f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}.{top}", f"{name}＠{host}.{top}"]), rng.choice(["email", "contact", "mail", "over"])
    if kind == "ip":
        a = [str(rng.randint(11, 250)) for _ in range(4)]
        return rng.choice(["[.]".join(a), "(.)".join(a), f"2001:db8:{rng.randint(1, 9999)}::{rng.randint(1, 999)}"]), rng.choice(["host", "server", "from"])
    if kind == "card":
        c = _card(rng)
        return rng.choice([".", "/", "–"]).join(c[i : i + 4] for i in range(0, 16, 4)), rng.choice(["card", "visa", "with"])
    return rng.choice([f"(4{d(2).replace('1', '2')}) 555-{d(4)}", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{rng.randint(20, 99)} / {d(7)}".replace(" / ", "/"), f"6{d(2)} {d(3)} {d(3)}"]), rng.choice(["call", "tel", "phone", "then"])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = "stone river the wind carries over old houses and people walk slowly home again".split()
    rows, wanted, clean = [], [], []
    say = lambda n: " ".join(rng.choices(words, k=n))
    for i in range(400):
        kind = pii.KINDS[i % 4]
        span, cue = _planted(rng, kind)
        text = f"{say(rng.randint(0, 9))} {cue} "
        rows.append((i, f"{text}{span} {say(5)}"))
        wanted.append((kind, len(text), len(text) + len(span)))
    for i in range(400, 700):  # numbers and words that are no personal data
        n = rng.choice([f"on {rng.randint(1950, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"version {rng.randint(1, 9)}.{rng.randint(300, 999)}.{rng.randint(1, 9)}.{rng.randint(300, 999)}", f"order no {rng.randint(10**11, 10**12)}0", f"{rng.randint(1, 999)},{rng.randint(100, 999)},{rng.randint(100, 999)} people", f"isbn 978-{rng.randint(0, 9)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-0", "look at house and dot it", f"{rng.randint(1900, 1999)} - {rng.randint(2000, 2024)}", "token = a3f61e" + str(rng.randint(10**8, 10**9)) + "bc9"])
        rows.append((i, f"{say(6)} {n} {say(4)}"))
        clean.append(i)
    for i in range(700, 900):  # base spans, which are labelled too
        rows.append((i, f"{say(4)} " + [f"mail ann{i}@mail.com", f"server 10.{i % 250}.7.{i % 200}", f"card {_card(rng)}", f"call +1 (415) 555-{1000 + i}"][i % 4] + f" {say(3)}"))
    return rows, wanted, clean


def test_planted_spans_are_found(spark, corpus):
    rows, wanted, clean = corpus
    got = {r.doc_id: r for r in pii.pii_spans(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    texts = dict(rows)
    for kind in pii.KINDS:
        mine = [(i, s) for i, s in enumerate(wanted) if s[0] == kind]
        hit = [any(k == kind and int(a) < s[2] and int(b) > s[1] for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)) for i, s in mine]
        assert sum(hit) >= 0.9 * len(hit), (kind, [texts[i] for (i, _), h in zip(mine, hit, strict=True) if not h][:5])
    added = [texts[i] for i in clean if got[i].n_added]
    assert len(added) <= 0.05 * len(clean), added[:5]
    for i, text in rows:
        base = pii.find_base(text)[0]
        assert set(pii.join_spans(base).split(",")) - {""} <= set(got[i].spans.split(","))


def test_form_votes_differ_within_each_kind(corpus):
    seen = {k: set() for k in pii.KINDS}
    for _, text in corpus[0]:
        for span, v, _ in pii.profile(text)[1]:
            seen[span[0]].add(v[0])
    assert all(len(x) > 1 for x in seen.values()), seen


def test_numbers_side_by_side():
    text = "paid 4465758382889437 4465758382889437 today"
    windows = {s for s, _, _ in pii.profile(text)[1] if s[0] == "card"}
    assert {("card", 5, 21), ("card", 22, 38)} <= windows


def test_ties_nulls_and_long_texts(spark):
    same = [(("card", 0, 16), 0.9), (("phone", 0, 16), 0.9), (("phone", 0, 12), 0.99)]
    assert pii.choose([], same) == pii.choose([], same[::-1]) == [("card", 0, 16)]
    rows = [(1, None), (2, ""), (3, "1" * 200_000), (4, "@" * 50_000), (5, "a." * 50_000 + "@x"), (None, "call (415) 555-1234"), (6, "1 " * 50_000), (6, "1 " * 50_000)]
    got = pii.pii_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {r.spans for r in got if r.doc_id in (1, 2)} == {""}
    assert len({(r.spans, r.base_sha256) for r in got if r.doc_id == 6}) == 1


def test_the_same_spans_in_redacted_texts(spark, corpus):
    df = spark.createDataFrame([(*r, 1) for r in corpus[0]], SCHEMA + ", votes int")
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert all(got[i].text == pii.redact_text(t, model) and got[i].votes == 1 for i, t in corpus[0][:100])
