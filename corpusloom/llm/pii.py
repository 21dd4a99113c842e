"""Personal data by weak supervision.

find_base() gives the fixed spans (e-mail, IP, card, phone). candidates() takes these and what looser patterns find: spelled
e-mails and ones without a top-level domain, IPv6 and defanged or overlong dotted numbers, cards in any grouping or inside
longer runs of digits, national and unseparated phone numbers. Five labelers vote on a candidate (1 for, -1 against, 0 abstains):

- form: strict patterns of the kind, and patterns of what it is mistaken for (dates, times, versions, amounts);
- check: the checksum, value ranges and numbers of digits;
- listed: gazetteers of top-level domains, calling codes, issuer ranges and special address blocks;
- cue: words before the span that name its kind, or another kind of number;
- edge: the characters around the span.

One pass writes the candidates with votes and features; counts of kind and votes (at most 4 * 3**5) come to the driver.
Expectation-maximisation over them estimates each labeler's reliability without labels. A logistic classifier is trained
on the posteriors of at most SAMPLE candidates of each kind, chosen by a hash, with votes and hashed features of span and context
as inputs; it decides on each candidate that is no base span. Base spans always stay; accepted candidates that touch no span
already taken are added, from the left, the longer first.

Defined results: null and empty texts have no spans; equal rows give equal rows; of candidates that start together the longer is
tried first, then in the order of KINDS; offsets are code points, end exclusive; an empty table gives an empty result and default
reliabilities; other columns are not read, and redact() keeps them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_and_text, map_batches, prepare

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "listed", "cue", "edge")
#: Rows of each kind that the classifier is trained on at most, its inputs, and the least probability of a span.
SAMPLE, INPUTS, THRESHOLD = 4000, 512, 0.5

#: The classes and shapes of the base patterns. A run of digits is tried from its start only, and an e-mail from its @, which finds the same leftmost matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, start)
            at = text.find("@", at + 1)
    return out


def find_base(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans by start, then kind as listed; and matches of card shape that failed, which are candidates."""
    out, failed = [("email", a, b) for a, b in _emails(text)], []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for kind, pattern, least, most in (("card", _CARD, 12, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() < least:
                continue
            digits = "".join(_DIGITS.findall(m[0]))
            if least <= len(digits) <= most:
                (out if kind == "phone" or luhn(digits) else failed).append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]))), failed


#: The looser patterns that candidates come from.
_AT, _DOT = r"(?:\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s|\s?@\s?|＠)", r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s|\.)"
_LOOSE_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,24}}){{0,4}}", re.I)
_MAYBE_EMAIL = re.compile(r"[@＠]|[(\[{]\s?at\s?[)\]}]|\sdot\s", re.I)
_LOOSE_IP = re.compile(r"(?<![\w.:])(?:[0-9]{1,3}(?:\s?[\[({]\.[\])}]\s?|\s?[\[({]dot[\])}]\s?|\.)){3}[0-9]{1,3}(?![\w])", re.I)
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_DIGIT_RUN = re.compile(r"[+(]?[0-9][0-9 ().\-/–·*xX]{5,}[0-9]")
_GROUPED = re.compile(r"[0-9]+")
#: What numbers are mistaken for.
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}\s?[-–/]\s?(?:19|20)[0-9]{2}")
_AMOUNT = re.compile(r"[0-9]{1,3}(?:[., ][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+[.,][0-9]+")
_NATIONAL = re.compile(
    r"(?:\(?[2-9][0-9]{2}\)?[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"  # 3-3-4
    r"|0[1-9](?:[ .-][0-9]{2}){4}"  # 0 and pairs
    r"|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9](?:[ .-][0-9]{2,3}){3}"  # nine digits in threes
    r"|\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,5})?"  # trunk prefix and subscriber
    r"|00[1-9][0-9]{0,2}[ .-]?[0-9(][0-9 ().-]{5,14}[0-9]|\+[0-9][ ().0-9-]+[0-9]"
)
_CARD_GROUPS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (16,), (15,), (4, 4, 4, 4, 3), (19,)})
#: Gazetteers. Calling codes are those of the numbering plan's zones; issuer ranges are (first, last, digits).
_GENERIC = frozenset("com net org edu gov mil int info biz name pro aero coop museum mobi jobs travel cat tel asia post xxx app dev page blog shop site online store tech xyz club live news cloud agency email".split())
_COUNTRIES = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr "
    "ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz "
    "na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
_CODES = frozenset(["1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(), *(f"{z}{n}" for z in ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99") for n in range(10))])
_ISSUERS = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14, 16)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (3528, 3589, (16, 19)), (62, 62, (16, 17, 18, 19)), (50, 50, (12, 13, 14, 15, 16, 17, 18, 19)), (56, 58, (12, 13, 14, 15, 16, 17, 18, 19)))
_CUES = {
    "email": frozenset("email e-mail mail mails contact write mailto correo courriel adresse address reach send escriba schreiben".split()),
    "ip": frozenset("ip ips ipv4 ipv6 host server address addr client login peer gateway dns proxy logged router subnet adresse".split()),
    "card": frozenset("card cards visa mastercard amex maestro credit debit payment pay charged pan tarjeta carte kreditkarte karte billing".split()),
    "phone": frozenset("phone tel call calls telephone mobile fax cell whatsapp ring dial sms hotline teléfono tfno móvil téléphone tél appelez telefon handy anrufen rufnummer tel.".split()),
}
_AGAINST = frozenset("order invoice version isbn issn doi id no nr number ref token serial sku ticket article page pages lot batch bestellung rechnung artikel facture commande pedido factura since from between year years anno jahr rfc build release v".split())
_WORDS = re.compile(r"[^\W\d_][\w.-]*")
_CONTEXT = 48


def candidates(text: str, base: list[Span], failed: list[Span]) -> list[Span]:
    """Base spans, failed cards, and what the looser patterns find beside them."""
    out = [*base, *failed]
    held = set(out)

    def put(*span) -> None:
        if span not in held:
            held.add(span)
            out.append(span)

    if _MAYBE_EMAIL.search(text):
        for m in _LOOSE_EMAIL.finditer(text):
            put("email", *m.span())
    if "." in text:
        for m in _LOOSE_IP.finditer(text):
            put("ip", *m.span())
    if "::" in text or text.count(":") > 6:
        for m in _IP6.finditer(text):
            if sum(map(bool, m[0].split(":"))) >= 2:
                put("ip", *m.span())
    for m in _DIGIT_RUN.finditer(text):
        a, b = m.span()
        groups = [g.span() for g in _GROUPED.finditer(text, a, b)]
        n = sum(y - x for x, y in groups)
        if 12 <= n <= 19:
            put("card", groups[0][0], b)
        if 7 <= n <= 15:
            put("phone", a, b)
        if n > 13 and len(groups) > 1:  # numbers beside each other: windows of whole groups
            for i in range(len(groups)):
                k = 0
                for j in range(i, min(i + 5, len(groups))):
                    k += groups[j][1] - groups[j][0]
                    if (i, j) != (0, len(groups) - 1):
                        if 13 <= k <= 16:
                            put("card", groups[i][0], groups[j][1])
                        elif 9 <= k <= 11 and j > i:
                            put("phone", groups[i][0] - (groups[i][0] > a and text[groups[i][0] - 1] in "+("), groups[j][1])
    return out


def _sign(good: bool, bad: bool = False) -> int:
    return 1 if good else -1 if bad else 0


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote of each of LABELERS."""
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    digits = "".join(_DIGITS.findall(s))
    if kind == "email":
        parts = re.split(r"\.|dot", re.split(r"@|＠|\bat\b", s.lower())[-1])
        top = re.sub(r"[^a-z0-9-]", "", parts[-1])
        strict = "@" in s and " " not in s and ".." not in s and s[0] not in ".%+-"
        form = _sign(strict or bool(re.search(r"[(\[{]\s?(?:at|dot)", s, re.I)), "@" not in s and "＠" not in s)
        check = _sign(len(parts) > 1 and top.isalpha() and 2 <= len(top) <= 24, len(parts) < 2 or not top.isalpha())
        listed = _sign(top in _GENERIC or top in _COUNTRIES, len(parts) > 1)
    elif kind == "ip":
        try:
            address = ipaddress.ip_address(re.sub(r"\.0+(?=[0-9])", ".", re.sub(r"\s?[\[({](?:\.|dot)[\])}]\s?", ".", s, flags=re.I)).lstrip("0") or "0") if ":" not in s else ipaddress.ip_address(s)
        except ValueError:
            address = None
        form = _sign(bool(re.fullmatch(r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|\s?[\[({](?:\.|dot)[\])}]\s?|$)){4}", s, re.I)) or (":" in s and (s.count(":") >= 3 or "::" in s)), bool(re.search(r"(?:^|\.)0[0-9]", s)))
        check = _sign(address is not None, address is None)
        listed = _sign(address is not None and (address.is_private or address.is_global), address is None or address.is_unspecified or address.is_multicast)
    elif kind == "card":
        groups = tuple(len(g) for g in _DIGITS.findall(s))
        form = _sign(groups in _CARD_GROUPS, bool(_DATE.search(s)) or len(groups) > 6)
        check = _sign(luhn(digits) and 12 <= len(digits) <= 19, True)
        listed = _sign(any(lo <= int(digits[: len(str(lo))] or 0) <= hi and len(digits) in sizes for lo, hi, sizes in _ISSUERS), True)
    else:
        form = _sign(bool(_NATIONAL.fullmatch(s)), bool(_DATE.fullmatch(s) or _AMOUNT.fullmatch(s)) or len(set(digits)) < 3)
        check = _sign(9 <= len(digits) <= 13, len(digits) < 7 or len(digits) > 15)
        abroad = digits[2:] if s.startswith("00") else digits if s.startswith("+") else ""
        national = s[:1] == "0" or s[:2] == "(0" or (len(digits) == 10 and digits[0] > "1" and digits[3] > "1" and digits[1:3] != "11") or (len(digits) == 9 and digits[0] in "6789")
        listed = _sign(any(abroad[:k] in _CODES for k in (1, 2, 3)) if abroad else national, True)
    words = [w.rstrip(".").lower() for w in _WORDS.findall(text[max(0, a - _CONTEXT) : a])[-4:]]
    other = any(w in _CUES[k] for k in KINDS if k != kind for w in words[-1:])
    cue = _sign(any(w in _CUES[kind] for w in words), other or any(w in _AGAINST for w in words[-2:]))
    quiet = not (before.isalnum() or before in ("#", "$", "€", "£", "=", "_", "/", "\\")) and not (after.isalnum() or after in ("%", "€", "$", "_", "="))
    edge = _sign(quiet, True)
    return form, check, listed, cue, edge


def inputs(text: str, span: Span, v: tuple[int, ...]) -> list[int]:
    """Numbers of the classifier's inputs that are on: each labeler's vote, and hashed features of the span and its context."""
    kind, a, b = span
    s = text[a:b]
    out = [0, *(1 + 3 * j + x + 1 for j, x in enumerate(v))]
    shape = re.sub(r"[a-zA-Z]+", "a", re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), s))
    words = [w.lower() for w in _WORDS.findall(text[max(0, a - _CONTEXT) : a])[-2:]]
    found = [f"shape {shape[:24]}", f"digits {sum(c.isdigit() for c in s)}", f"length {min(40, b - a) // 4}", f"first {s[0] if not s[0].isalpha() else 'a'}", f"before {text[max(0, a - 1) : a]}", f"after {text[b : b + 1]}", *(f"word {w}" for w in words)]
    low = 1 + 3 * len(LABELERS)
    return out + sorted({low + zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % (INPUTS - low) for x in found})


@dataclass
class Kind:
    """Of one kind: share of true candidates, chances of each vote by class and labeler, and the classifier's weights."""

    share: float = 0.5
    chance: np.ndarray = field(default_factory=lambda: np.array([[[0.15, 0.25, 0.6]] * len(LABELERS), [[0.6, 0.25, 0.15]] * len(LABELERS)]))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(INPUTS))


#: Counts that a labeler is held to be better than chance by, and those of the share.
PRIOR, PRIOR_SHARE = 8.0, 4.0


def posterior(model: Kind, patterns: np.ndarray) -> np.ndarray:
    """The probability that a candidate of these votes (rows of -1, 0, 1) is true."""
    at = (np.arange(patterns.shape[1]), patterns + 1)
    true, false = (np.log(model.chance[c][at]).sum(1) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(false + math.log(1 - model.share) - true - math.log(model.share), -700, 700)))


def estimate(counts: dict[tuple, int], rounds: int = 100) -> dict[str, Kind]:
    """Dawid and Skene's EM by kind, over counts of (kind, votes...)."""
    out = {}
    start = Kind().chance
    for kind in KINDS:
        model = out[kind] = Kind()
        rows = sorted((k[1:], n) for k, n in counts.items() if k[0] == kind)
        if not rows:
            continue
        patterns, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        one = [patterns == x for x in (-1, 0, 1)]
        for _ in range(rounds):
            p = posterior(model, patterns)
            model.share = float((n @ p + PRIOR_SHARE / 2) / (n.sum() + PRIOR_SHARE))
            for c, w in ((0, n * p), (1, n * (1 - p))):
                seen = np.stack([w @ x for x in one], axis=1) + PRIOR * start[c]
                model.chance[c] = seen / seen.sum(1, keepdims=True)
    return out


def train(model: Kind, sample: list[list[int]], target: np.ndarray, steps: int = 300, decay: float = 1e-3) -> None:
    """The logistic classifier of a kind, fitted to soft labels by gradient steps of its own curvature bound."""
    if not sample:
        return
    x = np.zeros((len(sample), INPUTS))
    for i, on in enumerate(sample):
        x[i, on] = 1
    used = np.flatnonzero(x.any(0))
    z, w = x[:, used], np.zeros(len(used))
    rate = 4 / max(1.0, np.linalg.norm(z, 2) ** 2 / len(z))
    for _ in range(steps):
        w += rate * (z.T @ (target - 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))) / len(z) - decay * w)
    model.weights[:] = 0
    model.weights[used] = w


def probability(model: Kind, on: list[int]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(model.weights[on].sum())))))


def profile(text: str) -> tuple[list[Span], list[tuple[Span, tuple[int, ...], list[int]]]]:
    """Base spans; and every candidate with its votes and inputs."""
    base, failed = find_base(text)
    found = []
    for span in candidates(text, base, failed):
        v = votes(text, span)
        found.append((span, v, inputs(text, span, v)))
    return base, found


def choose(base: list[Span], scored: list[tuple[Span, float]], threshold: float = THRESHOLD) -> list[Span]:
    """Base spans and the accepted candidates beside them, by start, then kind as listed."""
    spans, taken, last = list(base), [], 0
    for _, a, b in sorted(base, key=lambda s: s[1:]):  # base spans of different kinds may overlap
        if taken and taken[-1][1] >= a:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    for span, p in sorted(scored, key=lambda x: (x[0][1], -x[0][2], KINDS.index(x[0][0]))):
        _, a, b = span
        i = bisect_right(taken, (a, math.inf))
        if p >= threshold and a >= last and (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            spans.append(span)
            last = b
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_all(text: str, model: dict[str, Kind], threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the method's own."""
    base, found = profile(text)
    known = set(base)
    return base, choose(base, [(s, probability(model[s[0]], on)) for s, _, on in found if s not in known], threshold)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_PROFILE = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans array<string>, kinds array<string>, votes array<string>, inputs array<string>"


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By document: base spans, and spans, votes and inputs of its candidates. It has no texts."""

    def per_batch(batch):
        rows = [profile(t) for t in batch.column(1).to_pylist()]
        counts = [Counter(s[0] for s in base) for base, _ in rows]
        return {"doc_id": batch.column(0)} | {f"n_{k}": [c[k] for c in counts] for k in KINDS} | {
            "base": [join_spans(b) for b, _ in rows], "spans": [[f"{s[1]}:{s[2]}" for s, _, _ in f] for _, f in rows], "kinds": [[s[0] for s, _, _ in f] for _, f in rows],
            "votes": [["".join("-0+"[x + 1] for x in v) for _, v, _ in f] for _, f in rows], "inputs": [[" ".join(map(str, on)) for _, _, on in f] for _, f in rows],
        }

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, _PROFILE)


def fit_profiles(found: DataFrame, sample: int = SAMPLE) -> dict[str, Kind]:
    """The model from all candidates: EM over their counts, and the classifier from a sample of bounded size."""
    each = found.select("doc_id", F.explode(F.arrays_zip("kinds", "votes", "inputs", "spans")).alias("c")).select("doc_id", "c.*")
    rows = each.groupBy("kinds", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    sign = {"-": -1, "0": 0, "+": 1}
    model = estimate({(r.kinds, *(sign[c] for c in r.votes)): r.n for r in rows})
    total = Counter()
    for r in rows:
        total[r.kinds] += r.n
    place = F.pmod(F.xxhash64("doc_id", "spans", "kinds"), F.lit(1_000_000))
    chosen = None
    for kind, n in sorted(total.items()):
        # about as many as wanted, and never more
        part = each.where((F.col("kinds") == kind) & (place < math.ceil(1_000_000 * min(1.0, 1.2 * sample / n)))).select("kinds", "votes", "inputs", F.xxhash64("doc_id", "spans").alias("h")).orderBy("h", "votes", "inputs").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    by: dict[str, list] = {k: [] for k in KINDS}
    for r in chosen.collect() if chosen is not None else ():
        by[r.kinds].append((r.votes, [int(x) for x in r.inputs.split()]))
    for kind, got in by.items():
        got.sort()
        if got:
            train(model[kind], [on for _, on in got], posterior(model[kind], np.array([[sign[c] for c in v] for v, _ in got])))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Kind]:
    prepare(docs.sparkSession)
    return fit_profiles(profiles(docs, id_col, text_col).where(F.size("kinds") > 0).checkpoint())


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added. The texts are read once."""
    prepare(docs.sparkSession)
    found = profiles(docs, id_col, text_col).checkpoint()
    model = fit_profiles(found)

    def per_batch(batch):
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        spans, added = [], []
        for text, places, kinds, on in zip(c["base"], c["spans"], c["kinds"], c["inputs"], strict=True):
            base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(","))] if text else []
            known, scored = set(base), []
            for place, kind, numbers in zip(places, kinds, on, strict=True):
                a, _, b = place.partition(":")
                if (s := (kind, int(a), int(b))) not in known:
                    scored.append((s, probability(model[kind], [int(x) for x in numbers.split()])))
            every = choose(base, scored) if scored else base
            spans.append(join_spans(every))
            added.append(len(every) - len(base))
        return {"doc_id": batch.column(0)} | {f"n_{k}": c[f"n_{k}"] for k in KINDS} | {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in c["base"]], "spans": spans, "n_added": added}

    return map_batches(found, per_batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str, model: dict[str, Kind]) -> str:
    """Each span as its kind in brackets; spans that overlap go as one, under the first one's kind."""
    out, last = [], 0
    for kind, a, b in find_all(text, model)[1]:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans replaced in text_col; null stays null, other columns stay."""
    model = fit(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact_text(t, model) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if i == at else c for i, (c, f) in enumerate(zip(batch.columns, batch.schema, strict=True))], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
