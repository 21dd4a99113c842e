"""Tokenizer, stop words, English stemming, query language, snippets: plain Python, and Arrow-backed columns of it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators.search import CJK as _CJK
from corpusloom.operators.search import EMOJI as _EMOJI
from corpusloom.operators.search import Query

_TOKEN = re.compile(rf"[{_CJK}]+|[{_EMOJI}]|[^\W_{_CJK}{_EMOJI}]+")
_CJK_RUN = re.compile(rf"[{_CJK}]+")
MAX_TOKEN, MAX_QUERY = 100, 4096


def bigrams(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] or [run]


def tokenize(text: str) -> list[str]:
    """Words; Han and kana runs as overlapping pairs; each emoji alone. Hangul stays whole."""
    out = []
    for m in _TOKEN.finditer(text):
        out += bigrams(m[0]) if _CJK_RUN.match(m[0]) else [m[0]]
    return out


_VOWELS = "aeiouy"
#: Fixed values of the Porter2 algorithm.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _region(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def stem(word: str) -> str:
    """Porter2 for English."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(f"(?<=[{_VOWELS}])y", "Y", re.sub("^y", "Y", word.lstrip("'")))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w.lower()
    for s in ("eedly", "eed"):
        if w.endswith(s):
            w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s) and any(c in _VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif len(w) <= r1 and _short_end(w):
                    w += "e"
                break
            if w.endswith(s):
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
                else:
                    w = w[: -len(s)] + _STEP2[s]
            break
    for s in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + _STEP3[s]
            break
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stop_words(language: str) -> frozenset[str]:
    """Spark's own lists; none for languages that it has none for."""
    from pyspark.ml.feature import StopWordsRemover

    known = "danish dutch english finnish french german hungarian italian norwegian portuguese russian spanish swedish turkish".split()
    return frozenset(StopWordsRemover.loadDefaultStopWords(language)) if language in known else frozenset()


def analyze(text: str, language: str = "english", stops: frozenset[str] = frozenset()) -> list[str]:
    """Tokens up to MAX_TOKEN bytes, lower-cased, without stop words, stemmed for English; `none` only lower-cases."""
    out = [t.lower() for t in tokenize(text or "") if len(t.encode()) <= MAX_TOKEN]
    return out if language == "none" else [stem(t) if language == "english" else t for t in out if t not in stops]


def analyzed(language: str = "english"):
    """A column function for search.score(analyze=...)."""
    stops = stop_words(language)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: analyze(t, language, stops))

    return lambda c: run(F.coalesce(c, F.lit("")))


def sanitize(query: str) -> str:
    """Without brackets, field prefixes, and signs or parentheses around words; URLs, quotes, wildcards and AND, OR, NOT stay."""
    out = []
    for word in query.replace("[", "").replace("]", "").split():
        word = word.lstrip("+-(").rstrip(")")
        while m := re.match(r"^[A-Za-z_][A-Za-z0-9_]*:(?!//)", word):
            word = word[m.end() :].lstrip("(")
        if word := word.lstrip("("):
            out.append(word)
    return " ".join(out)


def split_cjk(query: str) -> str:
    return re.sub(r"  +", " ", _CJK_RUN.sub(lambda m: " " + " ".join(bigrams(m[0])) + " ", query)).strip()


def truncate_bytes(text: str, most: int) -> str:
    return text.encode()[:most].decode(errors="ignore")


class EmptyQuery(ValueError):
    """A query without a word."""


def parse(query: str, language: str = "none", stops: frozenset[str] = frozenset()) -> Query:
    """Words are alternatives; AND requires both sides, NOT and a leading minus exclude, quotes make phrases."""
    text = split_cjk(sanitize(truncate_bytes(query, MAX_QUERY)))
    if not text:
        raise EmptyQuery(query)
    out, pending = Query(), ""
    parts = re.findall(r'"([^"]*)"|(\S+)', text)
    for i, (phrase, word) in enumerate(parts):
        if word in ("AND", "OR", "NOT"):
            pending = "AND" if word == "AND" else "NOT" if word == "NOT" else ""
            continue
        terms = analyze(phrase or word, language, stops)
        after = parts[i + 1][1] if i + 1 < len(parts) else ""
        if phrase and len(terms) > 1:
            out.phrases.append(terms)
        elif pending == "NOT":
            out.excluded += terms
        elif pending == "AND" or after == "AND":
            out.required += terms
        else:
            out.terms += terms
        pending = ""
    if not out.scored:
        raise EmptyQuery(query)
    return out


def snippet(body: str, terms: list[str], most: int = 300) -> tuple[str, list[tuple[int, int]]] | None:
    """The first window of at most `most` characters with the most matches, from word to word, and the matches' places in it, in characters."""
    wanted = set(terms)
    hits = [m.span() for m in _TOKEN.finditer(body) if m[0].lower() in wanted or stem(m[0].lower()) in wanted]
    if not hits:
        return None
    best, a = (0, 0), 0
    for b in range(len(hits)):
        while hits[b][1] - hits[a][0] > most:
            a += 1
        best = max(best, (b - a + 1, -a))
    start = hits[-best[1]][0]
    start = max(0, body.rfind(" ", 0, max(0, start - 40)) + 1) if start > 40 else 0
    end = min(len(body), start + most)
    return body[start:end], [(x - start, y - start) for x, y in hits if start <= x and y <= end]


def splice(text: str, ranges: list[tuple[int, int]], left: str = "**", right: str = "**") -> str:
    """Marks ranges; those out of order or of bounds are left out."""
    out, at = [], 0
    for a, b in ranges:
        if at <= a < b <= len(text):
            out += [text[at:a], left, text[a:b], right]
            at = b
    return "".join(out) + text[at:]


def snippets(body: Column, terms: list[str]) -> Column:
    """The snippet with its matches marked; null without a match. For pages of hits."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: splice(*s) if b is not None and (s := snippet(b, terms)) else None)

    return run(body)
