"""Metadata found in a text: front matter, org keywords, header lines, authors, copyright, first-line titles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import LANGUAGE_CODE, LANGUAGES

FIELDS = ("title", "author", "lang", "tags", "topic", "created_at")
#: Keys by field, of front matter and header lines, and of org files; patterns of each form.
KEYS = {
    "title": "title", "author": "author", "authors": "author", "creator": "author", "editor": "author", "by": "author", "from": "author", "language": "lang", "lang": "lang",
    "date": "created_at", "release date": "created_at", "posting date": "created_at", "publication date": "created_at", "published": "created_at", "last updated": "created_at",
    "subject": "tags", "keywords": "tags", "tags": "tags", "category": "tags", "categories": "tags", "topic": "topic",
}
ORG_KEYS = {"TITLE": "title", "AUTHOR": "author", "DATE": "created_at", "LANGUAGE": "lang", "KEYWORDS": "tags", "DESCRIPTION": "tags"}
_BLOCKS = (("---", re.compile(r"(?s)\A---\r?\n(.*?)\r?\n---")), ("+++", re.compile(r"(?s)\A\+\+\+\s*\n(.*?)\n\+\+\+")))
_KEY_LINE = re.compile(r"(?m)^([a-zA-Z_][a-zA-Z0-9_]*)\s*[:=]\s*(.+)$")
_ORG_LINE = re.compile(r"(?m)^#\+([A-Z_]+):\s+(.+)$")
_HEADER = re.compile(r"([A-Za-z][A-Za-z \-]+):\s+(.+)")
_NOTE = re.compile(r"\s*\[.*?\]\s*$")
_BY = re.compile(r"(?m)^[Bb]y\s+((?:[A-Z][a-z]+(?:\s+(?:and|&)\s+)?)+(?:\s+[A-Z][a-z]+)*)$")
_COPYRIGHT = re.compile(r"(?i)copyright\s+(?:\([cC]\)\s*|©\s*)?(\d{4}(?:\s*[-–]\s*\d{4})?)\s+(.+)")
_CODE_ENDS, _NO_TITLE = (",", ";", "{", "}"), ("---", "+++", "#", "//")
HEAD_BYTES, HEADER_LINES, BY_LINES, COPYRIGHT_LINES, TITLE_BYTES, AUTHOR_BYTES = 4096, 100, 20, 30, 120, 100


def language_code(raw: str) -> str | None:
    """As text.lang_code(), of one text."""
    first, hyphen, rest = raw.strip().partition("-")
    whole = first.lower() + hyphen + rest
    for one in (whole, re.split("[;,/]", whole)[0].strip()):
        if one in LANGUAGES or re.match(LANGUAGE_CODE, one):
            return LANGUAGES.get(one, one)
    return None


def _is_code(value: str) -> bool:
    return value.endswith(_CODE_ENDS) or "<" in value or "(" in value


def _first_of_each(pairs, keys: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in pairs:
        if field := keys.get(key):
            out.setdefault(field, value)
    if "lang" in out and (code := language_code(out.pop("lang"))):
        out["lang"] = code
    return out


def _headers(text: str) -> dict[str, str]:
    pairs = []
    for line in text.split("\n")[:HEADER_LINES]:
        bare = line.strip()
        if bare.startswith(("***", "===")):
            break
        if line.startswith("\t") or len(line) - len(line.lstrip()) >= 4:
            continue
        if (m := _HEADER.fullmatch(bare)) and not _is_code(m[2].strip()) and (value := _NOTE.sub("", m[2].strip()).strip()):
            pairs.append((m[1].strip().lower(), value))
    return _first_of_each(pairs, KEYS)


def _copyright(head: str) -> tuple[str, str] | None:
    """Author and year or years."""
    if not (m := _COPYRIGHT.search("\n".join(head.split("\n")[:COPYRIGHT_LINES]))):
        return None
    author = re.split("[.,]", m[2].strip())[0].strip()
    if (at := author.lower().rfind("all rights reserved")) >= 0:
        author = author[:at].strip()
    return (author, m[1].strip()) if author and len(author.encode()) <= AUTHOR_BYTES else None


def _title(text: str) -> str | None:
    """The first line, or the second after an empty one, if it reads like a title and no text follows it directly."""
    lines = text.split("\n")
    at = 1 if not lines[0].strip() else 0
    line = lines[at].strip() if at < len(lines) else ""
    good = line and len(line.encode()) <= TITLE_BYTES and not line.endswith((".", "{", ";")) and not _is_code(line) and not _HEADER.fullmatch(line) and not line.startswith(_NO_TITLE)
    return line if good and (at + 1 >= len(lines) or not lines[at + 1].strip()) else None


def extract(text: str) -> dict[str, str]:
    """The first value of each field. Front matter or org keywords with a known key are all there is; texts that begin like either, without one, have no header lines."""
    for sign, block in _BLOCKS:
        if text.startswith(sign) and (m := block.match(text)) and (out := _first_of_each(((k.strip().lower(), v.strip().strip("\"'")) for k, v in _KEY_LINE.findall(m[1])), KEYS)):
            return out
    if text.startswith("#+") and (out := _first_of_each(((k, v.strip()) for k, v in _ORG_LINE.findall(text)), ORG_KEYS)):
        return out
    out = {} if text.startswith(("---", "+++", "#+")) else _headers(text)
    head = text.encode()[:HEAD_BYTES].decode(errors="ignore")
    if "author" not in out and (m := _BY.search("\n".join(head.split("\n")[:BY_LINES]))) and len(m[1].split()) >= 2:
        out["author"] = m[1].strip()
    if ("author" not in out or "created_at" not in out) and (found := _copyright(head)):
        out.setdefault("author", found[0])
        out.setdefault("created_at", found[1])
    if "title" not in out and (title := _title(text)):
        out["title"] = title
    return out


def merge(primary: dict[str, str], fallback: dict[str, str]) -> dict[str, str]:
    """What primary lacks comes from fallback."""
    return fallback | {k: v for k, v in primary.items() if v is not None}


def metadata(text: Column) -> Column:
    """A struct of FIELDS."""

    @F.pandas_udf(", ".join(f"{f} string" for f in FIELDS))
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [extract(t or "") for t in texts]
        return pd.DataFrame({f: [x.get(f) for x in found] for f in FIELDS}, dtype=object)

    return run(text)


def merged(primary: Column, fallback: Column) -> Column:
    """merge() of two structs of FIELDS; either may be null."""
    return F.struct(*[F.coalesce(primary[f], fallback[f]).alias(f) for f in FIELDS])


def settled(found: Column, kind: Column, topic: Column) -> Column:
    """A document's own metadata: a topic from the settings goes before one that was found, and only documents keep a title."""
    own = {"title": F.when(kind == "document", found["title"]), "topic": F.coalesce(topic, found["topic"])}
    return F.struct(*[own.get(f, found[f]).alias(f) for f in FIELDS])
