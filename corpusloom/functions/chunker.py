"""Heading-aware chunking: texts to chunks with section paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MIN_CHARS, PROBE, PRESPLIT = 1600, 30, 256 << 10, 512 << 10
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t#]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


@dataclass
class Chunk:
    section: str | None
    body: str


def lines_with_fences(text: str) -> Iterator[tuple[str, bool]]:
    """Lines with their ends, and whether a line is in (or of) a fenced block. A fence closes with its own sign, as long or longer."""
    sign = ""
    for line in text.splitlines(keepends=True):
        m = _FENCE.match(line)
        if sign:
            yield line, True
            if m and m[1][0] == sign[0] and len(m[1]) >= len(sign) and not line[m.end() :].strip():
                sign = ""
        elif m:
            sign = m[1]
            yield line, True
        else:
            yield line, False


def presplit(text: str, over: int = PRESPLIT) -> list[str]:
    """Large texts at headings of level one outside fences."""
    if len(text.encode()) <= over:
        return [text]
    out: list[list[str]] = [[]]
    for line, fenced in lines_with_fences(text):
        if not fenced and line.startswith("# ") and out[-1]:
            out.append([])
        out[-1].append(line)
    return ["".join(x) for x in out]


def _pieces(text: str, most: int) -> Iterator[str]:
    """Blocks between blank lines packed up to most characters; longer ones at line ends, sentence ends, spaces, or hard."""
    held = ""
    for block in re.findall(r"(?s).+?(?:\n\s*\n|\Z)", text):
        if len(held) + len(block.rstrip()) <= most:
            held += block
            continue
        if held.strip():
            yield held.strip()
        while len(block.strip()) > most:
            part = block[:most]
            at = max(part.rfind("\n"), 0) or max(part.rfind(". ") + 1, 0) or part.rfind(" ")
            at = at if at > 0 else most
            yield block[:at].strip()
            block = block[at:]
        held = block
    if held.strip():
        yield held.strip()


def chunk(text: str, most: int = MAX_CHARS, least: int = MIN_CHARS, drop: tuple[str, ...] = ()) -> list[Chunk]:
    """Chunks of at most `most` characters with section `A > B`. Sections under a dropped heading (ASCII without case) go. A chunk under `least` bytes joins the next; a last one that short is dropped."""
    text = text.lstrip("﻿").lstrip("\n")
    dropped = {d.lower() for d in drop}
    raw: list[Chunk] = []
    for part in presplit(text):
        path: list[tuple[int, str]] = []
        body: list[str] = []

        def close() -> None:
            names = [t for _, t in path]
            if not any(n.lower() in dropped for n in names):
                raw.extend(Chunk(" > ".join(names) or None, p) for p in _pieces("".join(body), most))
            body.clear()

        markdown = any(_HEADING.match(line.rstrip("\n")) for line, fenced in lines_with_fences(part[:PROBE]) if not fenced)
        for line, fenced in lines_with_fences(part):
            m = None if fenced or not markdown else _HEADING.match(line.rstrip("\n"))
            if m:
                close()
                level = len(m[1])
                path[:] = [p for p in path if p[0] < level] + [(level, m[2].strip())]
            body.append(line)
        close()
    out: list[Chunk] = []
    held = ""
    for c in raw:
        body = f"{held}\n\n{c.body}" if held else c.body
        held = ""
        if len(body.encode()) < least:
            held = body
        else:
            out.append(Chunk(c.section, body))
    return out


def chunk_documents(docs: DataFrame, id_col: str = "source_id", text_col: str = "content", most: int = MAX_CHARS, least: int = MIN_CHARS, drop: tuple[str, ...] = ()) -> DataFrame:
    """source_id, chunk_index, section, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, sections, bodies = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, c in enumerate(chunk(text or "", most, least, drop)):
                    ids.append(i)
                    index.append(k)
                    sections.append(c.section)
                    bodies.append(c.body)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(index, pa.int64()), pa.array(sections, pa.string()), pa.array(bodies, pa.string())], names=["source_id", "chunk_index", "section", "body"])

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "source_id string, chunk_index long, section string, body string")
