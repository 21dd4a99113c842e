"""Enrichment by a pluggable provider: topics, summaries, chunk tags and quality."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.functions.analyze import truncate_bytes

TOPIC_BYTES, SUMMARY_BYTES, CHUNK_BYTES = 1500, 4000, 2000


def loose_json(reply: str) -> dict:
    """JSON in a reply: without code fences, or from the first brace to the last; nothing else counts."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", reply.strip())
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            out = json.loads(part)
            return out if isinstance(out, dict) else {}
        except ValueError:
            continue
    return {}


def enrich_chunks(chunks: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """source_id, chunk_index, llm_summary, llm_tags, llm_quality_score (0..1); nulls where the provider fails. Join it by both keys."""

    def one(body: str) -> tuple:
        try:
            got = loose_json(provider(truncate_bytes(body or "", CHUNK_BYTES)))
        except Exception:  # noqa: BLE001  a failed call leaves nulls
            got = {}
        tags, q = got.get("tags"), got.get("quality")
        return got.get("summary"), ", ".join(map(str, tags)) if isinstance(tags, list) else tags, min(1.0, max(0.0, float(q))) if isinstance(q, int | float) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())], names=["source_id", "chunk_index", "llm_summary", "llm_tags", "llm_quality_score"])

    return chunks.select("source_id", "chunk_index", "body").mapInArrow(run, "source_id string, chunk_index long, llm_summary string, llm_tags string, llm_quality_score double")


def stub(body: str) -> str:
    """A deterministic provider for tests."""
    words = body.split()
    return json.dumps({"summary": " ".join(words[:5]), "tags": sorted({w.lower() for w in words if len(w) > 6})[:3], "quality": min(1.0, len(words) / 50)})
