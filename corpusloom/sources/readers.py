"""Sources to raw documents: (source, content, ...) rows and failures. What needs a network takes downloaded tables instead."""

from __future__ import annotations

import bz2
import email
import email.policy
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X

MAX_FILE, MAX_MEMBERS, MAX_ARCHIVE = 50 << 20, 5000, 2048 << 20


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def local_files(spark: SparkSession, base: str, glob: str = "**/*", exclude: str | None = None) -> DataFrame:
    """source, relative, mtime, size, kind, format, content (read only if selected) and reason: files over MAX_FILE bytes are failures with a reason and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.rstrip("/")) + "/", "")
    rows = files.select(F.col("path").alias("source"), relative.alias("relative"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), X.kind_of(F.col("path")).alias("kind"), X.extension(F.col("path")).alias("format"), "content")
    rows = rows.where(F.col("relative").rlike(glob_regex(glob)))
    rows = rows.where(~F.col("relative").rlike(exclude)) if exclude else rows
    # the content of a large file is never read
    large = rows.where(F.col("size") > MAX_FILE).withColumns({"content": F.lit(None).cast("binary"), "reason": F.concat(F.col("size"), F.lit(f" bytes are over {MAX_FILE}"))})
    return rows.where(F.col("size") <= MAX_FILE).withColumn("reason", F.lit(None).cast("string")).unionByName(large)


def decode_text(rows: DataFrame) -> DataFrame:
    """Text files as UTF-8 without a byte order mark, and failures; others are left out."""
    failed = F.col("reason").isNotNull() if "reason" in rows.columns else F.lit(False)
    return rows.where(failed | X.is_text(F.col("content"))).withColumn("content", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))


def _safe(name: str) -> bool:
    return not (name.startswith(("/", "\\")) or ".." in name.split("/") or "\0" in name)


def members(name: str, data: bytes, most_files: int = MAX_MEMBERS, most_bytes: int = MAX_ARCHIVE) -> Iterator[tuple[str, bytes]]:
    """Files of a zip, tar (gz, bz2, xz) or single gz; unsafe paths and links are skipped; more files or bytes than the bounds are an error, raised while reading."""
    files = size = 0

    def count(n: int) -> None:
        nonlocal files, size
        files, size = files + 1, size + n
        if files > most_files:
            raise ValueError(f"an archive of more than {most_files} files")
        if size > most_bytes:
            raise ValueError(f"an archive of more than {most_bytes} bytes unpacked")

    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir() and _safe(info.filename) and info.external_attr >> 28 != 0xA:
                    count(info.file_size)
                    yield info.filename, z.read(info)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile() and _safe(info.name):
                    count(info.size)
                    yield info.name, t.extractfile(info).read()
        return
    except tarfile.TarError:
        pass
    for suffix, reader in ((".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)):
        if name.endswith(suffix):
            out = bytearray()
            with reader(io.BytesIO(data)) as f:
                files = 1
                while part := f.read(1 << 20):  # no more than the bound is ever unpacked
                    out += part
                    if len(out) > most_bytes:
                        raise ValueError(f"an archive of more than {most_bytes} bytes unpacked")
            yield name.rsplit("/", 1)[-1].removesuffix(suffix), bytes(out)


def expand_archives(files: DataFrame) -> DataFrame:
    """(source, content) of archives to members keyed archive#member, with failures as rows of a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(f"{source}#{n}", d, None) for n, d in members(source, data)]
                except Exception as e:  # noqa: BLE001  a broken archive is a failed document
                    out.append((source, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.string())], names=["source", "content", "reason"])

    return files.select("source", "content").mapInArrow(run, "source string, content binary, reason string")


def _urls(xml: Column, path: str, include: str | None) -> Column:
    """Texts and hrefs of elements by local name; null on XML that doesn't parse is not raised."""
    found = F.regexp_extract_all(xml, F.lit(path), F.lit(1))
    urls = F.transform(found, lambda u: F.trim(F.regexp_replace(F.regexp_replace(u, r"^\s*<!\[CDATA\[|\]\]>\s*$", ""), "&amp;", "&")))
    urls = F.filter(F.array_distinct(urls), lambda u: u.rlike("^https?://"))
    return F.filter(urls, lambda u: u.rlike(include)) if include else urls


def sitemap_urls(xml: Column, include: str | None = None, most: int = 50_000) -> Column:
    return F.slice(_urls(xml, r"(?s)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>", include), 1, most)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"<(\w+:)?sitemapindex[\s>]")


def feed_urls(xml: Column, include: str | None = None) -> Column:
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:item|entry)[\s>](.*?)</(?:item|entry)>"), F.lit(1))
    link = lambda i: F.coalesce(X.empty_as_null(F.trim(F.regexp_replace(F.regexp_extract(i, r"(?s)<link>(.*?)</link>", 1), r"<!\[CDATA\[|\]\]>", ""))), X.empty_as_null(F.regexp_extract(i, r"<link[^>]*\shref=[\"']([^\"']+)", 1)))
    urls = F.filter(F.transform(items, link), lambda u: u.rlike("^https?://"))
    return F.filter(urls, lambda u: u.rlike(include)) if include else urls


def changed_objects(listing: DataFrame, stamps: DataFrame) -> DataFrame:
    """Objects whose etag isn't the stored one."""
    return listing.join(stamps.select("source_id", "etag"), ["source_id", "etag"], "left_anti")


def parse_mail(path: str, data: bytes) -> dict | None:
    message = email.message_from_bytes(data, policy=email.policy.default)
    part = message.get_body(("plain", "html"))
    body = part.get_content() if part else ""
    if part and part.get_content_type() == "text/html":
        body = re.sub(r"<[^>]*(>|$)", "", body).replace(">", "")
    return {"source": re.sub(r":2,[A-Z]*$", "", path), "title": message["subject"], "author": message["from"], "content": body}


def maildir(files: DataFrame, skip_trashed: bool = True) -> DataFrame:
    """Messages under new/ and cur/ with tags of their flags; the key has no flags."""
    rows = files.where(F.col("source").rlike("/(new|cur)/[^/]+$")).select("source", "content", X.maildir_flags(F.col("source")).alias("tags"))
    rows = rows.where(~F.col("tags").contains("trashed")) if skip_trashed else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_mail(p, d) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([None if f[n] is None else str(f[n]) for f in found], pa.string()) for n in ("source", "title", "author", "content")] + [batch.column(2)], names=["source", "title", "author", "content", "tags"])

    return rows.mapInArrow(run, "source string, title string, author string, content string, tags string")


def exec_jsonl(lines: DataFrame, col: str = "value", topic: str | None = None, format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON lines to documents and failures: source and content are required; tags may be a text or a list; kind is document by default. topic is the source's own; format is for lines without one."""
    p = F.from_json(col, "source string, content string, title string, author string, lang string, format string, topic string, kind string, tags string, created_at string", {"mode": "PERMISSIVE"})
    tags = F.coalesce(F.array_join(F.from_json("p.tags", "array<string>"), ", "), F.col("p.tags"))
    rows = lines.select(F.col(col).alias("line"), p.alias("p")).withColumn("good", F.coalesce(F.length("p.source") > 0, F.lit(False)) & F.col("p.content").isNotNull())
    known = F.when(F.col("p.kind").isin("document", "code", "data", "email"), F.col("p.kind")).otherwise("document")
    docs = rows.where("good").select("p.source", "p.content", "p.title", "p.author", "p.lang", F.coalesce("p.format", F.lit(format)).alias("format"), F.coalesce(F.lit(topic), "p.topic").alias("topic"), known.alias("kind"), tags.alias("tags"), "p.created_at")
    return docs, rows.where("not good").select("line", F.when(F.col("p.source").isNull() & F.col("p.content").isNull(), "not a document").when(F.col("p.content").isNull(), "no content").otherwise("no source").alias("reason"))


def transcript_text(xml: str, most: int = 500) -> str:
    """Timed text to paragraphs, broken after `most` characters."""
    import html

    words = [html.unescape(re.sub(r"<[^>]+>", "", t)).strip() for t in re.findall(r"(?s)<(?:p|text)\b[^>]*>(.*?)</(?:p|text)>", xml)]
    out, held = [], ""
    for w in filter(None, words):
        held = f"{held} {w}".strip()
        if len(held) > most:
            out.append(held)
            held = ""
    return "\n\n".join([*out, held] if held else out)


READERS: dict[str, Callable] = {"local": local_files, "maildir": maildir, "exec": exec_jsonl, "sitemap": sitemap_urls, "feed": feed_urls, "archive": expand_archives}


def discover(kind: str, *args, **options):
    """The reader of a source type."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(READERS)}")
    return READERS[kind](*args, **options)
