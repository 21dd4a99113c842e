"""Document and topic listings, corpus information, name and source resolution, reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE, MAX_PAGE = 10, 500


def clamp(limit: int | None) -> int:
    return min(MAX_PAGE, max(1, DEFAULT_PAGE if limit is None else limit))


def page(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return rows.offset(offset).limit(clamp(limit))


def common_filters(rows: DataFrame, *, lang: str | None = None, origin: str | None = None, kind: str | None = None, source: str | None = None, format: str | None = None) -> DataFrame:
    """lang and format without case, origin and kind exactly, source by substring; a null never matches."""
    tests = [lang is not None and (F.lower("lang") == lang.lower()), origin is not None and (F.col("origin") == origin), kind is not None and (F.col("kind") == kind), source is not None and F.col("source").contains(source), format is not None and (F.lower("format") == format.lower())]
    for t in tests:
        rows = rows if t is False else rows.where(t)
    return rows


def doc_filters(rows: DataFrame, *, topic: str | None = None, title: str | None = None, author: str | None = None, **common) -> DataFrame:
    """topic without case, title and author by substring without case."""
    rows = common_filters(rows, **common)
    rows = rows.where(F.lower("topic") == topic.lower()) if topic is not None else rows
    rows = rows.where(F.lower("title").contains(title.lower())) if title is not None else rows
    return rows.where(F.lower("author").contains(author.lower())) if author is not None else rows


def topic_filters(rows: DataFrame, *, topic: str | None = None, author: str | None = None, **common) -> DataFrame:
    """topic by substring without case, author without case."""
    rows = common_filters(rows, **common)
    rows = rows.where(F.lower("topic").contains(topic.lower())) if topic is not None else rows
    return rows.where(F.lower("author") == author.lower()) if author is not None else rows


def _flip(keys: list[tuple[str, bool]], reverse: bool, last: set[str] = frozenset()) -> list[Column]:
    out = []
    for name, up in keys:
        c = F.col(name)
        if name in last:  # nulls last, first when reversed
            out.append((c.desc_nulls_last() if not up else c.asc_nulls_last()) if not reverse else (c.asc_nulls_first() if not up else c.desc_nulls_first()))
        else:
            out.append(c.asc_nulls_first() if up != reverse else c.desc_nulls_last())
    return out


def doc_order(sort: str = "source", reverse: bool = False) -> list[Column]:
    keys = {"source": [], "topic": [("topic", True)], "title": [("title", True)], "author": [("author", True)], "chunks": [("chunk_count", False)], "words": [("word_count", False)], "quality": [("quality", False)]}[sort]
    return _flip([*keys, ("source", True)], reverse, {"quality"})


def topic_order(sort: str = "name", reverse: bool = False) -> list[Column]:
    keys = {"name": [], "chunks": [("chunk_count", False)], "words": [("word_count", False)]}[sort]
    return _flip([*keys, ("topic", True)], reverse)


def topic_stats(docs: DataFrame) -> DataFrame:
    return docs.where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("chunk_count").alias("chunk_count"), F.sum("word_count").alias("word_count"))


def store_info(docs: DataFrame) -> DataFrame:
    """(facet, value, docs) counts by origin, kind, format and lang, and totals, in one pass with grouping sets. Nulls of format and lang are left out."""
    sets = docs.select("origin", "kind", "format", "lang", "chunk_count", "word_count").groupingSets([["origin"], ["kind"], ["format"], ["lang"], []], "origin", "kind", "format", "lang")
    rows = sets.agg(F.count(F.lit(1)).alias("docs"), F.sum("chunk_count").alias("chunks"), F.sum("word_count").alias("words"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "origin").when(F.col("g") == 11, "kind").when(F.col("g") == 13, "format").when(F.col("g") == 14, "lang").otherwise("all")
    return rows.select(facet.alias("facet"), F.coalesce("origin", "kind", "format", "lang").alias("value"), "docs", "chunks", "words").where("facet in ('all', 'origin', 'kind') or value is not null")


def averages(docs: DataFrame) -> DataFrame:
    n, c, w = F.count(F.lit(1)), F.sum("chunk_count"), F.sum("word_count")
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 1)
    return docs.agg(ratio(w, c).alias("words_per_chunk"), ratio(c, n).alias("chunks_per_doc"), ratio(w, n).alias("words_per_doc"))


def lang_summary(docs: DataFrame, top: int = 5) -> DataFrame:
    """count desc, then label; the first few and how many more there are."""
    counts = docs.where("lang is not null").groupBy("lang").count()
    few = counts.orderBy(F.desc("count"), "lang").limit(top)
    text = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("lang").alias("l")))), lambda x: F.concat(x["l"], F.lit(": "), (-x["n"]).cast("string"))), ", ").alias("text"))
    rest = counts.agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("more"))
    return text.crossJoin(F.broadcast(rest)).select(F.when(F.col("more") > 0, F.concat("text", F.lit(", +"), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.col("text")).alias("summary"))


def field_terms(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col(name).alias("term")).where("term <> ''").distinct()


def best_name(names: DataFrame, wanted: str, col: str = "term") -> DataFrame:
    """Exact, then without case, then by substring; in a tier the shortest in bytes, then by name."""
    low = wanted.lower()
    tier = F.when(F.col(col) == wanted, 0).when(F.lower(col) == low, 1).when(F.lower(col).contains(low), 2)
    return names.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.octet_length(col), col).limit(1).select(col, "tier")


def resolve_source(docs: DataFrame, wanted: str) -> DataFrame:
    """Matches of the first tier that has any: exact, ASCII without case, suffix at a slash, substring, file name, stem. Several are ambiguous. Paths with `..` or NUL match nothing."""
    if ".." in wanted or "\0" in wanted:
        return docs.select("source", F.lit(0).alias("tier"), F.lit(False).alias("ambiguous")).limit(0)
    s, low = F.col("source"), wanted.lower()
    name = F.substring_index(s, "/", -1)
    tier = F.when(s == wanted, 0).when(F.lower(s) == low, 1).when(s.endswith("/" + wanted), 2).when(s.contains(wanted), 3).when(name == wanted, 4).when(F.regexp_replace(name, r"\.[^.]*$", "") == wanted, 5)
    rows = docs.select("source", tier.alias("tier")).where("tier is not null").distinct()
    best = rows.agg(F.min("tier").alias("best"))
    first = rows.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")
    return first.crossJoin(F.broadcast(first.agg((F.count(F.lit(1)) > 1).alias("ambiguous"))))


def read_doc(docs: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    meta = docs.where(F.col("source") == source).select("source_id", "title", "chunk_count")
    return chunks.where(F.col("source") == source).drop("title").join(F.broadcast(meta), "source_id").select("source", "title", "chunk_count", "chunk_index", "body").orderBy("source", "chunk_index")


def read_topic(chunks: DataFrame, topic: str) -> DataFrame:
    return chunks.where(F.col("topic") == topic).select("topic", "source", "chunk_index", "body").orderBy("source", "chunk_index")


def chunks_of_sources(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))


def rollup(chunks: DataFrame) -> DataFrame:
    """A document from its chunks; its topic is the first chunk's."""
    from corpusloom.plans.corpus import word_count

    return chunks.groupBy("source_id").agg(F.min_by("topic", "chunk_index").alias("topic"), F.count(F.lit(1)).alias("chunk_count"), F.sum(word_count(F.col("body"))).alias("word_count"))


def envelope(rows: DataFrame, total: int, offset: int, query: str | None = None) -> DataFrame:
    """A page as one JSON text; rows is a page of at most MAX_PAGE rows."""
    items = rows.agg(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])).alias("items"))
    return items.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(total).alias("total"), F.lit(offset).alias("offset"), "items")).alias("page"))


def quality_filter(chunks: DataFrame, threshold: float = 0.3, col: str = "quality") -> DataFrame:
    return chunks.where(F.coalesce(F.col(col) >= threshold, F.lit(True)))


def enrich_candidates(docs: DataFrame, *, source: str | None = None, topic: str | None = None, force: bool = False, detect: bool = True, summarize: bool = True, enrich: bool = True) -> DataFrame:
    rows = docs if source is None else docs.where(F.col("source").contains(source))
    rows = rows if topic is None else rows.where(F.lower("topic").contains(topic.lower()))
    if force:
        return rows
    need = F.lit(False)
    for on, col in ((detect, "topic"), (summarize, "summary"), (enrich, "quality")):
        need = need | F.col(col).isNull() if on and col in rows.columns else need
    return rows.where(need)


def federated_names(stores: list[DataFrame], wanted: str) -> DataFrame:
    rows = stores[0]
    for s in stores[1:]:
        rows = rows.unionByName(s)
    return best_name(rows.distinct(), wanted)


def first_store_wins(rows: DataFrame, key: str = "source_id", by: str = "store") -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("_r = 1").drop("_r")
