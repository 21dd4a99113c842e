"""Search and listings over several stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import search as S
from corpusloom.operators.index import SearchIndex


def normalized_search(chunks: DataFrame, query: S.Query, limit: int = 20, offset: int = 0, boosts: dict[str, float] | None = None) -> DataFrame:
    """chunks has a store column. Each store ranks by its own statistics and gives limit + offset hits; its scores go to 0..1 by minimum and maximum (1 where they are equal)."""
    hits = S.score(chunks, query, boosts, by="store")
    top = hits.withColumn("_r", F.row_number().over(Window.partitionBy("store").orderBy(*S.order()))).where(F.col("_r") <= limit + offset)
    by = Window.partitionBy("store")
    low, high = F.min("score").over(by), F.max("score").over(by)
    scaled = top.withColumn("norm", F.round(F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)), 6))
    return scaled.orderBy(F.desc("norm"), "source", "chunk_index").offset(offset).limit(limit).drop("_r")


def search_stores(stores: dict[str, SearchIndex], query: S.Query, limit: int = 20, offset: int = 0, **options) -> DataFrame:
    """The stored indexes of several stores: each gives limit + offset hits by its own statistics; with more than one store, scores go to 0..1 by minimum and maximum. total is the sum."""
    pages = [ix.search(query, limit=limit + offset, **options).withColumn("store", F.lit(name)) for name, ix in stores.items()]
    rows = pages[0]
    for p in pages[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    by = Window.partitionBy("store")  # pages of at most limit + offset rows
    low, high = F.min("score").over(by), F.max("score").over(by)
    norm = F.round(F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)), 6) if len(pages) > 1 else F.col("score")
    return rows.withColumn("norm", norm).orderBy(F.desc("norm"), "source", "chunk_index").offset(offset).limit(limit)


def union_docs(stores: dict[str, DataFrame], sort: list, limit: int, offset: int = 0) -> DataFrame:
    """Documents of all stores as one list: each store gives limit + offset of its own order, then they are merged."""
    rows = None
    for name, docs in stores.items():
        part = docs.orderBy(*sort).limit(limit + offset).withColumn("store", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.orderBy(*sort).offset(offset).limit(limit)


def pool_sources(answers: dict[str, DataFrame]) -> DataFrame:
    """What resolve_source() found in each store: source, tier, ambiguous. Exact matches come before ambiguous ones; a source that several stores have is one."""
    rows = None
    for found in answers.values():
        rows = found if rows is None else rows.unionByName(found)
    one = rows.groupBy("source").agg(F.min("tier").alias("tier"), F.bool_and("ambiguous").alias("own"))
    n = one.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("own")).alias("exact"))
    kept = one.crossJoin(F.broadcast(n)).where((F.col("exact") == 0) | ~F.col("own"))  # one row of counts
    return kept.select("source", "tier", (F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("n")) > 1).alias("ambiguous")).orderBy("source")


def merge_maps(maps: DataFrame, col: str = "counts") -> DataFrame:
    """Count maps of stores (map<string, long>) as one, summed by key."""
    return maps.select(F.explode(col).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(col))


def merge_topics(stats: DataFrame) -> DataFrame:
    return stats.groupBy("topic").agg(*[F.sum(c).alias(c) for c in ("doc_count", "chunk_count", "word_count")])


def merge_info(docs: DataFrame) -> DataFrame:
    """Partial counts by store, summed; the average is taken anew."""
    part = docs.groupBy("store").agg(F.count(F.lit(1)).alias("d"), F.sum("chunk_count").alias("c"), F.sum("word_count").alias("w"))
    return part.agg(F.sum("d").alias("docs"), F.sum("c").alias("chunks"), F.sum("w").alias("words"), F.round(F.sum("w") / F.nullif(F.sum("c"), F.lit(0)), 1).alias("words_per_chunk"))
