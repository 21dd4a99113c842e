"""The corpus model over the test tables: documents, chunks, mail and pages as stores. CTE holds the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_id(source: Column) -> Column:
    return F.substring(F.sha2(source, 256), 1, 32)


def chunk_id(source_id: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_id, F.lit("\0"), body), 256), 1, 32)


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).cast("long")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk is a line that isn't blank, under its place; the title is the first line."""
    d = read(spark, sf_dir, "documents")
    lines = d.select(
        F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("source"), F.col("source").alias("topic"), "lang", "doc_id",
        F.element_at(F.split("text", "\n"), 1).alias("title"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "body"))
    lines = lines.where(F.trim("body") != "").withColumn("chunk_index", F.col("chunk_index").cast("long"))
    return lines.select("*", hash_id(F.col("source")).alias("source_id"), F.lit("local").alias("origin"), F.lit("document").alias("kind"), F.lit("txt").alias("format"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its roll-up; quality from labels. No shuffle of texts: a document's lines are counted in its row."""
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    lines = F.filter(F.split("text", "\n"), lambda b: F.trim(b) != "")
    rows = d.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("source"), F.col("source").alias("topic"), "lang", F.element_at(F.split("text", "\n"), 1).alias("title"), F.size(lines).cast("long").alias("chunk_count"), word_count(F.col("text")).alias("word_count"))
    return rows.join(q, "doc_id", "left").select("*", hash_id(F.col("source")).alias("source_id"), F.lit("local").alias("origin"), F.lit("document").alias("kind"), F.lit("txt").alias("format"))


CTE = r"""
WITH chunks_v AS (
    SELECT *, substr(sha256(source), 1, 32) AS source_id, 'local' AS origin, 'document' AS kind, 'txt' AS format FROM (
        SELECT 'docs/' || doc_id || '.txt' AS source, source AS topic, lang, doc_id, string_split(text, chr(10))[1] AS title,
               CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS chunk_index, unnest(string_split(text, chr(10))) AS body FROM documents)
    WHERE trim(body) <> ''),
docs_v AS (
    SELECT d.doc_id, 'docs/' || d.doc_id || '.txt' AS source, d.source AS topic, d.lang, string_split(d.text, chr(10))[1] AS title,
           len(list_filter(string_split(d.text, chr(10)), lambda b: trim(b) <> '')) AS chunk_count,
           len(list_filter(regexp_split_to_array(d.text, '\s+'), lambda w: w <> '')) AS word_count, q.quality,
           substr(sha256('docs/' || d.doc_id || '.txt'), 1, 32) AS source_id, 'local' AS origin, 'document' AS kind, 'txt' AS format
    FROM documents d LEFT JOIN (SELECT doc_id, CAST(max(quality) AS DOUBLE) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id)
"""
