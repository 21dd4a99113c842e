"""A training-data pipeline over documents: language ID, exact deduplication, near duplicates, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results: a null or empty text has no letter, so the language stage drops it; of equal texts, and of near copies, rows with a
null id count as the largest, or stay, as the stages' operators have it; very long texts go whole; rows that repeat are copies, of which
one stays; extra columns pass all stages but the last, whatever their names; an empty table gives an empty result. The language and
near-duplicate stages depend on the rows they get, the others on each text alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, exact_dedup, language_id, ngram_join, packing, pii
from corpusloom.llm.queries import public_vocabulary
from corpusloom.storage import Files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language can't be told, go."""
    common.prepare(spark)
    return language_id.drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 of their five-word shingles the one with the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs, rule=ngram_join.Rule(words=5, percent=80))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """E-mail addresses, IP addresses, card and phone numbers become their kind in brackets; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of at most 2048 tokens; packing.sequences() puts them together."""
    return packing.pack_documents(docs, public_vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("pii", private), ("packing", sequences)]

#: The learned and the heuristic stages have no SQL; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written to the checkpoint folder and read again. What a stage has read is removed once the next one is written; the last stage's input stays, as its result is made from it."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    files = Files(spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
        if k:
            files.delete(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
