"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup as exact
from corpusloom.llm import language_id, mpeg_audio, ngram_join, packing, pii, quality_fm, repeats, sentencepiece_nbest, url_lists
from corpusloom.llm.common import table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digests(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(table(spark, sf_dir, "documents"))


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.n_best_digests(table(spark, sf_dir, "documents"), public_vocabulary("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), rule=ngram_join.Rule(words=3, percent=90))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.filter_urls(url_lists.dated_captures(pages), url_lists.dated_entries(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline, "op4_suffix_array": op4_suffix_array, "op9_ngram_join": op9_ngram_join, "op6_sentencepiece_nbest": op6_sentencepiece_nbest, "op7_best_fit_packing": op7_best_fit_packing, "op10_url_lists": op10_url_lists, "op1_quality_fm": op1_quality_fm, "op8_language_id": op8_language_id, "op2_mpeg_audio": op2_mpeg_audio, "op3_pii": op3_pii, "op5_exact_dedup": op5_exact_dedup}

ORACLES = {
    "op10_url_lists": url_lists.SQL,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
