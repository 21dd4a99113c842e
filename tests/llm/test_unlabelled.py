"""The pipeline's language stage where there is nothing to learn from."""

import corpus_pipeline
from corpusloom.llm.common import is_held_out

SCHEMA = "doc_id long, text string, lang string"
ROWS = [(1, "a text", None), (2, "日本", None), (3, "7 7 7", None), (4, "", None), (5, None, None)]


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2]


def test_language_stage_with_labels_held_out(spark):
    held = next(r.id for r in spark.range(100).where(is_held_out("id")).collect())
    docs = spark.createDataFrame([*ROWS, (held, "labelled", "en")], SCHEMA)
    assert sorted(r.text for r in corpus_pipeline.language(spark, docs, "").collect()) == ["a text", "labelled", "日本"]
