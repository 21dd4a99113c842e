"""The registered queries of the engine, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import analyze as A
from corpusloom.functions import text as X
from corpusloom.functions.chunker import chunk_documents
from corpusloom.functions.metadata import FIELDS, merged, metadata, settled
from corpusloom.operators import enrich as E
from corpusloom.operators import federation as FED
from corpusloom.operators import incremental as I
from corpusloom.operators import lists as L
from corpusloom.operators import search as S
from corpusloom.operators.index import SearchIndex, open_or_build
from corpusloom.plans import corpus as C
from corpusloom.sources import readers as R
from corpusloom.storage import Files, fresh_folder, shared_folder

QUERIES, ORACLES = {}, {}
BODY, BOTH = {"body": 1.0}, {"body": 1.0, "title": 3.0}
HIT = ["source", "chunk_index", "score"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = C.CTE + sql if "_v" in sql else sql
        return f

    return add


def hits(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*HIT, *more)


def both_stores(rows: DataFrame) -> DataFrame:
    return rows.withColumn("store", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))


def index(spark: SparkSession, d: str, name: str = "words", where: str = "true", **options) -> SearchIndex:
    """The stored index of the chunks. It is written once under the shared folder and opened by every later search of the same files."""
    key = hashlib.sha256(f"{d} {Files(spark, f'{d}/documents.parquet').stamp()} {name}".encode()).hexdigest()[:16]
    return open_or_build(spark, f"{shared_folder(spark)}/corpusloom-index-{key}", lambda: C.chunks(spark, d).where(where), **options)


def phrases(spark: SparkSession, d: str) -> SearchIndex:
    return index(spark, d, "phrases", fields=("body",), positions=True)


def stemmed(spark: SparkSession, d: str) -> SearchIndex:
    return index(spark, d, "english", fields=("body",), analyze=A.analyzed("english"), analyzer="english")


def stores(spark: SparkSession, d: str) -> dict[str, SearchIndex]:
    """Two stores with statistics of their own."""
    return {name: index(spark, d, f"store {name}", f"doc_id % 2 = {k}", fields=("body",)) for k, name in enumerate("ab")}


PAGE = {"total": False, "body": False}
T1 = ["the", "house", "thre"]
T2 = ["the", "erer"]


@query(S.bm25_sql(T1, BODY) + "SELECT source, chunk_index, score FROM scored ORDER BY score DESC, source, chunk_index LIMIT 10")
def search_bm25_body(spark, d):
    return hits(index(spark, d).search(S.Query(T1), boosts=BODY, **PAGE))


@query(S.bm25_sql(T1, BOTH) + "SELECT source, chunk_index, score FROM scored ORDER BY score DESC, source, chunk_index LIMIT 20")
def search_multifield(spark, d):
    return hits(index(spark, d).search(S.Query(T1), limit=20, boosts=BOTH, **PAGE))


@query(S.bm25_sql(T1, BOTH) + "SELECT s.source, s.chunk_index, s.score, d.chunk_count AS chunk_total FROM (SELECT source, chunk_index, score FROM scored ORDER BY score DESC, source, chunk_index LIMIT 20) s LEFT JOIN docs_v d ON s.source = d.source")
def search_chunk_total(spark, d):
    return hits(index(spark, d).search(S.Query(T1), limit=20, boosts=BOTH, **PAGE), "chunk_total")


@query(S.bm25_sql(T2, BOTH) + "SELECT source, chunk_index, score FROM scored WHERE topic = 'src3' AND lang = 'en' ORDER BY score DESC, source, chunk_index LIMIT 10")
def search_filter_topic(spark, d):
    return hits(index(spark, d).search(S.Query(T2), equal={"topic": "src3", "lang": "en"}, boosts=BOTH, **PAGE))


@query(S.bm25_sql(T2, BODY) + "SELECT source, chunk_index, score FROM (SELECT * FROM scored ORDER BY score DESC, source, chunk_index LIMIT 1000) WHERE contains(source, '7') ORDER BY score DESC, source, chunk_index LIMIT 15")
def search_filter_source_pool(spark, d):
    return hits(index(spark, d).search(S.Query(T2), source="7", limit=15, boosts=BODY, **PAGE))


@query(S.bm25_sql(T2, BODY) + "SELECT source, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, source, chunk_index) AS r FROM scored) WHERE r <= 2 ORDER BY score DESC, source, chunk_index LIMIT 25")
def search_max_per_source(spark, d):
    return hits(index(spark, d).search(S.Query(T2), max_per_source=2, limit=25, boosts=BODY, **PAGE))


@query(S.bm25_sql(T2, BODY) + "SELECT source, chunk_index, score, row_number() OVER (ORDER BY source, chunk_index) - 1 AS rank FROM (SELECT * FROM scored ORDER BY score DESC, source, chunk_index LIMIT 1000) ORDER BY source, chunk_index LIMIT 20")
def search_sort_source(spark, d):
    return hits(index(spark, d).search(S.Query(T2), sort="source", limit=20, boosts=BODY, **PAGE), "rank")


@query(S.bm25_sql(T2, BODY) + "SELECT source, chunk_index, score, topic FROM (SELECT * FROM scored ORDER BY score DESC, source, chunk_index LIMIT 1000) ORDER BY topic DESC NULLS LAST, source DESC, chunk_index DESC LIMIT 20")
def search_sort_topic_reverse(spark, d):
    return hits(index(spark, d).search(S.Query(T2), sort="topic", reverse=True, limit=20, boosts=BODY, **PAGE), "topic")


@query(S.bm25_sql(T2, BODY) + "SELECT source, chunk_index, score, row_number() OVER (ORDER BY score DESC, source, chunk_index) - 1 AS rank, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY score DESC, source, chunk_index LIMIT 10 OFFSET 10")
def search_offset(spark, d):
    return hits(index(spark, d).search(S.Query(T2), offset=10, boosts=BODY, body=False), "rank", "total")


@query(S.bm25_sql(T2, BOTH) + "SELECT count(*) AS total FROM scored WHERE lang = 'en'")
def search_total(spark, d):
    return index(spark, d).total(S.Query(T2), BOTH, {"lang": "en"})


@query(S.bm25_sql(T2, BODY, where="AND list_contains(w_body, 'the') AND list_contains(w_body, 'erer')") + "SELECT source, chunk_index, score FROM scored ORDER BY score DESC, source, chunk_index LIMIT 20")
def search_and(spark, d):
    return hits(index(spark, d).search(A.parse("the AND erer"), limit=20, boosts=BODY, **PAGE))


@query(S.bm25_sql(["erer"], BODY, where="AND NOT list_contains(w_body, 'the')") + "SELECT source, chunk_index, score FROM scored ORDER BY score DESC, source, chunk_index LIMIT 20")
def search_not(spark, d):
    return hits(index(spark, d).search(A.parse("erer NOT the"), limit=20, boosts=BODY, **PAGE))


@query(S.bm25_sql(["of", "the"], BODY, where="AND contains(' ' || array_to_string(w_body, ' ') || ' ', ' of the ')") + "SELECT source, chunk_index, score FROM scored ORDER BY score DESC, source, chunk_index LIMIT 20")
def search_phrase(spark, d):
    return hits(phrases(spark, d).search(A.parse('"of the"'), limit=20, boosts=BODY, **PAGE))


@query()
def search_stemmed(spark, d):
    q = A.parse("thing edges", "english", A.stop_words("english"))
    return hits(stemmed(spark, d).search(q, limit=20, boosts=BODY, **PAGE))


@query()
def search_snippets(spark, d):
    page = index(spark, d).search(S.Query(T1), limit=10, boosts=BODY, total=False)
    return page.select(*HIT, A.snippets(F.col("body"), T1).alias("snippet"))


@query(", t AS (SELECT source_id, chunk_index, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS term FROM chunks_v) SELECT term, count(DISTINCT source_id || ':' || chunk_index) AS df, count(*) AS cf FROM t GROUP BY term")
def postings_terms(spark, d):
    return index(spark, d).terms.where("field = 'body'").select("term", "df", "cf")


@query(", x AS (SELECT len(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS b, len(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS t FROM chunks_v) SELECT 'body' AS field, count(*) AS n, round(avg(b), 6) AS avg_len FROM x UNION ALL SELECT 'title', count(*), round(avg(t), 6) FROM x")
def index_field_stats(spark, d):
    return index(spark, d).field_stats()


@query("SELECT source, topic, lang, word_count FROM docs_v WHERE lower(lang) = 'en' AND lower(topic) = 'src1' AND contains(lower(title), 'the') ORDER BY source LIMIT 500")
def docs_list_filter(spark, d):
    return L.page(L.doc_filters(C.docs(spark, d), lang="EN", topic="SRC1", title="The").orderBy(*L.doc_order()), 500).select("source", "topic", "lang", "word_count")


@query("SELECT source, word_count FROM docs_v ORDER BY word_count DESC, source LIMIT 50")
def docs_sort_words(spark, d):
    return L.page(C.docs(spark, d).orderBy(*L.doc_order("words")), 50).select("source", "word_count")


@query("SELECT source, quality FROM docs_v ORDER BY quality DESC NULLS LAST, source LIMIT 100")
def docs_sort_quality(spark, d):
    return L.page(C.docs(spark, d).orderBy(*L.doc_order("quality")), 100).select("source", "quality")


@query("SELECT source, title FROM docs_v ORDER BY title DESC NULLS LAST, source DESC LIMIT 10 OFFSET 20")
def docs_page_reverse(spark, d):
    return L.page(C.docs(spark, d).orderBy(*L.doc_order("title", True)), None, 20).select("source", "title")


@query("SELECT topic, count(*) AS doc_count, sum(chunk_count) AS chunk_count, sum(word_count) AS word_count FROM docs_v WHERE topic IS NOT NULL GROUP BY topic")
def topics_stats(spark, d):
    return L.topic_stats(C.docs(spark, d))


@query("SELECT topic, count(*) AS doc_count, sum(chunk_count) AS chunk_count, sum(word_count) AS word_count FROM docs_v WHERE contains(lower(topic), 'src1') AND lower(lang) = 'de' GROUP BY topic ORDER BY word_count DESC, topic LIMIT 10")
def topics_filtered(spark, d):
    return L.page(L.topic_stats(L.topic_filters(C.docs(spark, d), topic="SRC1", lang="de")).orderBy(*L.topic_order("words")))


@query(", u AS (SELECT 'all' AS facet, NULL AS value, * FROM docs_v UNION ALL SELECT 'origin', origin, * FROM docs_v UNION ALL SELECT 'kind', kind, * FROM docs_v UNION ALL SELECT 'format', format, * FROM docs_v UNION ALL SELECT 'lang', lang, * FROM docs_v WHERE lang IS NOT NULL) SELECT facet, value, count(*) AS docs, sum(chunk_count) AS chunks, sum(word_count) AS words FROM u GROUP BY facet, value")
def store_info_counts(spark, d):
    return L.store_info(C.docs(spark, d))


@query("SELECT round(sum(word_count) / sum(chunk_count), 1) AS words_per_chunk, round(sum(chunk_count) / count(*), 1) AS chunks_per_doc, round(sum(word_count) / count(*), 1) AS words_per_doc FROM docs_v")
def avg_words_per_chunk(spark, d):
    return L.averages(C.docs(spark, d))


@query(", c AS (SELECT lang, count(*) AS n FROM docs_v WHERE lang IS NOT NULL GROUP BY lang), t AS (SELECT * FROM c ORDER BY n DESC, lang LIMIT 3) SELECT (SELECT string_agg(lang || ': ' || n, ', ' ORDER BY n DESC, lang) FROM t) || CASE WHEN count(*) > 3 THEN ', +' || (count(*) - 3) || ' more' ELSE '' END AS summary FROM c")
def lang_summary(spark, d):
    return L.lang_summary(C.docs(spark, d), 3)


@query("SELECT topic, chunk_count FROM (SELECT topic, sum(chunk_count) AS chunk_count FROM docs_v GROUP BY topic) ORDER BY chunk_count DESC, topic LIMIT 10")
def overview_topics(spark, d):
    return L.topic_stats(C.docs(spark, d)).orderBy(*L.topic_order("chunks")).limit(10).select("topic", "chunk_count")


@query("SELECT c.source, d.title, d.chunk_count, c.chunk_index, c.body FROM chunks_v c JOIN docs_v d USING (source_id) WHERE c.source = 'docs/11.txt'")
def read_doc(spark, d):
    return L.read_doc(C.docs(spark, d), C.chunks(spark, d), "docs/11.txt")


@query("SELECT topic, source, chunk_index, body FROM chunks_v WHERE topic = 'src2'")
def read_topic(spark, d):
    return L.read_topic(C.chunks(spark, d), "src2")


@query(", t AS (SELECT DISTINCT topic AS term FROM docs_v WHERE topic <> ''), m AS (SELECT term, CASE WHEN term = 'SRC1' THEN 0 WHEN lower(term) = 'src1' THEN 1 WHEN contains(lower(term), 'src1') THEN 2 END AS tier FROM t) SELECT term, tier FROM m WHERE tier IS NOT NULL ORDER BY tier, strlen(term), term LIMIT 1")
def resolve_topic(spark, d):
    return L.best_name(L.field_terms(C.docs(spark, d), "topic"), "SRC1")


@query(", m AS (SELECT source, CASE WHEN source = '15.txt' THEN 0 WHEN lower(source) = '15.txt' THEN 1 WHEN suffix(source, '/15.txt') THEN 2 WHEN contains(source, '15.txt') THEN 3 END AS tier FROM docs_v), b AS (SELECT * FROM m WHERE tier = (SELECT min(tier) FROM m)) SELECT source, tier, (SELECT count(*) FROM b) > 1 AS ambiguous FROM b")
def resolve_source_tiers(spark, d):
    return L.resolve_source(C.docs(spark, d), "15.txt")


@query("SELECT DISTINCT lang AS term FROM docs_v WHERE lang <> ''")
def field_terms(spark, d):
    return L.field_terms(C.docs(spark, d), "lang")


@query("SELECT source_id, count(*) AS chunks FROM chunks_v GROUP BY source_id")
def chunks_per_source(spark, d):
    return L.chunks_of_sources(C.chunks(spark, d), C.docs(spark, d))


@query("SELECT source_id, arg_min(topic, chunk_index) AS topic, count(*) AS chunk_count, sum(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))) AS word_count FROM chunks_v GROUP BY source_id")
def document_rollup(spark, d):
    return L.rollup(C.chunks(spark, d))


@query(", s AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS store FROM chunks_v)" + S.bm25_sql(T2, BODY, "s", by="store") + ", r AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY score DESC, source, chunk_index) AS r FROM scored), z AS (SELECT *, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM r WHERE r <= 20 WINDOW w AS (PARTITION BY store)) SELECT store, source, chunk_index, norm FROM z ORDER BY norm DESC, source, chunk_index LIMIT 20")
def fed_search_normalized(spark, d):
    return FED.search_stores(stores(spark, d), S.Query(T2), boosts=BODY).select("store", "source", "chunk_index", "norm")


@query("SELECT topic, count(*) AS doc_count, sum(chunk_count) AS chunk_count, sum(word_count) AS word_count FROM docs_v WHERE topic IS NOT NULL GROUP BY topic")
def fed_topics(spark, d):
    docs = both_stores(C.docs(spark, d))
    return FED.merge_topics(L.topic_stats(docs.where("store = 'a'")).unionByName(L.topic_stats(docs.where("store = 'b'"))))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS store, source FROM docs_v ORDER BY word_count DESC, source LIMIT 40")
def fed_docs(spark, d):
    docs = C.docs(spark, d)
    return FED.union_docs({"a": docs.where("doc_id % 2 = 0"), "b": docs.where("doc_id % 2 <> 0")}, L.doc_order("words"), 40).select("store", "source")


@query("SELECT count(*) AS docs, sum(chunk_count) AS chunks, sum(word_count) AS words, round(sum(word_count) / sum(chunk_count), 1) AS words_per_chunk FROM docs_v")
def fed_info(spark, d):
    return FED.merge_info(both_stores(C.docs(spark, d)))


@query("SELECT source_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS store FROM docs_v")
def fed_first_store(spark, d):
    docs = C.docs(spark, d).select("source_id", "doc_id")
    return L.first_store_wins(docs.where("doc_id % 3 = 0").withColumn("store", F.lit("a")).unionByName(docs.withColumn("store", F.lit("b")))).select("source_id", "store")


def stamps(spark, d) -> DataFrame:
    docs = C.read(spark, d, "documents")
    return docs.select("doc_id", C.hash_id(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt"))).alias("source_id"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.octet_length("text").cast("long").alias("size_bytes"), F.concat(F.lit("e"), F.col("doc_id")).alias("etag"), F.sha2("text", 256).alias("content_hash"), F.lit("local").alias("origin"))


def after(spark, d) -> DataFrame:
    """The state afterwards: ids of 0 mod 10 gone, 1 edited, 2 new under another id, 3 only touched, 4 touched and of another etag."""
    s, m = stamps(spark, d).where("doc_id % 10 <> 0"), F.col("doc_id") % 10
    old = s.withColumns({"content_hash": F.when(m == 1, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")), "mtime_ns": F.when(m.isin(1, 3, 4), F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")), "etag": F.when(m.isin(1, 4), F.lit("other")).otherwise(F.col("etag"))})
    return old.unionByName(s.where(m == 2).withColumn("source_id", F.concat(F.lit("new"), F.col("source_id"))))


_ST = ", st AS (SELECT d.source_id, d.doc_id, d.doc_id % 10 AS m FROM docs_v d)"


@query(_ST + " SELECT source_id, CASE m WHEN 1 THEN 'changed' WHEN 3 THEN 'etag' WHEN 4 THEN 'hash' ELSE 'stat' END AS tier FROM st WHERE m <> 0 UNION ALL SELECT 'new' || source_id, 'new' FROM st WHERE m = 2")
def freshness_tiers(spark, d):
    return I.freshness(after(spark, d), stamps(spark, d))


@query(_ST + " SELECT source_id FROM st WHERE m = 0")
def stale_sweep(spark, d):
    return I.stale(stamps(spark, d), after(spark, d)).select("source_id")


@query(_ST + " SELECT source_id, CASE m WHEN 0 THEN 'deleted' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS status FROM st UNION ALL SELECT 'new' || source_id, 'added' FROM st WHERE m = 2")
def status_diff(spark, d):
    return I.status_diff(stamps(spark, d), after(spark, d))


@query(", k AS (SELECT source_id, count(*) FILTER (WHERE NOT (doc_id % 11 = 5 AND chunk_index = 0)) AS found, any_value(doc_id) AS doc_id FROM chunks_v WHERE doc_id % 11 <> 3 GROUP BY source_id) SELECT d.source_id, CASE WHEN d.doc_id % 11 = 3 THEN 'missing' WHEN d.doc_id % 11 = 4 THEN 'orphaned' WHEN coalesce(k.found, 0) = 0 THEN 'missing' ELSE 'mismatch' END AS issue FROM docs_v d LEFT JOIN k USING (source_id) WHERE d.chunk_count > 0 AND (d.doc_id % 11 IN (3, 4) OR d.chunk_count <> coalesce(k.found, 0))")
def maintain_check(spark, d):
    chunks = C.chunks(spark, d).where("doc_id % 11 <> 3 and not (doc_id % 11 = 5 and chunk_index = 0)")
    return I.consistency(C.docs(spark, d).where("doc_id % 11 <> 4"), chunks)


@query("SELECT source_id, chunk_index, body FROM chunks_v WHERE doc_id % 10 <> 1 UNION ALL SELECT source_id, 0, 'replaced' FROM docs_v WHERE doc_id % 10 = 1")
def replace_document(spark, d):
    fresh = C.docs(spark, d).where("doc_id % 10 = 1").select("source_id", F.lit(0).cast("long").alias("chunk_index"), F.lit("replaced").alias("body"))
    return I.replace_documents(C.chunks(spark, d).select("source_id", "chunk_index", "body"), fresh)


@query("SELECT source || '#m' AS source FROM docs_v WHERE doc_id % 4 <> 0")
def archive_liveness(spark, d):
    docs = C.docs(spark, d)
    return I.live_archive_members(docs.select(F.concat("source", F.lit("#m")).alias("source")), docs.where("doc_id % 4 <> 0").select("source"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 2, -2), chr(10)) AS content FROM documents")
def strip_lines(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.strip_lines(F.col("text"), 1, 1).alias("content"))


@query("SELECT doc_id, regexp_replace(text, '(?m)^([A-Z])[a-z]+', '\\1_', 'g') AS content FROM documents")
def replace_text(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.replace_text(F.col("text"), "^([A-Z])[a-z]+", "$1_").alias("content"))


@query("SELECT doc_id, nullif(trim(regexp_extract(text, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1)), '') AS found FROM documents")
def extract_regex_meta(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.extract_meta(F.col("text"), r"([0-9]+\.[0-9]+\.[0-9]+)").alias("found"))


#: Inputs and what they amount to, as fixed values that the SQL holds.
LANGUAGE_CASES = [("English", "en"), ("en-US", "en-US"), ("English; French", "en"), ("&lang,", None), ("'eng'", None), ("pt-BR", "pt-BR"), ("PT-br", "pt-br"), ("Catalan", "ca"), ("Indonesian", "id"), ("Malay", "ms"), ("Thai", "th"), ("Vietnamese", "vi"), ("de / fr", "de"), ("français", None)]
KIND_CASES = [("rs", "code"), ("JSON", "data"), ("eml", "email"), ("txt", "document"), ("zig", "code"), ("hs", "code"), ("css", "code"), ("avro", "data"), ("pst", "email"), ("jsonl", "document"), ("msg", "document"), ("SQL", "code"), ("xsd", "data"), ("pdf", "document")]


def _case(expression: str, values: list) -> str:
    quoted = [(i, "NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)]
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN {v}" for i, v in quoted) + " END"


def _pick(values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


@query(f"SELECT doc_id, {_case(f'doc_id % {len(LANGUAGE_CASES)}', [c for _, c in LANGUAGE_CASES])} AS code FROM documents")
def lang_normalize(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.lang_code(_pick([n for n, _ in LANGUAGE_CASES])).alias("code"))


@query("SELECT page_id, replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') AS body FROM pages")
def html_strip(spark, d):
    return C.read(spark, d, "pages").select("page_id", X.html_strip(F.col("html")).alias("body"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>([^<]*)</title>', 1)), '') AS title FROM pages")
def html_title(spark, d):
    return C.read(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@query(f"SELECT doc_id, {_case(f'doc_id % {len(KIND_CASES)}', [k for _, k in KIND_CASES])} AS kind FROM documents")
def kind_detect(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.kind_of(F.concat(F.lit("a/b."), _pick([e for e, _ in KIND_CASES]))).alias("kind"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)(.*)$', 1)) || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)(.*)$', 2)) || regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)(.*)$', 3), '/$', '') AS url FROM pages")
def url_normalize(spark, d):
    return C.read(spark, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents")
def word_count(spark, d):
    return C.read(spark, d, "documents").select("doc_id", C.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ', kb' ELSE 'kb' END AS tags FROM documents")
def config_tags(spark, d):
    return C.read(spark, d, "documents").select("doc_id", X.merge_tags(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit("kb")).alias("tags"))


@query("SELECT source_id, chunk_index, substr(sha256(source_id || chr(0) || body), 1, 32) AS chunk_id FROM chunks_v")
def hash_ids(spark, d):
    return C.chunks(spark, d).select("source_id", "chunk_index", C.chunk_id(F.col("source_id"), F.col("body")).alias("chunk_id"))


@query("SELECT source, chunk_index, quality FROM (SELECT c.source, c.chunk_index, d.quality FROM chunks_v c JOIN docs_v d USING (source_id)) WHERE quality IS NULL OR quality >= 0.3")
def quality_filter(spark, d):
    rows = C.chunks(spark, d).drop("source").join(C.docs(spark, d).select("source_id", "source", "quality"), "source_id")
    return L.quality_filter(rows).select("source", "chunk_index", "quality")


@query("SELECT source FROM docs_v WHERE contains(source, '1') AND quality IS NULL")
def enrich_candidates(spark, d):
    return L.enrich_candidates(C.docs(spark, d), source="1").select("source")


@query("SELECT 'event/' || event_id AS source, event_type AS content, CASE WHEN event_id % 5 = 1 THEN 'code' ELSE 'document' END AS kind, CASE event_id % 3 WHEN 0 THEN 'a, b' WHEN 1 THEN 'x' END AS tags, 'feed' AS topic, NULL AS reason FROM events WHERE event_id % 7 > 2 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE event_id % 7 WHEN 0 THEN 'no source' WHEN 1 THEN 'no content' ELSE 'not a document' END FROM events WHERE event_id % 7 <= 2")
def exec_jsonl(spark, d):
    """Lines as a command prints them: whole ones, and ones without a source, without content, or broken."""
    k = F.col("event_id")
    tags = F.when(k % 3 == 0, F.lit('["a","b"]')).when(k % 3 == 1, F.lit('"x"')).otherwise("null")
    kind = F.when(k % 5 == 0, F.lit('"nothing known"')).when(k % 5 == 1, F.lit('"code"')).otherwise("null")
    whole = F.format_string('{"source":"event/%d","content":"%s","tags":%s,"kind":%s,"topic":"own"}', k, "event_type", tags, kind)
    line = F.when(k % 7 == 0, F.lit('{"source":"","content":"c"}')).when(k % 7 == 1, F.lit('{"source":"s"}')).when(k % 7 == 2, F.lit("{bad json")).otherwise(whole)
    docs, failed = R.exec_jsonl(C.read(spark, d, "events").select(line.alias("value")), topic="feed")
    none = F.lit(None).cast("string")
    return docs.select("source", "content", "kind", "tags", "topic", none.alias("reason")).unionByName(failed.select("reason"), allowMissingColumns=True)


@query("SELECT 'mail/cur/' || conv_id || '.' || turn AS source, 'Turn ' || turn AS title, role || '@mail.example' AS author, CASE turn % 2 WHEN 0 THEN 'seen' ELSE 'replied, flagged' END AS tags, regexp_replace(text, '\\s+', ' ', 'g') AS content FROM conversations WHERE turn % 5 <> 4")
def mail_documents(spark, d):
    """Conversations as messages of a mail folder, every fifth one trashed."""
    turn = F.col("turn")
    flags = F.when(turn % 5 == 4, "ST").when(turn % 2 == 0, "S").otherwise("FR")
    path = F.concat(F.lit("mail/cur/"), "conv_id", F.lit("."), turn, F.lit(":2,"), flags)
    mail = F.concat(F.lit("Subject: Turn "), turn, F.lit("\nFrom: "), "role", F.lit("@mail.example\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.regexp_replace("text", r"\s+", " "))
    files = C.read(spark, d, "conversations").select(path.alias("source"), mail.cast("binary").alias("content"))
    return R.maildir(files).select("source", "title", "author", "tags", "content")


@query()
def page_envelope(spark, d):
    page = L.page(C.docs(spark, d).orderBy(*L.doc_order()), 20).select("source", "topic", "word_count")
    return L.envelope(page, 20, 0)


@query()
def chunk_markdown(spark, d):
    pages = C.read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("# Document\n\n## Text\n\n"), F.col("text")).alias("content"))
    return chunk_documents(pages)


@query()
def extract_builtin(spark, d):
    return C.read(spark, d, "documents").select("doc_id", metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


@query()
def enrich_chunks(spark, d):
    return E.enrich_chunks(C.chunks(spark, d), E.stub)


@query()
def sitemap_pages(spark, d):
    """Sitemaps made of the pages' URLs, a hundred each, read back."""
    maps = C.read(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return maps.select("part", F.explode(R.sitemap_urls(F.col("xml"), "/en/")).alias("url"))


@query("SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) AS source_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents")
def watch_ingest(spark, d):
    """Chunks of the documents, brought by a file stream into a versioned table."""
    from corpusloom.operators.incremental import VersionedTable
    from corpusloom.streaming.watch import watch

    folder = fresh_folder(spark, "watch")
    docs = C.read(spark, d, "documents")
    docs.write.parquet(f"{folder}/in")
    table = VersionedTable(spark, f"{folder}/table")
    shape = lambda b: b.select(C.hash_id(F.col("doc_id").cast("string")).alias("source_id"), "lang", C.word_count(F.col("text")).alias("words"))
    watch(spark, f"{folder}/in", docs.schema, table, f"{folder}/state", shape).awaitTermination()
    return table.read()


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN CASE WHEN event_id % 2 = 0 THEN 'own title' WHEN event_id % 3 = 0 THEN 'other title' END END AS title,
    CASE WHEN event_id % 3 = 1 THEN 'own author' ELSE 'other author' END AS author, CASE WHEN event_id % 7 = 0 THEN 'en' END AS lang, event_type AS tags,
    CASE WHEN event_id % 4 = 0 THEN 'set' WHEN event_id % 3 = 2 THEN 'own topic' ELSE event_type END AS topic, CASE WHEN event_id % 2 = 1 THEN '2001' ELSE '2002' END AS created_at FROM events""")
def metadata_merge(spark, d):
    k, no = F.col("event_id"), F.lit(None).cast("string")
    own = {"title": F.when(k % 2 == 0, "own title"), "author": F.when(k % 3 == 1, "own author"), "topic": F.when(k % 3 == 2, "own topic"), "created_at": F.when(k % 2 == 1, "2001")}
    other = {"title": F.when(k % 3 == 0, "other title"), "author": F.lit("other author"), "lang": F.when(k % 7 == 0, "en"), "tags": F.col("event_type"), "topic": F.col("event_type"), "created_at": F.lit("2002")}
    first, second = [F.struct(*[x.get(f, no).alias(f) for f in FIELDS]) for x in (own, other)]
    found = C.read(spark, d, "events").select("event_id", merged(first, second).alias("m"), F.when(k % 5 == 1, "code").otherwise("document").alias("kind"), F.when(k % 4 == 0, "set").alias("set_topic"))
    return found.select("event_id", settled(F.col("m"), F.col("kind"), F.col("set_topic")).alias("m")).select("event_id", "m.*")
