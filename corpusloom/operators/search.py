"""Ranked search over chunks: BM25 over boosted fields, filters, pools, caps, sorts, pages.

A search is two scans and no shuffle of tokens: the first aggregates corpus statistics (documents, average lengths, document
frequencies of the query's few terms) to one row; the second scores each chunk in place and keeps the top. Statistics of a
corpus that is searched often can be stored (build_postings).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
POOL = 1000
MAX_LIMIT = 1000
#: Boosts of the searched fields.
BOOSTS = {"body": 1.0, "title": 3.0, "section": 2.0, "tags": 2.0, "llm_summary": 1.5, "llm_tags": 1.5}
WORD = r"[\p{L}\p{N}]+"
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
EMOJI = "☀-➿\U0001f300-\U0001faff"
TOKEN = rf"[{CJK}]+|[{EMOJI}]|[\p{{L}}\p{{N}}&&[^{CJK}{EMOJI}]]+"


def tokens(text: Column) -> Column:
    """Words; Han and kana runs as overlapping pairs; each emoji alone: analyze.tokenize() of the lower-cased text, natively. Without Han, kana and emoji these are the runs of WORD."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    split = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]{{2}}"), pairs(r)).otherwise(F.array(r))))
    return F.when(low.rlike(f"[{CJK}]{{2}}"), split).otherwise(runs)


def _follows(words: Column, phrase: list[str]) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(words, i, len(phrase)) == F.array(*map(F.lit, phrase)))


@dataclass
class Query:
    """terms: any may match; required: all must; excluded: none may; phrases: their words must follow one another in the body."""

    terms: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @property
    def scored(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *self.required, *(w for p in self.phrases for w in p)]))


def tf(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term)).cast("double")


def score(chunks: DataFrame, query: Query, boosts: dict[str, float] | None = None, by: str | None = None, analyze=tokens) -> DataFrame:
    """Matching chunks with score; by: a column whose values are stores with statistics of their own."""
    boosts = {f: b for f, b in (boosts or BOOSTS).items() if f in chunks.columns}
    words = chunks.select("*", *[analyze(F.col(f)).alias(f"_w_{f}") for f in boosts])
    terms = query.scored
    stats = [F.count(F.lit(1)).alias("_n")]
    for f in boosts:
        stats.append(F.avg(F.size(f"_w_{f}")).alias(f"_a_{f}"))
        stats += [F.sum(F.array_contains(f"_w_{f}", t).cast("long")).alias(f"_d_{f}_{i}") for i, t in enumerate(terms)]
    one = words.groupBy(*([by] if by else [])).agg(*stats)
    joined = words.join(F.broadcast(one), by) if by else words.crossJoin(F.broadcast(one))  # one row, or one of a store
    total, any_hit, hit = F.lit(0.0), F.lit(False), {}
    for i, t in enumerate(terms):
        hit[t] = F.lit(False)
        for f, boost in boosts.items():
            n, d, w = F.col("_n"), F.col(f"_d_{f}_{i}"), F.col(f"_w_{f}")
            idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
            x = tf(w, t)
            part = boost * idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.size(w) / F.col(f"_a_{f}")))
            total = total + F.when(x > 0, part).otherwise(0.0)
            hit[t] = hit[t] | F.array_contains(w, t)
        any_hit = any_hit | hit[t]
    wanted = any_hit
    for t in query.required:
        wanted = wanted & hit[t]
    for t in query.excluded:
        for f in boosts:
            wanted = wanted & ~F.array_contains(f"_w_{f}", t)
    for p in query.phrases:
        wanted = wanted & _follows(F.col("_w_body"), p)
    keep = [c for c in chunks.columns]
    return joined.where(wanted).select(*keep, F.round(total, 6).alias("score"))


def order(sort: str = "score", reverse: bool = False) -> list[Column]:
    """score desc, source asc or topic asc with nulls first; ties by source and chunk_index; reverse flips them all."""
    keys = {"score": [("score", False)], "source": [], "topic": [("topic", True)]}[sort] + [("source", True), ("chunk_index", True)]
    return [F.col(c).asc_nulls_first() if up != reverse else F.col(c).desc_nulls_last() for c, up in keys]


def search(chunks: DataFrame, query: Query, *, equal: dict[str, str] | None = None, source: str | None = None, max_per_source: int | None = None, sort: str = "score", reverse: bool = False, limit: int = 10, offset: int = 0, boosts: dict[str, float] | None = None, analyze=tokens) -> DataFrame:
    """A page of hits with rank (0-based, by page) and total. Filters of equality bind before the pool; the source substring, the cap, other sorts and reversal work on the POOL best by score; total counts before them."""
    limit = min(limit, MAX_LIMIT)
    hits = score(chunks, query, boosts, analyze=analyze)
    for name, value in (equal or {}).items():
        hits = hits.where(F.col(name) == value)
    if limit <= 0:
        return hits.limit(0).withColumns({"total": F.lit(0).cast("long"), "rank": F.lit(0).cast("long")})
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    plain = sort == "score" and not reverse and source is None and max_per_source is None
    pool = hits
    if not plain:
        if max_per_source and source is None and sort == "score" and not reverse:
            pass  # the cap is by source, best first, whatever the pool
        else:
            pool = pool.orderBy(*order()).limit(POOL)
        if source is not None:
            pool = pool.where(F.col("source").contains(source))
        if max_per_source:
            pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(*order()))).where(F.col("_r") <= max_per_source).drop("_r")
    page = pool.orderBy(*order(sort, reverse)).offset(offset).limit(limit)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*order(sort, reverse))).cast("long") - 1 + offset)  # a page of at most MAX_LIMIT rows
    return ranked.crossJoin(F.broadcast(total))


def match_total(chunks: DataFrame, query: Query, equal: dict[str, str] | None = None, analyze=tokens) -> DataFrame:
    hits = score(chunks, query, analyze=analyze)
    for name, value in (equal or {}).items():
        hits = hits.where(F.col(name) == value)
    return hits.agg(F.count(F.lit(1)).alias("total"))


def build_postings(chunks: DataFrame, fields: tuple[str, ...] = ("body", "title"), analyze=tokens) -> DataFrame:
    """(field, term, source_id, chunk_index, tf, positions): write it partitioned by field and sorted by term, so that a query's terms prune row groups."""
    parts = [chunks.select(F.lit(f).alias("field"), "source_id", "chunk_index", F.posexplode(analyze(F.col(f))).alias("position", "term")) for f in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("field", "term", "source_id", "chunk_index").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def write_postings(postings: DataFrame, path: str) -> None:
    postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(path)


def field_stats(chunks: DataFrame, fields: tuple[str, ...] = ("body", "title"), analyze=tokens) -> DataFrame:
    sizes = chunks.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(analyze(F.col(f))).alias("len")) for f in fields])).alias("x")).select("x.*")
    return sizes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("len"), 6).alias("avg_len"))


def bm25_sql(terms: list[str], boosts: dict[str, float], view: str = "chunks_v", where: str = "", by: str = "") -> str:
    """The CTEs words, stats and scored that score() amounts to."""
    over = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '{WORD}') AS w_{f}" for f in boosts)
    stats = ", ".join([f"avg(len(w_{f})) AS a_{f}" for f in boosts] + [f"sum(CAST(list_contains(w_{f}, '{t}') AS BIGINT)) AS d_{f}_{i}" for f in boosts for i, t in enumerate(terms)])
    parts, hits = [], []
    for i, t in enumerate(terms):
        for f, boost in boosts.items():
            x = f"len(list_filter(w_{f}, lambda w: w = '{t}'))"
            parts.append(f"CASE WHEN {x} > 0 THEN {boost} * ln(1 + (n - d_{f}_{i} + 0.5) / (d_{f}_{i} + 0.5)) * {x} * {K1 + 1} / ({x} + {K1} * (1 - {B} + {B} * len(w_{f}) / a_{f})) ELSE 0.0 END")
            hits.append(f"list_contains(w_{f}, '{t}')")
    group, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f""", words AS (SELECT *, {over} FROM {view}),
stats AS (SELECT {group}count(*) AS n, {stats} FROM words {"GROUP BY " + by if by else ""}),
scored AS (SELECT words.*, round({" + ".join(parts)}, 6) AS score FROM words JOIN stats {join} WHERE ({" OR ".join(hits)}) {where})
"""
