"""A stored inverted index, and ranked search that reads the postings of a query's terms only.

Tables of an index folder, all Parquet:
- chunks: document number, chunk_index and every column of the chunk, in order of the numbers, which follow the order of sources;
  a folder for every range of them;
- docs: document number, source, number of chunks and the document's filter fields, in like folders;
- postings: bucket (a hash of the term), field, term, document number, chunk_index, tf, len, positions if wanted; one folder a
  bucket, sorted by term, so that a search reads its terms' folders and in these the row groups of its terms. A bucket is cut by
  ranges of documents, so a term that every chunk has is in many files;
- terms: bucket, field, term, df, cf; and index.json with n, the fields' lengths and the analyzer. All are written once.

A search looks up the statistics of its terms, aggregates scores of their postings by chunk, and takes the best of them with the
total from the same exchange. Only that page (at most POOL rows) comes to the driver; its rows are read from chunks by number.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.search import B, BOOSTS, K1, MAX_LIMIT, POOL, Query, tokens
from corpusloom.storage import Files

FILTERS = ("topic", "author", "lang", "origin", "kind", "format")
#: Bytes of text a bucket of postings, and the bounds of their number.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 16, 1 << 14
FORMAT = 2
#: A document number has the range of its document above these bits.
PART_BITS = 33


class IndexOutdated(RuntimeError):
    """The index was written by another format or analyzer."""


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def count_words(rows: DataFrame, fields: list[str], positions: bool) -> DataFrame:
    """(did, chunk_index, and an array of words for each field) to postings. A chunk is one row, so its words are counted in an Arrow batch, without a shuffle; codes and counts are array operations."""
    places = [pa.field("positions", pa.list_(pa.int32()))] if positions else []
    schema = pa.schema([pa.field("field", pa.string()), pa.field("term", pa.string()), pa.field("did", pa.int64()), pa.field("chunk_index", pa.int64()), pa.field("tf", pa.int32()), pa.field("len", pa.int32()), *places])

    def of_field(batch: pa.RecordBatch, i: int, name: str) -> pa.RecordBatch:
        words = batch.column(i)
        flat, owner = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy().astype(np.int64)
        coded = flat.dictionary_encode()
        key = owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(key, kind="stable")
        _, first, tf = np.unique(key[order], return_index=True, return_counts=True)
        rows, code = owner[order[first]], coded.indices.to_numpy()[order[first]]
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False)[rows].astype(np.int32)
        columns = [pa.repeat(name, len(rows)), coded.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(tf, pa.int32()), pa.array(size, pa.int32())]
        if positions:
            start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])[owner]
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(order)]]), pa.int32()), pa.array((np.arange(len(owner)) - start)[order], pa.int32())))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        for batch in batches:
            for i, name in enumerate(fields):
                yield of_field(batch, i + 2, name)

    return rows.mapInArrow(run, "field string, term string, did long, chunk_index long, tf int, len int" + ", positions array<int>" * positions)


def _stored(rows: DataFrame, path: str, by: str) -> DataFrame:
    """rows, written in folders by a column and read again; of their schema also where there are none."""
    rows.write.partitionBy(by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def build_index(chunks: DataFrame, path: str, fields: tuple[str, ...] = ("body", "title"), analyze=tokens, analyzer: str = "none", positions: bool = False, by: tuple[str, ...] = ()) -> None:
    """Writes the index of chunks (source, chunk_index and the fields; other columns are kept) under path, which must be new. by: further document columns, as a document's first chunk has them."""
    spark, files = chunks.sparkSession, Files(chunks.sparkSession, path)
    if files.exists():
        raise FileExistsError(path)
    # one range shuffle of the texts orders them; a document's number is that of its first chunk
    ordered = chunks.withColumn("chunk_index", F.col("chunk_index").cast("long")).repartitionByRange("source").sortWithinPartitions("source", "chunk_index").withColumn("rid", F.monotonically_increasing_id())
    of_source = Window.partitionBy("source")
    numbered = ordered.withColumns({"did": F.min("rid").over(of_source), "chunk_total": F.count(F.lit(1)).over(of_source), "part": F.shiftright("rid", PART_BITS).cast("int")})
    rows = _stored(numbered, f"{path}/chunks", "part")
    attrs = [c for c in (*FILTERS, *by) if c in chunks.columns]
    docs = _stored(rows.where("rid = did").select("part", "did", "source", "chunk_total", *attrs), f"{path}/docs", "part")
    size, n = rows.agg(sum((F.sum(F.coalesce(F.octet_length(f), F.lit(0)).cast("long")) for f in fields), F.lit(0)), F.count(F.lit(1))).first()
    buckets = 1 << max(LEAST_BUCKETS, min(MOST_BUCKETS, (size or 0) // BUCKET_BYTES)).bit_length() - 1
    words = rows.select("did", "chunk_index", *[analyze(F.col(f)).alias(f"w_{f}") for f in fields])
    postings = count_words(words, list(fields), positions).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # a bucket's postings are dealt by ranges of documents, so that a term that every chunk has is in many files
    order = ["bucket", "field", "term", "did", "chunk_index"]
    stored = _stored(postings.repartition("bucket", F.shiftright("did", PART_BITS)).sortWithinPartitions(*order), f"{path}/postings", "bucket")
    counts = stored.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    terms = _stored(counts.repartition("bucket").sortWithinPartitions("bucket", "field", "term"), f"{path}/terms", "bucket")
    lengths = terms.groupBy("field").agg(F.sum("cf").alias("total")).collect()
    schemas = {"chunks": rows, "docs": docs, "postings": stored, "terms": terms}
    files.create("index.json", json.dumps({"format": FORMAT, "analyzer": analyzer, "buckets": buckets, "n": n, "total": {f: 0 for f in fields} | {r.field: r.total for r in lengths}, "positions": positions, "schemas": {k: t.schema.jsonValue() for k, t in schemas.items()}}))


class SearchIndex:
    """An index folder opened for reading."""

    def __init__(self, spark: SparkSession, path: str, analyzer: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.meta = json.loads(Files(spark, path).read("index.json"))
        if self.meta["format"] != FORMAT or analyzer not in (None, self.meta["analyzer"]):
            raise IndexOutdated(f"format {self.meta['format']}, analyzer {self.meta['analyzer']}")
        self.fields = list(self.meta["total"])
        self.docs, self.chunks, self.postings, self.terms = (spark.read.schema(StructType.fromJson(self.meta["schemas"][t])).parquet(f"{path}/{t}") for t in ("docs", "chunks", "postings", "terms"))
        self._df: dict[str, dict[str, int]] = {}
        self._bucket: dict[str, int] = {}

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        for t in terms:
            if t not in self._bucket:  # a constant, folded without a job
                self._bucket[t] = self.spark.sql(f"SELECT CAST(pmod(xxhash64(:t), {self.meta['buckets']}) AS INT) AS b", {"t": t}).first().b
        return table.where(F.col("bucket").isin(sorted({self._bucket[t] for t in terms})) & F.col("term").isin(list(terms)))

    def _rows(self, table: DataFrame, numbers: list[int]) -> DataFrame:
        """The rows of some documents: their folders, and in these their row groups."""
        if not numbers:
            return table.limit(0)
        return table.where(F.col("part").isin(sorted({n >> PART_BITS for n in numbers})) & F.col("did").isin(numbers)).drop("part")

    def df(self, terms: list[str]) -> dict[str, dict[str, int]]:
        """By term and field, the number of chunks; a query's terms are few. Answers are kept."""
        new = [t for t in dict.fromkeys(terms) if t not in self._df]
        if new:
            if len(self._df) > 100_000:
                self._df.clear()
            for t in new:
                self._df[t] = {}
            for r in self._of(self.terms, new).select("term", "field", "df").collect():
                self._df[r.term][r.field] = r.df
        return {t: self._df[t] for t in terms}

    def score(self, query: Query, boosts: dict[str, float] | None = None, equal: dict[str, str] | None = None) -> DataFrame:
        """did, chunk_index, score of the chunks that match."""
        boosts = {f: b for f, b in (boosts or BOOSTS).items() if f in self.fields}
        if query.phrases and not self.meta["positions"]:
            raise ValueError("this index has no positions: it can't answer phrases")
        wanted, n = list(dict.fromkeys([*query.scored, *query.excluded])), self.meta["n"]
        known = self.df(wanted)
        # weights are looked up in constant maps, which generated code only refers to: queries of a shape share their code
        weights = {f"{f} {t}": b * math.log(1 + (n - d + 0.5) / (d + 0.5)) * (K1 + 1) for t in query.scored for f, b in boosts.items() if (d := known[t].get(f))}
        constant = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        size, x = F.col("len"), F.col("tf").cast("double")
        average = F.try_element_at(constant({f: max(1, self.meta["total"][f]) / max(1, n) for f in boosts}), F.col("field"))
        part = F.coalesce(F.try_element_at(constant(weights or {"": 0.0}), F.concat_ws(" ", "field", "term")), F.lit(0.0)) * x / (x + K1 * (1 - B + B * size / average))
        has = lambda t: F.max((F.col("term") == t).cast("int"))
        aggs = [F.sum(part).alias("raw")]
        aggs += [has(t).alias(f"need_{i}") for i, t in enumerate(query.required)]
        aggs += [has(t).alias(f"not_{i}") for i, t in enumerate(query.excluded)]
        aggs += [F.max(F.when((F.col("term") == w) & (F.col("field") == "body"), F.col("positions"))).alias(f"at_{i}_{k}") for i, p in enumerate(query.phrases) for k, w in enumerate(p)]
        rows = self._of(self.postings, wanted).where(F.col("field").isin(list(boosts)))
        if equal:
            kept = self.docs
            for name, value in equal.items():
                kept = kept.where(F.col(name) == value)
            rows = rows.join(kept.select("did"), "did", "left_semi")
        found = rows.groupBy("did", "chunk_index").agg(*aggs)
        test = F.col("raw") > 0
        for i in range(len(query.required)):
            test = test & (F.col(f"need_{i}") == 1)
        for i in range(len(query.excluded)):
            test = test & (F.col(f"not_{i}") == 0)
        for i, p in enumerate(query.phrases):
            def follows(start: Column, i: int = i, n: int = len(p)) -> Column:
                out = F.lit(True)
                for k in range(1, n):
                    out = out & F.array_contains(f"at_{i}_{k}", start + k)
                return out

            test = test & F.coalesce(F.exists(f"at_{i}_0", lambda start: follows(start)), F.lit(False))
        return found.where(test).select("did", "chunk_index", F.round("raw", 6).alias("score"))

    def field_stats(self) -> DataFrame:
        """field, n, avg_len."""
        n = self.meta["n"]
        return self.spark.createDataFrame([(f, n, round(t / n, 6) if n else 0.0) for f, t in self.meta["total"].items()], "field string, n long, avg_len double")

    def total(self, query: Query, boosts: dict[str, float] | None = None, equal: dict[str, str] | None = None) -> DataFrame:
        return self.score(query, boosts, equal).agg(F.count(F.lit(1)).alias("total"))

    def search(self, query: Query, *, equal: dict[str, str] | None = None, source: str | None = None, max_per_source: int | None = None, sort: str = "score", reverse: bool = False, limit: int = 10, offset: int = 0, boosts: dict[str, float] | None = None, total: bool = True, body: bool = True) -> DataFrame:
        """A page of hits: document columns, chunk_index, score, rank (0-based, by page), total if wanted, and the chunk's other columns
        if body. Filters of equality bind before the pool; the source substring, other sorts and reversal work on the POOL best by
        score; a cap with neither is by source, best first, whatever the pool; total counts before all these."""
        limit = max(0, min(limit, MAX_LIMIT))
        best = [F.desc("score"), F.asc("did"), F.asc("chunk_index")]
        plain = sort == "score" and not reverse and source is None
        page: list[tuple] = []
        if limit:
            scored = self.score(query, boosts, equal)
            top = scored
            if max_per_source and plain:
                top = top.withColumn("_r", F.row_number().over(Window.partitionBy("did").orderBy(*best))).where(F.col("_r") <= max_per_source).drop("_r")
            top = top.orderBy(*best)
            top = top.offset(offset).limit(limit) if plain else top.limit(POOL)
            if total:  # from the same aggregate, whose exchange is used again
                top = top.crossJoin(F.broadcast(scored.where("score is not null").agg(F.count(F.lit(1)).alias("total"))))
            page = sorted(((r.did, r.chunk_index, r.score, r.total if total else None) for r in top.collect()), key=lambda r: (-r[2], r[0], r[1]))
        if not plain:
            names = {r.did: (r.source, r.topic if "topic" in self.docs.columns else None) for r in self._rows(self.docs, sorted({r[0] for r in page})).collect()}
            if source is not None:
                page = [r for r in page if source in names[r[0]][0]]
            if max_per_source:
                seen: Counter = Counter()
                page = [r for r in page if (seen.update([r[0]]) or seen[r[0]]) <= max_per_source]
            if sort != "score":  # nulls come first; numbers of documents follow their sources
                page.sort(key=lambda r: ((names[r[0]][1] is not None, (names[r[0]][1] or "").encode()) if sort == "topic" else (), r[0], r[1]))
            if reverse:
                page.reverse()
            page = page[offset : offset + limit]
        numbers = sorted({r[0] for r in page})
        columns = list(zip(*page, strict=True)) or [()] * 4
        table = {"did": pa.array(columns[0], pa.int64()), "chunk_index": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64()), "rank": pa.array(range(offset, offset + len(page)), pa.int64())}
        if total:
            table["total"] = pa.array(columns[3], pa.int64())
        hits = F.broadcast(self.spark.createDataFrame(pa.table(table))).join(self._rows(self.docs, numbers), "did")  # at most POOL rows
        if body:
            text = self._rows(self.chunks, numbers).drop("rid", *[c for c in self.docs.columns if c not in ("did", "part")])
            hits = F.broadcast(hits).join(text, ["did", "chunk_index"])
        return hits.drop("did").coalesce(1).sortWithinPartitions("rank")


def open_or_build(spark: SparkSession, path: str, make, **options) -> SearchIndex:
    """The index under path, built from make() where there is none. Built beside it and moved, so that a broken build leaves nothing that is read."""
    files = Files(spark, path)
    if not files.exists("index.json"):
        draft = f"{path}.{uuid.uuid4().hex}"
        build_index(make(), draft, **options)
        parent = Files(spark, path.rsplit("/", 1)[0])
        if not parent.move(draft.rsplit("/", 1)[1], path.rsplit("/", 1)[1]) or not files.exists("index.json"):
            Files(spark, draft).delete()
    return SearchIndex(spark, path, options.get("analyzer"))
