"""Change detection, sweeps, replacement, consistency, and versioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.storage import Files


def freshness(found: DataFrame, stamps: DataFrame) -> DataFrame:
    """source_id and tier: `stat` (time and size equal), `etag`, `hash` (of the content before transforms), `changed` or `new`."""
    f, s = found.alias("f"), stamps.alias("s")
    eq = lambda c: F.coalesce(F.col(f"f.{c}") == F.col(f"s.{c}"), F.lit(False))
    tier = F.when(F.col("s.source_id").isNull(), "new").when(eq("mtime_ns") & eq("size_bytes"), "stat").when(eq("etag"), "etag").when(eq("content_hash"), "hash").otherwise("changed")
    return f.join(s, F.col("f.source_id") == F.col("s.source_id"), "left").select("f.source_id", tier.alias("tier"))


def stale(stored: DataFrame, seen: DataFrame, origins: tuple[str, ...] = ("local", "git", "s3", "url", "maildir"), discard_feeds: bool = False) -> DataFrame:
    """Stored documents that were not seen; of feeds only where discarding is on."""
    swept = [*origins, "feed"] if discard_feeds else list(origins)
    return stored.join(seen.select("source_id"), "source_id", "left_anti").where(F.col("origin").isin(swept))


def status_diff(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """(source_id, status): added, deleted, changed or unchanged, by content_hash."""
    a, b = stored.select("source_id", F.col("content_hash").alias("x")), remote.select("source_id", F.col("content_hash").alias("y"))
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(F.col("x") == F.col("y"), "unchanged").otherwise("changed")
    return a.join(b, "source_id", "full_outer").select("source_id", status.alias("status"))


def replace_documents(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after the documents of fresh are replaced by it."""
    return chunks.join(fresh.select("source_id").distinct(), "source_id", "left_anti").unionByName(fresh)


def consistency(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, issue): orphaned chunks, missing chunks, or a count that differs."""
    counted = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("found"))
    both = docs.select("source_id", "chunk_count").join(counted, "source_id", "full_outer")
    issue = F.when(F.col("chunk_count").isNull(), "orphaned").when((F.col("chunk_count") > 0) & F.col("found").isNull(), "missing").when(F.col("chunk_count") != F.coalesce("found", F.lit(0)), "mismatch")
    return both.select("source_id", issue.alias("issue")).where("issue is not null")


def repair(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A mismatch loses its document and chunks, a missing one its document, an orphan its chunks."""
    issues = consistency(docs, chunks)
    return docs.join(issues.where("issue <> 'orphaned'"), "source_id", "left_anti"), chunks.join(issues.where("issue <> 'missing'"), "source_id", "left_anti")


def live_archive_members(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents whose source, up to a `#`, was seen."""
    return docs.join(seen.select(F.col("source").alias("_seen")).distinct(), F.substring_index("source", "#", 1) == F.col("_seen"), "left_semi")


def owned(docs: DataFrame, kind: str, base: str) -> DataFrame:
    """Documents that a configured source owns."""
    s = F.col("source")
    test = {"git": s.startswith(base + "#"), "local": (s == base) | s.startswith(base.rstrip("/") + "/"), "s3": (s == base) | s.startswith(base.rstrip("/") + "/"), "url": s == base, "maildir": s.startswith(base)}.get(kind, F.lit(False))
    return docs.where(test)


class TableError(RuntimeError):
    """A table whose pointers are lost, or that another commit has changed meanwhile."""


class VersionedTable:
    """A table as folders of buckets of a key, and numbered pointers to them. The path is on storage that driver and executors share.

    A commit writes new folders, then one pointer CURRENT.<n> that lists, by bucket, the folder that holds it, and the schema. A
    pointer is a new file with an end mark; readers take the highest that is whole, so that a commit that breaks off at any step leaves
    the table as it was. Nobody's pointer is written over: of two commits at a time one fails. Upserts and deletes write anew only
    the buckets of the keys that they bring."""

    def __init__(self, spark: SparkSession, path: str, key: str = "source_id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets, self.files = spark, path.rstrip("/"), key, buckets, Files(spark, path)

    def _pointer(self) -> tuple[int, dict | None]:
        numbers = sorted((int(n.split(".")[1]) for n in self.files.names() if n.startswith("CURRENT.")), reverse=True)
        for n in numbers:
            try:
                held = json.loads(self.files.read(f"CURRENT.{n}"))
            except ValueError:  # broken off while it was written
                continue
            if held.get("end"):
                return numbers[0], held
        # a first commit that broke off has folders of number 1 only
        if any(n.startswith("v-") and int(n.split("-")[1]) > 1 for n in self.files.names()):
            raise TableError(f"{self.path} has versions, but no pointer to them")
        return (numbers or [0])[0], None

    def version(self) -> str | None:
        held = self._pointer()[1]
        return held and held["version"]

    def read(self) -> DataFrame | None:
        held = self._pointer()[1]
        return None if held is None else self._rows(held, held["buckets"])

    def _rows(self, held: dict, folders: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{v}/_b={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _commit(self, rows: DataFrame, kept: dict[str, str], number: int, n: int) -> str:
        v = f"v-{number + 1}-{uuid.uuid4().hex}"
        rows.withColumn("_b", self._bucket(n)).repartition("_b").write.partitionBy("_b").parquet(f"{self.path}/{v}")
        new = {name.split("=")[1]: v for name in self.files.names(v) if name.startswith("_b=")}
        try:
            self.files.create(f"CURRENT.{number + 1}", json.dumps({"version": v, "n": n, "buckets": kept | new, "schema": rows.schema.jsonValue(), "end": True}))
        except Exception as e:
            raise TableError(f"{self.path} was changed by another commit, or its pointer could not be written") from e
        return v

    def commit(self, rows: DataFrame) -> str:
        """rows are the whole table from now on."""
        return self._commit(rows, {}, self._pointer()[0], self.buckets)

    def _change(self, keys: DataFrame, fresh: DataFrame | None) -> str:
        number, held = self._pointer()
        if held is None:
            return self._commit(fresh if fresh is not None else keys.limit(0), {}, number, self.buckets)
        n, keys = held["n"], keys.select(self.key).distinct()
        touched = {str(r.b) for r in keys.select(self._bucket(n).alias("b")).distinct().collect()}  # at most n
        rows = self._rows(held, {b: v for b, v in held["buckets"].items() if b in touched}).join(keys, self.key, "left_anti")
        rows = rows if fresh is None else rows.unionByName(fresh, allowMissingColumns=True)
        return self._commit(rows, {b: v for b, v in held["buckets"].items() if b not in touched}, number, n)

    def upsert(self, fresh: DataFrame, key: str | None = None) -> str:
        """The rows of fresh replace all rows of their keys."""
        if key not in (None, self.key):
            raise ValueError(f"the table is kept by {self.key}")
        return self._change(fresh, fresh)

    def delete(self, keys: DataFrame, key: str | None = None) -> str:
        if key not in (None, self.key):
            raise ValueError(f"the table is kept by {self.key}")
        return self._change(keys, None)

    def compact(self, files: int = 1) -> str:
        """One file a bucket, and the pointer before this one's versions are the only others that stay."""
        v = self.commit(self.read())
        pointers = sorted((int(n.split(".")[1]) for n in self.files.names() if n.startswith("CURRENT.")))
        used = set()
        for n in pointers[-2:]:
            held = json.loads(self.files.read(f"CURRENT.{n}") or "{}")
            used |= set(held.get("buckets", {}).values()) | {held.get("version")}
        for n in pointers[:-2]:
            self.files.delete(f"CURRENT.{n}")
        for name in self.files.names():
            if name.startswith("v-") and name not in used:
                self.files.delete(name)
        return v
