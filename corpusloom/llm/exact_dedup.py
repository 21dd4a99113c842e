"""Exact deduplication by distributed MSD radix partitioning; no digest decides equality.

1. Each task splits blocks of its own rows by successive bytes (strides that double) until every group is a
   single text or all its texts have ended. One row of a group keeps the text: a group of copies, however
   large, sends one text a block.
2. Rounds over those texts count bytes under each node of a byte trie; nodes heavier than a leaf are split by
   the next byte after their common prefix. A round looks twice as far as the one before where all bytes it
   saw are common, so that a long common header takes few rounds. Nodes hold depths, not prefixes.
   Beyond MAX_LEAVES leaves they grow with the input.
3. A shuffle deals texts out by trie leaf; in a leaf they are ordered by their bytes (an external sort, which
   spills, however large the leaf), and neighbours are compared whole.
4. drop_exact_copies() sends the rows themselves to the leaves and gives those that stay, so texts move once;
   assign_groups() sends texts and joins what it finds to all rows by their number.

Defined results: a null text equals an empty one; of equal texts the row with the largest id stays, a null id
being smaller than any; rows repeated with the same id are copies, of which exactly one stays; an empty table
gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import free_name, prepare

BLOCK_BYTES = 4 << 20
LEAF_BYTES = 16 << 20
MAX_LEAVES = 65_536
#: Bytes after a node's known prefix that a first round looks at for a longer common prefix.
LOOK = 256


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Positions of equal texts, by splitting on successive bytes."""
    done, todo = [], [(list(range(len(texts))), 0, 4)]
    while todo:
        rows, at, stride = todo.pop()
        if len(rows) == 1:
            done.append(rows)
            continue
        parts: dict[tuple[bool, bytes], list[int]] = {}
        for i in rows:
            t = texts[i]
            parts.setdefault((len(t) <= at + stride, t[at : at + stride]), []).append(i)
        for (ended, _), part in parts.items():
            if ended:
                done.append(part)
            else:
                todo.append((part, at + stride, min(stride * 2, 1 << 16)))
    return done


class Trie:
    """Nodes of the byte trie: the length of the prefix that a node's texts have in common, and either children by next byte (-1: the text ends) or a leaf."""

    def __init__(self, most: int) -> None:
        self.depth, self.children, self.heavy, self.most, self.look = [0], [None], [True], most, LOOK

    def leaf(self, text: bytes) -> int:
        at = 0
        while (kids := self.children[at]) is not None:
            n = self.depth[at]
            at = kids[text[n] if len(text) > n else -1]
        return at

    def split(self, at: int, common: int, sizes: dict[int, int]) -> None:
        self.depth[at], self.children[at], self.heavy[at] = common, {}, False
        for byte, size in sorted(sizes.items()):
            self.children[at][byte] = len(self.depth)
            self.depth.append(common + (byte >= 0))
            self.children.append(None)
            self.heavy.append(byte >= 0 and size > self.most)


def _common(a: bytes, b: bytes) -> bytes:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return a[:n]
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return a[:low]


def _round(texts: DataFrame, trie: Trie) -> None:
    """Split every heavy node: find its common prefix, then count bytes by the byte that follows it."""
    depth = max(d for d, h in zip(trie.depth, trie.heavy, strict=True) if h) + trie.look
    heads = texts.select(F.substring("text", 1, depth).alias("head"), F.length("text").alias("n"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[int, bytes] = {}
        for batch in batches:
            for head in batch.column(0).to_pylist():
                if trie.heavy[at := trie.leaf(head)]:
                    known = head[trie.depth[at] :]
                    common[at] = _common(common[at], known) if at in common else known
        yield pa.RecordBatch.from_pydict({"node": pa.array(common.keys(), pa.int32()), "low": pa.array(common.values(), pa.binary())})

    rows = heads.mapInArrow(prefixes, "node int, low binary").groupBy("node").agg(F.min("low").alias("low"), F.max("low").alias("high")).collect()
    found = {r.node: trie.depth[r.node] + len(_common(bytes(r.low), bytes(r.high))) for r in rows}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple[int, int], int] = {}
        for batch in batches:
            for head, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if trie.heavy[at := trie.leaf(head)]:
                    k = found[at]
                    key = at, head[k] if len(head) > k else -1
                    sizes[key] = sizes.get(key, 0) + n
        yield pa.RecordBatch.from_pydict({"node": pa.array([k[0] for k in sizes], pa.int32()), "byte": pa.array([k[1] for k in sizes], pa.int32()), "size": pa.array(sizes.values(), pa.int64())})

    split: dict[int, dict[int, int]] = {}
    for r in heads.mapInArrow(counts, "node int, byte int, size long").groupBy("node", "byte").agg(F.sum("size").alias("size")).collect():
        split.setdefault(r.node, {})[r.byte] = r.size
    total = sum(sum(x.values()) for x in split.values())
    trie.most = max(trie.most, total // MAX_LEAVES)
    further = False
    for at in [i for i, h in enumerate(trie.heavy) if h]:
        if at not in split:
            trie.heavy[at] = False
        elif found[at] >= depth and split[at].keys() == {-1}:
            trie.depth[at], further = found[at], True  # common as far as this round looked; the next one looks twice as far
        else:
            trie.split(at, found[at], split[at])
    trie.look = trie.look * 2 if further else LOOK


class _Groups:
    """Texts to leaves: the local collapse, the trie and the order that both uses of it share. Its own columns get names that docs doesn't have."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, leaf_bytes: int) -> None:
        prepare(docs.sparkSession)
        self.names, self.id_col, self.text_col = docs.columns, id_col, text_col
        self.gid, self.here, self.n, self.most, self.leaf, self.bytes = (free_name(docs, x) for x in ("_gid", "_here", "_n", "_max", "_leaf", "_bytes"))
        self.rows = self._collapsed(docs).checkpoint()
        self.kept = self.rows.where(F.col(self.here))
        texts = self.kept.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
        total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        self.trie = trie = Trie(leaf_bytes)
        trie.heavy[0] = total > trie.most
        while any(trie.heavy):
            _round(texts, trie)

    def _collapsed(self, docs: DataFrame) -> DataFrame:
        """All rows, with a number of the block's group and whether the row stands for it; only rows that do hold their text, the group's size and largest id."""
        inner = T.StructType([*docs.schema.fields, T.StructField(self.gid, T.LongType()), T.StructField(self.here, T.BooleanType()), T.StructField(self.n, T.LongType()), T.StructField(self.most, T.LongType())])
        arrow, id_at, text_at = to_arrow_schema(inner), self.names.index(self.id_col), self.names.index(self.text_col)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            context = TaskContext.get()
            base = (context.partitionId() if context else 0) << 36
            held, size, made = [], 0, 0

            def flush() -> pa.RecordBatch:
                nonlocal made
                block = pa.Table.from_batches(held).combine_chunks()
                ids, texts = block.column(id_at).to_pylist(), [(x or "").encode() for x in block.column(text_at).to_pylist()]
                n = len(texts)
                gid, here, count, most = [0] * n, [False] * n, [None] * n, [None] * n
                for rows in radix_groups(texts):
                    best = max(rows, key=lambda i: (ids[i] is not None, ids[i] or 0, -i))
                    here[best], count[best], most[best] = True, len(rows), ids[best]
                    for i in rows:
                        gid[i] = base + made
                    made += 1
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in block.columns]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                kept = pa.array(here)
                columns[text_at] = pa.compute.if_else(kept, columns[text_at], pa.scalar(None, columns[text_at].type))
                columns += [pa.array(gid, pa.int64()), kept, pa.array(count, pa.int64()), pa.array(most, pa.int64())]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

            for batch in batches:
                held.append(batch)
                size += batch.column(text_at).nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

        import pyarrow.compute  # noqa: F401  pa.compute in the tasks

        return docs.mapInArrow(local, inner)

    def ordered(self, columns: list[str]) -> DataFrame:
        """The rows that stand for their blocks' groups, by leaf and in a leaf by bytes: columns, then the text's bytes and the leaf."""
        trie = self.trie
        rows = self.kept.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{self.text_col}`"), F.lit("")).cast("binary").alias(self.bytes))
        schema = T.StructType([*rows.schema.fields, T.StructField(self.leaf, T.IntegerType())])
        arrow = to_arrow_schema(schema)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = pa.array([trie.leaf(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, leaf], arrow, strict=True)], schema=arrow)

        return rows.mapInArrow(route, schema).repartition(F.col(self.leaf)).sortWithinPartitions(self.leaf, self.bytes)


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """All rows and columns of docs, with _keep_id, _group_size, _kept and _sha256 (longer names where docs has these); only rows that stay hold their text."""
    g = _Groups(docs, id_col, text_col, leaf_bytes)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text, same = None, None, []

        def result() -> list[tuple]:
            keep = max(same, key=lambda r: (r[2] is not None, r[2] or 0, -r[0]))
            size, sha = sum(r[1] for r in same), hashlib.sha256(text).hexdigest()
            return [(r[0], keep[0], keep[2], size, sha) for r in same]

        for batch in batches:
            out = []
            for gid, n, most, t, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if same and (leaf != at or t != text):
                    out += result()
                    same = []
                at, text = leaf, t
                same.append((gid, n, most))
            yield _group_batch(out)
        yield _group_batch(result() if same else [])

    found = g.ordered([g.gid, g.n, g.most]).mapInArrow(groups, "_gid long, _keep_gid long, _keep_id long, _group_size long, _sha256 string")
    new = {c: free_name(docs, c) for c in ("_keep_gid", "_keep_id", "_group_size", "_sha256", "_kept")}
    found = found.withColumnsRenamed({"_gid": g.gid} | {c: new[c] for c in ("_keep_gid", "_keep_id", "_group_size", "_sha256")})
    joined = g.rows.drop(g.n, g.most).join(found, g.gid)
    kept = F.col(g.here) & (F.col(g.gid) == F.col(new["_keep_gid"]))
    return joined.select(*[F.col(f"`{c}`") for c in g.names], new["_keep_id"], new["_group_size"], kept.alias(new["_kept"]), new["_sha256"])


def _group_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (("_gid", pa.int64()), ("_keep_gid", pa.int64()), ("_keep_id", pa.int64()), ("_group_size", pa.int64()), ("_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    out = assign_groups(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return out.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha256").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """The rows of docs that stay, with their own columns. A block's row of the largest id goes to the text's leaf, where the largest of all blocks stays."""
    g = _Groups(docs, id_col, text_col, leaf_bytes)
    arrow, width = to_arrow_schema(docs.schema), len(docs.columns)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # rank, leaf, text and row of the best so far of the text at hand

        for batch in batches:
            gids, ids, texts, leaves = (batch.column(width + i).to_pylist() for i in range(4))
            done: list[pa.RecordBatch] = []
            for i, (gid, most, text, leaf) in enumerate(zip(gids, ids, texts, leaves, strict=True)):
                rank = most is not None, most or 0, -gid
                if held and (leaf != held[1] or text != held[2]):
                    done.append(held[3])
                    held = None
                if held is None or rank > held[0]:
                    held = rank, leaf, text, batch.slice(i, 1)
            yield from done
        if held:
            yield held[3]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in itertools.batched(first(batches), 256):
            table = pa.Table.from_batches([p.select(list(range(width))) for p in part]).combine_chunks()
            yield from table.cast(arrow).to_batches()

    # the text goes as bytes, and is a text again at the end
    ordered = g.ordered([*g.names, g.gid, g.most])
    return ordered.mapInArrow(rows, docs.schema)
