"""Best-fit packing of token sequences with swap-based local search.

tokenize() gives a document's ids and the end id. pieces() cuts only documents longer than a sequence, into whole sequences;
their first piece may be shorter. pack() deals pieces over shards of about SHARD_PIECES by a hash of the row, packs each shard
by best-fit decreasing, then improves it: the emptiest bins are donors, and their pieces go to other underfull bins by moves,
one-for-one and two-for-one exchanges that increase the sum of squared fills, until donors are empty or nothing improves.
A second round does the same with the bins that stayed underfull in any shard.

Defined results: a null text equals an empty one, of one token (the end id); rows that repeat are packed each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_and_text, prepare

CAPACITY, END_ID, SHARD_PIECES = 2048, 0, 20_000
#: Texts of these characters only are split by _SPLIT, which equals the tokenizer's own pattern on them; others are left to it whole.
_ODD = re.compile(r"[^\t\n\r -~¡-ÿ]|<\|endoftext\|>")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", " \t\n\r"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_signs() -> dict[int, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian 32-bit bytes. Keeps the ids of pre-tokens it has met, at most LIMIT.

    The tokenizer merges within pre-tokens only, so a text's ids are those of its pre-tokens in a row. New pre-tokens go to the
    tokenizer's model, one by one, as a batch would start threads that every task on a machine has; texts that the split leaves
    whole go to the tokenizer itself."""

    LIMIT = 400_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.signs = Tokenizer.from_file(path), {}, byte_signs()
        self.merge = self.tokenizer.model.tokenize

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = _SPLIT.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > self.LIMIT:
            known.clear()
            new = list(dict.fromkeys(words))
        for w in new:
            ids = [t.id for t in self.merge(w.encode().decode("latin-1").translate(self.signs))]
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, words))


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, with the end id)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = Encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t) + end for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity if n > capacity else n
    at = [0, *range(first, n, capacity)] if first else list(range(0, n, capacity))
    return [(a, b - a) for a, b in zip(at, [*at[1:], n], strict=True)]


def pieces(tokens: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids if asked for."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (a, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * (a + n)]
                    rows.append((doc, k, a, n, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds[:keep], strict=True)], names=names[:keep])

    return tokens.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions, by best-fit decreasing."""
    bins, room, open_at = [], bytearray(capacity + 1), defaultdict(list)
    free: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        r = room.find(1, n)
        if r < 0:
            bins.append([i])
            free.append(capacity - n)
            b = len(bins) - 1
        else:
            b = open_at[r].pop()
            if not open_at[r]:
                room[r] = 0
            bins[b].append(i)
            free[b] = r - n
        if free[b]:
            open_at[free[b]].append(b)
            room[free[b]] = 1
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, rounds: int = 6, tries: int = 48) -> list[list[int]]:
    """Local search over the underfull bins; gives as many bins or fewer."""
    for _ in range(rounds):
        before = [list(b) for b in bins]
        fill = [sum(lengths[i] for i in b) for b in bins]
        slack = sum(capacity - f for f in fill)
        surplus = slack // capacity
        if not surplus:
            break
        order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (-fill[b], b))
        donors, targets = order[-(surplus + 1) :], order[: -(surplus + 1)]
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> (item, donor)
        has = bytearray(capacity + 1)
        inside = {b: set(bins[b]) for b in donors}

        def put(i: int, b: int) -> None:
            inside[b].add(i)
            at[lengths[i]].append((i, b))
            has[lengths[i]] = 1

        def take(n: int) -> tuple[int, int] | None:
            while at[n]:
                i, b = at[n].pop()
                if i in inside[b]:
                    inside[b].remove(i)
                    has[n] = bool(at[n])
                    return i, b
            has[n] = 0
            return None

        for b in donors:
            for i in bins[b]:
                at[lengths[i]].append((i, b))
                has[lengths[i]] = 1
        changed = False
        for t in targets:
            again = True
            while again and fill[t] < capacity:
                again, r = False, capacity - fill[t]
                best = (0, None, ())
                if (n := has.rfind(1, 1, r + 1)) > 0:
                    best = (n, None, (n,))
                for i in sorted(set(bins[t]), key=lambda i: lengths[i]) if best[0] < r else ():
                    a = lengths[i]
                    b = has.rfind(1, a + 1, a + r + 1)
                    if b > 0 and b - a > best[0]:
                        best = (b - a, i, (b,))
                    left = tries
                    b1 = min(a + r - 1, capacity)
                    while best[0] < r and left and (b1 := has.rfind(1, (a + r) // 2 if a + r > 2 else 1, b1 + 1)) > 0:
                        b2 = has.rfind(1, 1, min(b1, a + r - b1) + 1)
                        if b2 > 0 and b1 + b2 - a > best[0] and (b1 != b2 or len(at[b1]) > 1):
                            best = (b1 + b2 - a, i, (b1, b2))
                        b1 -= 1
                        left -= 1
                    if best[0] == r:
                        break
                gain, out, wanted = best
                if not gain:
                    break
                got = [take(n) for n in wanted]
                if None in got:
                    for x in got:
                        if x:
                            put(*x)
                    again = any(x is None for x in got)  # a stale size; it is unmarked now
                    continue
                for i, b in got:
                    bins[t].append(i)
                    fill[b] -= lengths[i]
                    fill[t] += lengths[i]
                if out is not None:
                    home = next((b for _, b in got if fill[b] + lengths[out] <= capacity), None)
                    if home is None:  # over capacity for now: what donors hold is packed anew below
                        home = min(donors, key=lambda b: fill[b])
                    bins[t].remove(out)
                    fill[t] -= lengths[out]
                    fill[home] += lengths[out]
                    put(out, home)
                changed = again = True
        left = [i for b in donors for i in sorted(inside[b])]
        gone = set(donors)
        packed = best_fit([lengths[i] for i in left], capacity)
        after = [b for k, b in enumerate(bins) if k not in gone] + [[left[i] for i in b] for b in packed]
        if len(after) >= len(before) or not changed:
            bins = before if len(after) > len(before) else after
            break
        bins = after
    return bins


def _round(rows: DataFrame, n: int, tag: int, capacity: int) -> DataFrame:
    """rows with sequence_id, offset and fill: one pack of each shard."""
    shards = max(1, -(-n // SHARD_PIECES))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        lengths = pdf["length"].tolist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, fill = [np.zeros(len(pdf), np.int64) for _ in range(3)]
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += lengths[i]
            fill[b] = at
        return pdf.assign(sequence_id=(tag << 58) + pdf["shard"].to_numpy(np.int64) * (1 << 20) + sequence, offset=offset, fill=fill).drop(columns="shard")

    spread = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(shard, "doc_id long, piece int, start long, length long, ids_crc32 long, rid long, sequence_id long, offset long, fill long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where cut has them. Ids take no part in the search: they are joined to the places it finds by the number of their row."""
    prepare(cut.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held = cut.withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    rows = held.select(*names, "rid")
    whole = rows.where(F.col("length") >= capacity).select(*names, (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "rid")
    part = rows.where(F.col("length") < capacity)
    first = _round(part, part.count(), 0, capacity).checkpoint()
    open_rows = first.where(F.col("fill") < capacity).drop("sequence_id", "offset", "fill")
    second = _round(open_rows, open_rows.count(), 1, capacity)
    out = [*names, "sequence_id", "offset", "rid"]
    placed = whole.unionByName(first.where(F.col("fill") >= capacity).select(*out)).unionByName(second.select(*out))
    return placed.join(held.select("rid", "ids"), "rid").drop("rid") if "ids" in cut.columns else placed.drop("rid")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(pieces(tokenize(docs, path, id_col, text_col), capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary) of what pack() gives with ids: its pieces in order, at most a capacity of them."""
    one = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return one.select("sequence_id", "length", joined.alias("ids"))
