"""Suffix-array deduplication: removes bytes of strings of LENGTH bytes that start anywhere else too.

1. Anchors. Of every LENGTH-byte window the K-gram with the least hash (the leftmost of equal ones) is its anchor; equal windows
   have equal anchors at equal places. Anchor hashes are counted over all documents (blocks of a task's rows send each hash once).
2. Segments. The bytes of the windows of each anchor that occurs again go to the anchor's unit. Of equal segments of a block one
   question goes there; where a block has several they repeat, and are marked at home. So a unit meets a segment once a block,
   and keeps one place of it. An anchor with more than UNIT occurrences is dealt over several units.
3. In a unit the suffixes at the anchors are sorted: an enhanced suffix array, whose LCP array a stack scan turns into the tree of
   common-prefix intervals, from the longest prefixes up. Where intervals merge, members are looked up among the others by their
   left contexts: those that differ to the left end a maximal repeat there, with the common left context and the interval's
   prefix as its extent. Every occurrence in the interval is met, not only neighbours in the array, and members of the larger part
   are only compared where one of the smaller part lies next to them in left order, as others are covered by longer repeats.
4. Windows of anchors that were dealt over several units meet once more by their 128-bit hashes, one row of a unit and window.
5. Marks are gathered by document, and the bytes left are joined.

Strings are compared as bytes within units. Defined results: a null text equals an empty one; texts under LENGTH bytes keep all; rows that
repeat, with the same id or not, are documents of their own, so their text is removed if LENGTH long; matches never cross
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, prepare, text_or_empty
from corpusloom.llm.ngram_join import _BYTE, _power, mix

LENGTH, K = 200, 32
REACH = LENGTH - K
UNIT = 20_000
SPREAD = 64
#: A block ends at so many anchors, documents, different segments or places of segments.
BLOCK_ANCHORS, BLOCK_ROWS, BLOCK_SEGMENTS, BLOCK_PLACES = 200_000, 50_000, 20_000, 400_000
TEXT_BLOCK = 1 << 19


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    y = np.full(-(-len(x) // width) * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    y[: len(x)] = x
    y = y.reshape(-1, width)
    left, right = np.minimum.accumulate(y, axis=1).ravel(), np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of raw: anchor positions and hashes, and the first and last window start of each."""
    found: list[np.ndarray] = []
    low_bits = np.uint64((1 << 20) - 1)
    for at in range(0, len(raw) - LENGTH + 1, TEXT_BLOCK):
        a = np.frombuffer(raw, np.uint8)[at : at + TEXT_BLOCK + LENGTH - 1]
        up, down = _power(len(a) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)], dtype=np.uint64)])
        h = mix((total[K:] - total[:-K]) * down[: len(total) - K])
        least = sliding_min(h & ~low_bits | np.arange(len(h), dtype=np.uint64), REACH + 1) & low_bits
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        place = least[first].astype(np.int64)
        found.append(np.array([place + at, h[place].view(np.int64), first + at, last + at]))
    if not found:
        return tuple(np.zeros((4, 0), np.int64))
    x = np.concatenate(found, axis=1)
    same = np.flatnonzero(x[0, 1:] == x[0, :-1])  # an anchor on both sides of a block's end
    x[3, same] = x[3, same + 1]
    return tuple(np.delete(x, same + 1, axis=1))


def pack_place(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return place << 16 | (place - first) << 8 | last - first


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def anchored_repeats(lefts: list[bytes], rights: list[bytes], least: int = LENGTH, short: int = K) -> list[list[tuple[int, int]]]:
    """Maximal repeats across the anchors of different segments. lefts: what precedes each anchor, reversed; rights: the suffix from it on.
    By segment: (bytes left of the anchor, bytes from it on) of the repeats of at least `least` bytes that it takes part in."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def merge(a: list[int], b: list[int], prefix: int) -> list[int]:
        """Two parts of an interval with this common prefix; members as ranks of their left contexts, ascending."""
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            i, at = by_left[r], bisect_left(a, r)
            for other in (at - 1, at):
                if 0 <= other < len(a):
                    j = by_left[a[other]]
                    left = common(lefts[i], lefts[j])
                    if left + prefix >= least:
                        out[i].append((left, prefix))
                        out[j].append((left, prefix))
        return sorted(a + b)

    stack: list[tuple[int, list[int]]] = []
    for k in range(n):
        now, node = lcp[k] if k < n - 1 else 0, [rank[order[k]]]
        while stack and stack[-1][0] >= max(now, short):
            prefix, members = stack.pop()
            node = merge(members, node, prefix)
        if now >= short:
            stack.append((now, node))
    return out


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(key, key2, text) to, by document, a number of the row, its bytes, its anchors that stand for their block (hash, packed place, whether the block has no other), and all that the block has several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, places, hashes, count = [], [], [], [], 0
        number = TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            nonlocal keys, sizes, places, hashes, count, number
            owner = np.repeat(np.arange(len(keys)), [len(p) for p in places])
            place, h = np.concatenate(places), np.concatenate(hashes)
            _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            own = np.zeros(len(h), bool)
            own[first] = True
            n = n[inverse]

            def lists(mask: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
                at = np.flatnonzero(mask)
                ends = np.searchsorted(owner[at], np.arange(len(keys) + 1)).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[at], kind))

            out = pa.RecordBatch.from_arrays(
                [pa.array(range(number, number + len(keys)), pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int64()), lists(own, h, pa.int64()), lists(own, place, pa.int64()), lists(own, n == 1, pa.bool_()), lists(n > 1, place, pa.int64()), lists(n > 1, h, pa.int64())],
                names=["row", "key", "key2", "size", "h", "place", "alone", "again", "again_h"],
            )
            number += len(keys)
            keys, sizes, places, hashes, count = [], [], [], [], 0
            return out

        for batch in batches:
            for key, key2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                p, h, first, last = anchors(raw)
                keys.append((key, key2))
                sizes.append(len(raw))
                places.append(pack_place(p, first, last))
                hashes.append(h)
                count += len(p)
                if count >= BLOCK_ANCHORS or len(keys) >= BLOCK_ROWS:
                    yield flush()
        if keys:
            yield flush()

    return docs.mapInArrow(run, "row long, key long, key2 long, size long, h array<long>, place array<long>, alone array<boolean>, again array<long>, again_h array<long>")


#: info: the segment's size and the bytes before its anchor, whether the anchor is dealt out, and how many places there are; places: key, key2 and start of each.
_SEGMENTS = "h long, salt long, info long, segment binary, places binary"


def _info(size: int, before: int, hot: bool, n: int) -> int:
    return n << 32 | hot << 31 | before << 16 | size


def _segments(rows: DataFrame) -> DataFrame:
    """(key, key2, text, flagged) to segments. Of equal segments of a block one question goes to the anchor's unit, with how many there
    are and the first one's place. Where a block has several they repeat, whatever the unit finds: their places go as marks, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes, int], list[tuple[int, int, int]]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal count
            out = []
            for (h, before, segment, units), places in held.items():
                salt = zlib.crc32(segment) % units if units > 1 else 0
                raw = np.array(places, "<i8").tobytes()
                info = _info(len(segment), before, units > 1, len(places))
                out.append((h, salt, info, segment, raw[:24]))
                if len(places) > 1:
                    out.append((places[0][0], -1 - places[0][2] % 64, info, None, raw))
            held.clear()
            count = 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in _SEGMENTS.split(", ")])

        for batch in batches:
            for key, key2, text, flagged in zip(*(batch.column(n).to_pylist() for n in ("key", "key2", "text", "flagged")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in flagged:
                    p = x["p"]
                    before = p >> 8 & 255
                    a = (p >> 16) - before
                    held.setdefault((x["h"], before, raw[a : a + (p & 255) + LENGTH], x["k"]), []).append((key, key2, a))
                    count += 1
                if len(held) >= BLOCK_SEGMENTS or count >= BLOCK_PLACES:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, _SEGMENTS)


_MARKS = "key long, key2 long, a long, b long, x long, y long"


def _marks(segments: DataFrame) -> DataFrame:
    """Segments by unit to (key, key2, a, b) ranges that repeat; of dealt-out units also window hashes (x, y), by key and a. A unit keeps one place of a segment, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: dict[tuple[int, bytes], list] = {}  # (before, segment): first place, and whether there are more
        at, spread, out = None, False, []

        def solve() -> None:
            several = [seen[1] for seen in unit.values()]
            if len(unit) > 1 and not all(several):
                found = anchored_repeats([s[:n][::-1] for n, s in unit], [s[n:] for n, s in unit])
                for ((n, _), seen), whole, parts in zip(unit.items(), several, found, strict=True):
                    if parts and not whole:
                        k, k2, a = seen[0]
                        out.extend((k, k2, a + n - left, a + n + right, None, None) for left, right in set(parts))
            if spread:  # each different window of the unit once, at its first place
                digests = b"".join(hashlib.blake2b(s[o : o + LENGTH], digest_size=16).digest() for _, s in unit for o in range(len(s) - LENGTH + 1))
                pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                same = np.flatnonzero((pairs[order[1:]] == pairs[order[:-1]]).all(1)) + 1
                kept = np.sort(np.delete(order, same))
                first = np.cumsum([0, *(len(s) - LENGTH + 1 for _, s in unit)])
                owner, places = np.searchsorted(first, kept, "right") - 1, [seen[0] for seen in unit.values()]
                for i, j, (x, y) in zip(kept.tolist(), owner.tolist(), pairs[kept].tolist(), strict=True):
                    k, k2, a = places[j]
                    out.append((k, k2, a + i - int(first[j]), None, x, y))
            unit.clear()

        for batch in batches:
            for h, salt, info, segment, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, before, hot, n = info & 0xFFFF, info >> 16 & 0x7FFF, bool(info >> 31 & 1), info >> 32
                places = np.frombuffer(raw, "<i8").reshape(-1, 3).tolist()
                if segment is None:
                    out.extend((k, k2, a, a + size, None, None) for k, k2, a in places)
                    continue
                if at != (h, salt):
                    solve()
                    at, spread = (h, salt), hot
                place = tuple(places[0])
                if (seen := unit.get((before, segment))) is None:
                    unit[before, segment] = [place, n > 1]
                else:  # met twice: the first place, and this one, repeat; several of a block were marked there
                    if not seen[1]:
                        out.append((*seen[0], seen[0][2] + size, None, None))
                        seen[1] = True
                    if n == 1:
                        out.append((*place, place[2] + size, None, None))
                if len(out) >= 20_000:
                    yield _mark_batch(out)
                    out.clear()
        solve()
        yield _mark_batch(out)

    return segments.mapInArrow(run, _MARKS)


def _mark_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=[f.split()[0] for f in _MARKS.split(", ")])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeat_ranges(docs: DataFrame, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """docs has doc_id and text. (doc_id, text, key, key2) rows, and by key and key2, 128 bits of id and text, the ranges (array of a, b) that repeat."""
    prepare(docs.sparkSession)
    own = [F.coalesce("doc_id", F.lit(-1).cast("long")), F.col("doc_id").isNull(), F.col("text")]
    texts = docs.select("doc_id", "text", F.xxhash64(*own).alias("key"), F.xxhash64(F.lit("second"), *own).alias("key2"))
    found = _anchor_rows(texts.select("key", "key2", "text")).checkpoint()
    one = found.select("row", F.explode(F.arrays_zip("h", "place", "alone")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.place").alias("p"), F.col("x.alone").alias("alone"))
    # a hash has a row of each block that has it; the window spills
    met_again = one.withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("blocks > 1 and alone").select("row", F.struct("p", "h").alias("f"))
    again = found.select("row", F.explode(F.arrays_zip("again", "again_h")).alias("x")).select("row", F.struct(F.col("x.again").alias("p"), F.col("x.again_h").alias("h")).alias("f"))
    flags = met_again.unionByName(again).checkpoint()
    hot = flags.groupBy("f.h").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > unit)
    # how many units an anchor is dealt over goes with its places, so that segments move once
    if any_hot := hot.limit(1).count() > 0:
        # a hot anchor's places are spread over SPREAD parts, and its row is copied to each: at most SPREAD rows for every `unit` places
        part = F.pmod(F.xxhash64("row", "f.p"), F.lit(SPREAD)).cast("int")
        hot = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        flags = flags.withColumn("part", part)
        flags = flags.join(hot, (F.col("f.h") == hot.h) & (flags.part == hot.part), "left").select("row", F.struct("f.p", "f.h", F.coalesce(F.ceil(F.col("total") / unit), F.lit(1)).cast("long").alias("k")).alias("f"))
    else:
        flags = flags.select("row", F.struct("f.p", "f.h", F.lit(1).cast("long").alias("k")).alias("f"))
    # rows that repeat with their id have one key, and the places of one of them
    of_key = found.groupBy("key", "key2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("b"))
    flagged = flags.groupBy("row").agg(F.collect_list("f").alias("flagged")).join(of_key.select("key", "key2", "row"), "row").drop("row")
    # doc_id stays, so that this join and that of remove_repeats() use one exchange of texts
    segments = _segments(texts.join(flagged, ["key", "key2"]).select("doc_id", "key", "key2", "text", "flagged"))
    marks = _marks(segments.repartition("h", "salt").sortWithinPartitions("h", "salt"))
    # no checkpoint of marks: it would part the two joins of texts, which then couldn't use one exchange
    ranges = marks.where("b is not null").select("key", "key2", "a", "b")
    if any_hot:
        # a window has one row of each unit that has it
        across, place = Window.partitionBy("x", "y"), F.struct("key", "key2", "a")
        met = marks.where("x is not null").withColumn("low", F.min(place).over(across)).withColumn("high", F.max(place).over(across)).where("low != high")
        ranges = ranges.unionByName(met.select("key", "key2", "a", (F.col("a") + LENGTH).alias("b")))
    whole = of_key.where((F.col("rows") > 1) & (F.col("b") >= LENGTH)).select("key", "key2", F.lit(0).cast("long").alias("a"), "b")
    ranges = ranges.unionByName(whole).groupBy("key", "key2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    return texts, ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    texts, ranges = repeat_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), unit)

    def per_batch(batch):
        kept, removed, spans, size = [], [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            cut = merged([(x["a"], x["b"]) for x in found or ()])
            kept.append(b"".join([raw[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(raw)], strict=True)]))
            removed.append(len(raw) - len(kept[-1]))
            spans.append(len(cut))
            size.append(len(raw))
        return {"doc_id": batch.column(0), "n_bytes": size, "n_removed": removed, "n_spans": spans, "kept": kept}

    return map_batches(texts.join(ranges, ["key", "key2"], "left").select("doc_id", "text", "ranges"), per_batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    return remove_repeats(docs, id_col, text_col, unit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
