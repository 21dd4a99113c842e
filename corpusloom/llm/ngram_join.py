"""N-gram Jaccard join by T-occurrence search (DivideSkip), in blocks of documents that share rare grams.

A document's set is its distinct word n-grams, as 64-bit hashes. Documents of equal sets are one class, found by a key of the
set; the join is between classes.

1. Rare grams. Grams have one order: by the power of two of the number of documents (classes of a chunk) with them, then by
   hash. Two sets that link share a gram among the n - ceil(percent * n / 100) + 1 first ones of either, so these are a set's
   index keys, less those that no other set has. Passages that many documents share come last in the order, and are keys of a
   set only where little else is in it. Numbers of documents come from one exchange: chunks of about CHUNK_GRAMS grams send
   48-bit prints of them by ranges of the print, each once with the number and places of its owners in the chunk, and get back
   what others have too. A range's prints are unpacked and counted in slices.
   Equal prints of different grams only add candidates, as prints are what is counted and ordered. A chunk keeps one row of a
   key and links the others to it, so that no key has more rows than there are chunks.
2. Candidate blocks are the connected components of rows that share a key: no link goes between blocks. Every set goes to
   its block once.
3. In a block, documents are queries one by one. Lists of the documents so far that lead a cluster are searched for those with
   the required overlap: the short lists are heap-merged with skips, the long ones probed by binary search, and where the lists
   are long the short ones are tallied and the long ones looked up in rows of flags, with the same result. A document that
   links to a leader joins its cluster. By the triangle inequality of the Jaccard distance, links to members of other clusters
   are only possible where the leader is within twice the distance, and are tested there, unless both are connected already.
   So all components come out exactly without testing all pairs of a group of near copies. At 50 percent or less twice the
   distance bounds nothing: every document leads then.
4. Blocks over UNIT documents are cut into units. Then one leader of each component meets the others, in up to ROUNDS rounds of units
   by other orders of grams while there are more leaders than fit in one; pairs of units are searched only in a block that has more
   than one component after that.

Sets are told apart by their key, never by doc_id: ids may be null or repeat. Sets of classes whose ids are all null are made
again from the rows without an id. A component's smallest id is taken at the end.

Defined results: null and empty texts, and texts without words, have an empty set and link with nothing; a text of fewer words
than n is one gram; rows that repeat are of one class; a null id never is a component's smallest id unless all are null; an
empty table gives an empty result; other columns are not read. Two different sets count as one with a chance of 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, id_and_text, prepare

#: Documents of a unit; two units meet in a task, whose time grows with the square of their documents.
UNIT = 2500
#: Short lists of more entries than this are merged by sorting or tallied, and the long ones probed for all candidates at once; the result is the heap's.
SORT_MERGE = 4096
#: Bytes of a unit's flags of leaders by long list, and members of clusters that are tested against a query at once.
TABLE_BYTES, MEMBERS = 64_000_000, 256
#: DivideSkip's factor for the share of lists that are probed.
LONG_FACTOR = 0.01
#: A chunk of documents whose grams are counted together; its documents are under 2**16. With more ranges than LEAST_RANGES it has as many times the grams, MOST_CHUNK_GRAMS at most: the rows of chunks and ranges keep their size, and their number does not grow with the square of the input.
CHUNK_GRAMS, MOST_CHUNK_GRAMS, CHUNK_ROWS = 500_000, 4_000_000, 20_000
#: Bits of a gram's print, and bytes of text for which there is a range of prints. Over MOST_RANGES, ranges grow with the input; their prints are counted in slices of about SLICE.
PRINT_BITS, RANGE_BYTES, LEAST_RANGES, MOST_RANGES, SLICE = 48, 8_000_000, 256, 1 << 20, 4_000_000
#: Rounds in which the leaders of a large block meet, in units by other orders of grams.
ROUNDS = 3
#: Rows of (id, key, block, size) that are broadcast at most, about 20 MB; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text whose words are hashed at once, and bytes of a word from which on it is hashed alone.
TEXT_BLOCK, LONG_WORD = 1 << 16, 256

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_IS_SPACE = bytes(x in b"\t\n\v\f\r " for x in range(256))
#: By number of bytes, which of eight count.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = _RNG.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
_weights = [_RNG.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = _powers[i]
            _powers[i] = np.concatenate([x, x * np.uint64(pow(int(base), len(x), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def _weight(n: int) -> np.ndarray:
    """Odd factors of the n words of a gram."""
    while len(_weights[0]) < n:
        _weights[0] = np.concatenate([_weights[0], _RNG.integers(0, 1 << 64, len(_weights[0]), np.uint64) | np.uint64(1)])
    return _weights[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw, in order, and where each begins."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        end = len(raw) if at + TEXT_BLOCK >= len(raw) or not (space := _SPACE.search(raw, at + TEXT_BLOCK)) else space.start()
        part = b"%b%b%b" % (b" ", raw[at:end], b" " * 8)
        space = np.frombuffer(part.translate(_IS_SPACE), np.uint8)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, length = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,))  # the bytes from each place on
        h = mix((eight[start] & _FIRST[np.minimum(length, 8)]) * _ODD[0] + length.astype(np.uint64))
        more, k = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
        while len(more):
            h[more] = mix(h[more] * _ODD[1] + (eight[start[more] + k] & _FIRST[np.minimum(length[more] - k, 8)]))
            k += 8
            more = more[length[more] > k]
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(part[start[i] : start[i] + length[i]], digest_size=8).digest(), "little")
        hashes.append(h)
        starts.append(start + (at - 1))
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(raw: bytes) -> np.ndarray:
    """Of the words of raw, lower-cased A-Z, in order."""
    return _words(raw.lower())[0]


def gram_sets(texts: Iterable[str], n: int) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its word n-grams, ascending. Short texts are hashed together, TEXT_BLOCK bytes at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= TEXT_BLOCK:
            yield from _gram_sets(held, n)
            held, size = [], 0
    if held:
        yield from _gram_sets(held, n)


def _gram_sets(raws: list[bytes], n: int) -> Iterator[np.ndarray]:
    w, start = _words(b" ".join(raws).lower())
    ends = np.cumsum([len(x) + 1 for x in raws])
    words = [0, *np.searchsorted(start, ends).tolist()]
    weight = _weight(n)
    grams = np.full(max(0, len(w) - n + 1), n, np.uint64)
    if len(grams):
        for i in range(n):
            grams += w[i : len(w) - n + 1 + i] * weight[i]
        grams = mix(grams)
    for a, b in itertools.pairwise(words):
        if b - a >= n:
            out = np.sort(grams[a : b - n + 1])
            new = np.empty(len(out), bool)
            new[0] = True
            np.not_equal(out[1:], out[:-1], out=new[1:])
            yield out if new.all() else out[new]
        elif a < b:  # fewer words than n are one gram
            yield mix((w[a:b] * weight[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def gram_set(text: str, n: int) -> np.ndarray:
    """Distinct hashes of the word n-grams, ascending."""
    return next(gram_sets([text], n))


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two numbers."""
    return struct.unpack("<qq", hashlib.blake2b(grams.astype("<u8", copy=False), digest_size=16).digest())


def least_hashes(grams: np.ndarray) -> list[int]:
    """The smallest gram under each of ROUNDS orders, by which units of leaders are made."""
    return [int(mix(grams ^ np.uint64(seed)).min() >> np.uint64(1)) for seed in range(1, ROUNDS + 1)]


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if self.words < 1 or not 1 <= self.percent <= 100:
            raise ValueError(f"words of at least 1 and a percent of 1 to 100 are needed, not {self.words} and {self.percent}")

    @property
    def wide(self) -> int:
        """The least percent of a leader whose cluster may have a member that links; at 50 or less no clusters are made."""
        return 2 * self.percent - 100 if self.percent > 50 else self.percent

    def prefix(self, size: int) -> int:
        """So many first grams of a set, in any order of all grams, share one with every set that links."""
        return size - -(-self.percent * size // 100) + 1


def pack(prints: np.ndarray) -> bytes:
    """Ascending prints as byte planes of their differences."""
    step = np.diff(prints, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return prints[:1].tobytes() + bytes([width]) + step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    first, width = np.frombuffer(raw, "<u8", 1), raw[8]
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, step.reshape(-1).view("<u8")]), dtype=np.uint64)


def divide_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(member, number of lists with it) for the members of at least need of the ascending lists."""
    if need <= 0 or len(lists) < need:
        return []
    lists = sorted(lists, key=len)
    n_long = min(need - 1, int(need / (LONG_FACTOR * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least, out = need - n_long, []
    if sum(map(len, short)) > SORT_MERGE:
        values, count = np.unique(np.concatenate([np.array(x) for x in short]), return_counts=True)
        values, count = values[count >= least], count[count >= least]
        for x in long:
            x = np.array(x)
            count += x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
        return list(zip(values[count >= need].tolist(), count[count >= need].tolist(), strict=True))
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, count, popped = heap[0][0], 0, []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
            count += 1
        if count >= least:
            for left, x in zip(range(n_long, 0, -1), long, strict=True):
                if count + left < need:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= need:
                out.append((top, count))
            target = top + 1
        else:  # no member below the next possible one can be in enough lists
            while len(popped) < least - 1 and heap:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(top + 1, heap[0][0])
        for _, i, at in popped:
            if (at := bisect_left(short[i], target, at)) < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    return out


class Unit:
    """Documents of a block, one after the other, with the components of those so far.

    All sets are given first, so that the inverted lists are slices of one array, and only of grams that two documents of the
    unit share: a gram of one document is in no overlap. Lists that get long have a row of flags by leader besides, as many as
    TABLE_BYTES holds. A query of over SORT_MERGE entries is DivideSkip by arrays: the short lists are tallied, and the long ones
    looked up for the members that may have enough."""

    def __init__(self, rule: Rule, sets: list[np.ndarray]) -> None:
        self.rule, self.sets, self.sizes = rule, sets, np.array([len(x) for x in sets], np.int64)
        self.root = np.arange(len(sets), dtype=np.int32)  # the first position of the component
        grams, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        self.shared, count = grams[count > 1], count[count > 1]
        self.start = np.cumsum(count) - count
        self.end = self.start.copy()  # of the entries so far
        self.entries = np.empty(int(count.sum()), np.int32)
        self.own: list[np.ndarray] = []  # by position: where the lists of the shared grams are
        self.leaders = np.empty(len(sets), np.int32)
        self.n_leaders = 0
        # members of clusters in the order they came: position, leader's number, distance
        self.member, self.member_of, self.member_far, self.n_members = np.empty(len(sets), np.int32), np.empty(len(sets), np.int32), np.empty(len(sets)), 0
        flagged = np.flatnonzero(count >= max(32, len(sets) // 16))
        flagged = flagged[np.argsort(-count[flagged], kind="stable")][: TABLE_BYTES // max(1, len(sets))]
        self.row = np.full(len(count), -1, np.int32)
        self.row[flagged] = np.arange(len(flagged))
        self.table = np.zeros((len(flagged), len(sets)), np.uint8)

    def find(self, i: int) -> int:
        return int(self.root[i])

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)

    def union_all(self, q: int, others: np.ndarray) -> None:
        while len(others := others[self.root[others] != self.root[q]]):
            self.union(q, int(others[0]))

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where the lists of the shared ones among grams are."""
        at = np.searchsorted(self.shared, grams)
        at, grams = at[at < len(self.shared)], grams[at < len(self.shared)]
        return at[self.shared[at] == grams]

    def tally(self, lists: np.ndarray) -> np.ndarray:
        """By leader, the number of lists with it."""
        rows = self.row[lists]
        plain = lists[rows < 0]
        rows = rows[rows >= 0]
        parts = [self.entries[a:b] for a, b in zip(self.start[plain].tolist(), self.end[plain].tolist(), strict=True)]
        out = np.bincount(np.concatenate([*parts, np.zeros(0, np.int32)]), minlength=self.n_leaders)
        for i in range(0, len(rows), 255):
            out += np.add.reduce(self.table[rows[i : i + 255], : self.n_leaders], axis=0, dtype=np.uint8)
        return out

    def look_up(self, lists: np.ndarray, found: np.ndarray) -> np.ndarray:
        """By leader of found, the number of lists with it."""
        if 16 * len(found) >= self.n_leaders:
            return self.tally(lists)[found]
        rows = self.row[lists]
        out = self.tally(lists[rows < 0])[found]
        rows = rows[rows >= 0]
        for i in range(0, len(rows), 255):
            out += np.add.reduce(self.table[rows[i : i + 255, None], found], axis=0, dtype=np.uint8)
        return out

    def search(self, own: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaders in at least need of the lists of own, ascending, and the numbers of lists with them."""
        length = self.end[own] - self.start[own]
        own, length = own[length > 0], length[length > 0]
        if int(length.sum()) <= SORT_MERGE:
            found = divide_skip([self.entries[a:b].tolist() for a, b in zip(self.start[own].tolist(), self.end[own].tolist(), strict=True)], need)
            both = np.array(found, np.int64).reshape(-1, 2)
            return both[:, 0], both[:, 1]
        if need <= 0 or len(own) < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = own[np.argsort(length, kind="stable")]
        n_long = min(need - 1, int(need / (LONG_FACTOR * math.log2(int(length.max()) + 1) + 1)))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        count = self.tally(short)
        found = np.flatnonzero(count >= need - n_long)
        count = count[found]
        if len(found) and n_long:
            count = count + self.look_up(long, found)
        return found[count >= need], count[count >= need]

    def add(self, q: int) -> bool:
        """Adds the document at position q, the one after the last; whether it leads a cluster now."""
        percent, wide = self.rule.percent, self.rule.wide
        size, own = len(self.sets[q]), self.places(self.sets[q])
        self.own.append(own.astype(np.int32))
        ranks, both = self.search(own, -(-wide * size // 100))
        either = size + self.sizes[self.leaders[ranks]] - both
        links = 100 * both >= percent * either
        self.union_all(q, self.leaders[ranks[links]])
        near = ~links & (100 * both >= wide * either) & (self.root[self.leaders[ranks]] != self.root[q])
        if near.any() and self.n_members:
            far = np.full(self.n_leaders, np.inf)
            far[ranks[near]] = 1 - both[near] / either[near]
            n = self.n_members
            self.link_members(q, self.member[:n][self.member_far[:n] + (100 - percent) / 100 + 1e-9 >= far[self.member_of[:n]]])
        if links.any() and percent > 50:
            alike = both[links] / either[links]
            best = int(alike.argmax())
            n, self.n_members = self.n_members, self.n_members + 1
            self.member[n], self.member_of[n], self.member_far[n] = q, ranks[links][best], 1 - alike[best]
            return False
        self.entries[self.end[own]] = self.n_leaders
        self.end[own] += 1
        rows = self.row[own]
        self.table[rows[rows >= 0], self.n_leaders] = 1
        self.leaders[self.n_leaders] = q
        self.n_leaders += 1
        return True

    def link_members(self, q: int, members: np.ndarray) -> None:
        """Joins q with those of members that it links to, unless both are connected already."""
        has = np.zeros(len(self.shared), bool)
        has[self.own[q]] = True
        for at in range(0, len(members), MEMBERS):
            some = members[at : at + MEMBERS]
            some = some[self.root[some] != self.root[q]]
            if not len(some):
                continue
            parts = [self.own[i] for i in some.tolist()]  # none is empty: each shares grams with its leader
            ends = np.cumsum([len(x) for x in parts])
            both = np.add.reduceat(has[np.concatenate(parts)], np.concatenate([[0], ends[:-1]]), dtype=np.int64)
            self.union_all(q, some[100 * both >= self.rule.percent * (len(self.sets[q]) + self.sizes[some] - both)])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for the nodes of edges (a, b); large and small stars by turns."""
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        # large star: what is larger than a node goes to the smallest of the node's neighbourhood; a hub is no key of the grouping, as it has no smaller neighbour
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = both.join(least, both.b == least.u, "left").select("a", F.coalesce("m", "b").alias("b"))
        # small star: a node's smaller neighbours, which are few, and the node itself go to the smallest of them
        least_of = large.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        both = least_of.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct().checkpoint()
        now = tuple(both.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return both.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


_CHUNK = "chunk long, mark long, ids array<long>, sizes array<long>, keys array<long>, keys2 array<long>, prints binary, counts binary, owners binary"
_LONGS = pa.list_(pa.int64())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": _LONGS}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def _spread(n: int) -> int:
    """n, mixed: numbers in a row go to ranges all over."""
    return int(mix(np.array([n], np.uint64))[0])


def _chunks(rows: DataFrame, rule: Rule, bits: int, chunk_grams: int) -> DataFrame:
    """Chunks of documents: a row with ids, sizes and keys, and for each range of prints a row with the chunk's different prints, the
    number of its sets with each, and these sets' places, print by print."""
    schema = f"span long, {_CHUNK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId(), 0
        ids, sizes, keys, sets, owner, seen, count = [], [], [], [], [], set(), 0

        def flush() -> pa.RecordBatch:
            # one number of print and owner, as numbers are sorted faster than places
            both = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - PRINT_BITS) << np.uint64(16) | np.repeat(np.array(owner, np.uint64), [len(x) for x in sets])
            both.sort()
            prints, owners = both >> np.uint64(16), both.astype(np.uint16)
            first = np.flatnonzero(np.diff(prints, prepend=~prints[:1]))
            ends = np.concatenate([first, [len(owners)]])
            different, counts = prints[first], np.diff(ends)
            chunk, mark = place << 32 | number, int.from_bytes(hashlib.blake2b(repr((ids, keys)).encode(), digest_size=8).digest(), "little", signed=True)
            cut = np.searchsorted(different, np.arange(1 << bits, dtype=np.uint64) << np.uint64(PRINT_BITS - bits))
            out = [(_spread(chunk) % (1 << bits), chunk, mark, ids, sizes, [k[0] for k in keys], [k[1] for k in keys], None, None, None)]
            out += [(i, chunk, mark, None, None, None, None, pack(different[a:b]), counts[a:b].astype("<u2").tobytes(), owners[ends[a] : ends[b]].tobytes()) for i, (a, b) in enumerate(itertools.pairwise([*cut.tolist(), len(different)])) if a < b]
            return _batch(out, schema)

        for batch in batches:
            for doc, grams in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1).to_pylist(), rule.words), strict=True):
                key = set_key(grams)
                if len(grams) and key not in seen:
                    seen.add(key)
                    sets.append(grams)
                    owner.append(len(ids))
                    count += len(grams)
                ids.append(doc)
                sizes.append(len(grams))
                keys.append(key)
                if count >= chunk_grams or len(ids) >= CHUNK_ROWS:
                    yield flush()
                    number += 1
                    ids, sizes, keys, sets, owner, seen, count = [], [], [], [], [], set(), 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, schema)


def _numbered(values: np.ndarray) -> np.ndarray:
    """For each value, the number of smaller different ones."""
    bits = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + bits > 64:
        return np.unique(values, return_inverse=True)[1]
    both = np.sort(values << np.uint64(bits) | np.arange(len(values), dtype=np.uint64))  # value and place: numbers are sorted faster than places
    values, place = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    out = np.empty(len(values), np.int64)
    out[place] = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    return out


def _shared_prints(chunks: DataFrame) -> DataFrame:
    """By range of prints, those that occur twice or more, each with its level (the power of two of its number) above the print: an order of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            # packed rows are held; a slice of the range at a time is unpacked into one array
            n = sum(len(r[3]) // 2 for r in held)
            low, high = span_bounds(held)
            slices = -(-n // SLICE)
            step = max(1, -(-(high - low + 1) // slices))
            for edge in range(low, high + 1, step):
                yield from count(edge, edge + step)
            held.clear()

        def span_bounds(rows: list[tuple]) -> tuple[int, int]:
            ends = [unpack(r[2])[[0, -1]] for r in rows]
            return min(int(e[0]) for e in ends), max(int(e[1]) for e in ends)

        def count(low: int, high: int) -> Iterator[pa.RecordBatch]:
            parts = []
            for chunk, mark, prints, counts, owners in held:
                x, c = unpack(prints), np.frombuffer(counts, "<u2").astype(np.int64)
                a, b = np.searchsorted(x, np.array([low, high], np.uint64))
                if a < b:
                    start = int(c[:a].sum())
                    parts.append((chunk, mark, x[a:b], c[a:b], np.frombuffer(owners, np.uint16)[start : start + int(c[a:b].sum())]))
            if not parts:
                return
            inverse = _numbered(np.concatenate([p[2] for p in parts]) - np.uint64(low))
            total = np.bincount(inverse, weights=np.concatenate([p[3] for p in parts]))
            level, out, at = (np.frexp(total)[1] - 1).astype(np.uint64)[inverse], [], 0
            for chunk, mark, x, c, owners in parts:
                own = level[at : at + len(x)]
                at += len(x)
                if (own > 0).any():
                    every = np.repeat(own << np.uint64(PRINT_BITS) | x, c)
                    pick = np.repeat(own > 0, c)
                    out.append((chunk, mark, None, None, None, None, every[pick].tobytes(), None, owners[pick].tobytes()))
            if out:
                yield _batch(out, _CHUNK)

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("span", "chunk", "mark", "ids", "sizes", "keys", "keys2", "prints", "counts", "owners")), strict=True):
                if row[3] is not None:
                    yield _batch([row[1:]], _CHUNK)
                    continue
                if row[0] != span and held:
                    yield from close()
                span = row[0]
                held.append((row[1], row[2], row[7], row[8], row[9]))
        if held:
            yield from close()

    return chunks.repartition("span").sortWithinPartitions("span").mapInArrow(run, _CHUNK)


def _layout(size: int) -> tuple[int, int]:
    """For bytes of text: the power of two of the ranges of prints, and grams in a chunk."""
    bits = max(LEAST_RANGES, min(MOST_RANGES, size // RANGE_BYTES)).bit_length() - 1
    return bits, max(CHUNK_GRAMS, min(MOST_CHUNK_GRAMS, (CHUNK_GRAMS << bits) // LEAST_RANGES))


def _profiles(rows: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, key, index keys kept by this row, keys of sets that it shares others with."""
    schema = "doc_id long, n long, key long, key2 long, kept array<long>, links array<struct<key: bigint, key2: bigint>>"
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, chunk_grams = _layout(size)
    pair = pa.struct([("key", pa.int64()), ("key2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def close() -> pa.RecordBatch:
            info = [r for r in held if r[1] is not None]
            if len(info) != 1 or len({r[0] for r in held}) != 1:
                raise RuntimeError("a chunk was read again with other rows: the input has to be a stable one, as files or a checkpoint are")
            _, ids, sizes, first_keys, second_keys, _, _ = info[0]
            keys = list(zip(first_keys, second_keys, strict=True))
            grams = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[5], "<u8") for r in held if r[1] is None)])
            owner = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r[6], np.uint16) for r in held if r[1] is None)]).astype(np.int64)
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            n_shared = np.bincount(owner, minlength=len(ids))
            start = np.cumsum(n_shared) - n_shared
            # a set's grams without a second owner come first in the order
            wanted = np.array([rule.prefix(n) for n in sizes]) - (np.array(sizes) - n_shared)
            pick = np.arange(len(grams)) - start[owner] < wanted[owner]
            grams, owner = grams[pick], owner[pick]
            _, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
            own = np.zeros(len(grams), bool)
            own[first] = True
            links = [[] for _ in ids]
            for i, j in set(zip(owner[~own].tolist(), owner[first[inverse[~own]]].tolist(), strict=True)):
                if keys[i] != keys[j]:
                    links[i].append(keys[j])
            at = np.flatnonzero(own)
            split = np.searchsorted(owner[at], np.arange(len(ids) + 1))
            values = grams.view(np.int64)
            held.clear()
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(first_keys, pa.int64()), pa.array(second_keys, pa.int64()), pa.array([values[at[split[i] : split[i + 1]]] for i in range(len(ids))], _LONGS), pa.array([[{"key": a, "key2": b} for a, b in x] for x in links], pa.list_(pair))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "key2", "kept", "links"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("chunk", "mark", "ids", "sizes", "keys", "keys2", "prints", "owners")), strict=True):
                if row[0] != chunk and held:
                    yield close()
                chunk = row[0]
                held.append(row[1:])
        if held:
            yield close()

    return _shared_prints(_chunks(rows, rule, bits, chunk_grams)).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


#: Sets that share one half of their key are told apart by another number; more of them than this are no accident.
MOST_TWINS = 10_000


def _one_key(profiles: DataFrame) -> tuple[DataFrame, list[int]]:
    """profiles with one number for a set, in key and links: the first half of its 128-bit key, or, where different sets share that, a hash of both halves. The shared halves, which 10**10 sets have about three of, come to the driver."""
    halves = profiles.where("n > 0").groupBy("key").agg(F.min("key2").alias("low"), F.max("key2").alias("high"))
    twins = sorted(r.key for r in halves.where("low != high").select("key").limit(MOST_TWINS + 1).collect())
    if len(twins) > MOST_TWINS:
        raise RuntimeError("too many sets share half of a key")
    whole = lambda k, k2: F.when(k.isin(twins), F.xxhash64(k, k2)).otherwise(k) if twins else k
    named = profiles.withColumns({"key": whole(F.col("key"), F.col("key2")), "links": F.transform("links", lambda x: whole(x["key"], x["key2"]))})
    return named.drop("key2"), twins


def _search(sets: DataFrame, rule: Rule) -> DataFrame:
    """(block, unit, key, doc_id, grams, label) by unit to (block, key, doc_id, leads, root): root is the smallest key of the component within the unit; rows that share a label are connected before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, sets, labels, out = None, [], [], [], []

        def close() -> None:
            unit, first, leads = Unit(rule, sets), {}, []
            for i, label in enumerate(labels):
                leads.append(unit.add(i))
                if label is not None:
                    unit.union(first.setdefault(label, i), i)
            low: dict[int, int] = {}
            for i, r in enumerate(rows):
                root = unit.find(i)
                low[root] = min(low.get(root, r[1]), r[1])
            out.extend((*r, leads[i], low[unit.find(i)]) for i, r in enumerate(rows))
            for x in (rows, sets, labels):
                x.clear()

        for batch in batches:
            for block, number, key, doc, grams, label in zip(*(batch.column(n).to_pylist() for n in ("block", "unit", "key", "doc_id", "grams", "label")), strict=True):
                if at != (block, number):
                    close()
                    at = block, number
                if rows and rows[-1][1] == key:
                    continue
                rows.append((block, key, doc))
                sets.append(np.frombuffer(grams, "<u8"))
                labels.append(label)
            if len(out) >= 10_000:
                yield _found(out)
                out.clear()
        close()
        yield _found(out)

    ordered = sets.repartition("block", "unit").sortWithinPartitions("block", "unit", "n", "key")
    return ordered.mapInArrow(run, "block long, key long, doc_id long, leads boolean, root long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "key", "doc_id", "leads", "root"])


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where it has at most BROADCAST_ROWS narrow rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _sets(rows: DataFrame, wanted: DataFrame, rule: Rule, twins: list[int]) -> DataFrame:
    """The sets of wanted (doc_id, key, block, size): block, size, key, doc_id, n, grams, low (its smallest gram), lows (by other orders)."""
    parts = {"block": pa.int64(), "size": pa.int64(), "key": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "grams": pa.binary(), "low": pa.int64(), "lows": _LONGS, "k1": pa.int64(), "k2": pa.int64()}
    schema = "block long, size long, key long, doc_id long, n long, grams binary, low long, lows array<long>, k1 long, k2 long"
    own = F.when(F.col("k1").isin(twins), F.xxhash64("k1", "k2")).otherwise(F.col("k1")) if twins else F.col("k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("doc_id", "text", "key", "block", "size")}
            grams = list(gram_sets(c["text"], rule.words))
            keys = [set_key(g) for g in grams]
            # without twins a set of another key goes here, so that it isn't sent
            good = [i for i, g in enumerate(grams) if len(g) and (twins or keys[i][0] == c["key"][i])]
            columns = {n: [c[n][i] for i in good] for n in ("block", "size", "key", "doc_id")}
            columns |= {"n": [len(grams[i]) for i in good], "grams": [grams[i].tobytes() for i in good], "low": [int(grams[i][0] >> np.uint64(1)) for i in good], "lows": [least_hashes(grams[i]) for i in good], "k1": [keys[i][0] for i in good], "k2": [keys[i][1] for i in good]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in parts.items()], names=list(parts))

    made = lambda df: df.mapInArrow(run, schema).where(own == F.col("key")).drop("k1", "k2")
    found = made(rows.join(small(wanted), "doc_id"))
    unnamed = wanted.where("doc_id is null")
    if not unnamed.limit(1).count():
        return found

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            both = [set_key(g) for g in gram_sets(texts.to_pylist(), rule.words)]
            yield pa.RecordBatch.from_arrays([texts, pa.array([k[0] for k in both], pa.int64()), pa.array([k[1] for k in both], pa.int64())], names=["text", "k1", "k2"])

    # a null id joins nothing: these rows are found by the key of their set
    texts = rows.where("doc_id is null").distinct().mapInArrow(keys, "text string, k1 long, k2 long").select("text", own.alias("key")).join(small(unnamed.drop("doc_id")), "key")
    return found.unionByName(made(texts.dropDuplicates(["key"]).withColumn("doc_id", F.lit(None).cast("long"))))


def _in_units(rows: DataFrame, order: str, unit: int) -> DataFrame:
    """(key, unit) of rows (block, key, order): units of at most unit sets of a block, next to each other by order, numbered from 0. Ranges of the values would not do: the smallest of a set's many hashes is near 0, and all of a family share it."""
    place = F.row_number().over(Window.partitionBy("block").orderBy(order, "key")) - 1
    return rows.distinct().select("key", F.floor(place / unit).cast("long").alias("unit"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size (rows of equal sets)."""
    prepare(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    profiles, twins = _one_key(_profiles(rows, rule).checkpoint())
    classes = profiles.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    signed = profiles.select("key", F.explode("kept").alias("s"))
    paired = signed.select("key", F.min("key").over(Window.partitionBy("s")).alias("m")).where("key != m").select(F.col("key").alias("a"), F.col("m").alias("b"))
    edges = paired.unionByName(profiles.select(F.col("key").alias("a"), F.explode("links").alias("b")))
    blocks = components(edges)
    sizes = blocks.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    wanted = blocks.join(sizes, "label").join(classes, blocks.node == classes.key).select(F.col("rep").alias("doc_id"), "key", F.col("label").alias("block"), "size").checkpoint()
    sets = _sets(rows, wanted, rule, twins)
    large = sizes.where(F.col("size") > unit).limit(1).count() > 0
    if large:  # each of the rounds reads them again, which would make them from all texts
        sets = sets.checkpoint()
        # the units of a large block are cut in the order of the smallest gram, which near copies mostly share
        units = _in_units(sets.where(F.col("size") > unit).select("block", "key", "low"), "low", unit)
        sets = sets.join(small(units), "key", "left").withColumn("unit", F.coalesce("unit", F.lit(0).cast("long")))
    else:
        sets = sets.withColumn("unit", F.lit(0).cast("long"))
    found = _search(sets.withColumn("label", F.lit(None).cast("long")), rule).checkpoint()
    links = found.select(F.col("key").alias("a"), F.col("root").alias("b"))
    if large:
        joined = components(_across(rows, wanted, found, sets, links, rule, unit))
    else:  # units are whole blocks
        joined = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # from keys to ids: the smallest of a component that isn't null
    least = joined.join(wanted.select(F.col("key").alias("node"), "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("least"))
    named = joined.join(least, "label").select("node", "least")
    low = classes.join(named, classes.key == named.node, "left").select(F.col("key").alias("k"), F.coalesce("least", "rep").alias("component_id"), "class_size")
    own = profiles.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"))
    return own.join(low, own.key == low.k, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _across(rows: DataFrame, wanted: DataFrame, found: DataFrame, sets: DataFrame, links: DataFrame, rule: Rule, unit: int) -> DataFrame:
    """Links between the units of large blocks: among leaders first, in rounds; then, where a block still has several components, between all pairs of its units."""
    big = sets.where(F.col("size") > unit)
    none = F.lit(None).cast("long")
    label = found.select("key", "block", "leads", F.col("root").alias("label"))
    for k in range(ROUNDS):
        # one leader of each component so far; a block's are cut into units by the smallest gram in another order each round
        one = label.where("leads").groupBy("block", "label").agg(F.min("key").alias("key"))
        held = one.join(one.groupBy("block").agg(F.count(F.lit(1)).alias("leaders")).where("leaders > 1"), "block").select("key", "leaders").checkpoint()
        if not held.limit(1).count():
            break
        units = _in_units(big.join(held, "key").select("block", "key", F.get("lows", F.lit(k)).alias("low")), "low", unit)
        met = _search(big.drop("unit").join(units, "key").select("block", "unit", "key", "doc_id", "n", "grams", none.alias("label")), rule)
        links = links.unionByName(met.select(F.col("key").alias("a"), F.col("root").alias("b"))).checkpoint()
        labels = components(links)
        label = found.join(labels, found.key == labels.node, "left").select("key", "block", "leads", F.coalesce("label", "key").alias("label")).checkpoint()
        if held.where(F.col("leaders") > unit).limit(1).count() == 0:
            break  # all leaders of every block have met
    member = label.select("key", "block", "label")
    several = member.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("block")
    rest = big.join(several, "block", "left_semi").join(member.select("key", "label"), "key")
    n = F.ceil(F.col("size") / unit).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.when(j == F.col("unit"), F.lit(None).cast("long")).otherwise(F.least(j, F.col("unit")) * n + F.greatest(j, F.col("unit"))))
    spread = rest.withColumn("unit", F.explode(pairs)).where("unit is not null").select("block", "unit", "key", "doc_id", "n", "grams", "label")
    more = _search(spread, rule)
    return links.unionByName(more.select(F.col("key").alias("a"), F.col("root").alias("b")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of docs with the smallest id of their component, and rows with a null id. Whole copies are left to exact deduplication: rows of the id that stays all stay."""
    found = jaccard_components(docs, id_col, text_col, rule).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.expr("doc_id <=> component_id")).alias("stays"))
    name = free_name(docs, "_gone_id")
    gone = found.where("not stays").select(F.col("doc_id").alias(name)).checkpoint()
    return docs.join(small(gone), docs[id_col].cast("long") == F.col(name), "left_anti")
