"""SentencePiece N-best segmentation and decoding.

The lattice of a text has an edge for every vocabulary piece that matches (and byte pieces for a character that is none).
Forward Viterbi scores are the exact heuristics of a backward A* search from the end: the priority of a partial path is the
score of what it has plus the best score of what is before it, so complete paths come out best first.

No piece crosses certain pairs of neighbouring characters (those inside no piece of the vocabulary, such as a letter and a
following space mark); the lattice falls into parts there. Parts are solved once and kept. A text's best segmentation is its
parts' best ones; its N best differ from it in at most N-1 parts, those where a second choice costs least, and only those
parts are searched by A*.

Score of a piece: -ln(rank + 2), its rank being the negated stored score; a byte piece scores less than any other.

Defined results: null and empty texts have one segmentation, of no piece; of segmentations that score the same the best one has, from
the end, the piece that starts first, and further ones follow in the order of the search, which depends on the text only; equal texts give equal
rows; very long texts are segmented whole; an empty table gives an empty result; other columns are not read. Decoding gives back every text exactly, as this model's
normalisation only marks spaces; a text with the space mark itself (U+2581) decodes to spaces there.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.common import id_and_text, map_batches

MARK = "▁"
N_BEST = 4
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(m[1], 16): i for i, p in enumerate(self.pieces) if (m := _BYTE.fullmatch(p)) and sp.is_byte(i)}
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: (-math.log(max(0.0, -sp.get_score(i)) + 2), i) for i in plain}
        self.byte_score = -math.log(2 * len(self.pieces) + 2)
        #: a trie of the pieces: by character the score and ids of the piece that ends there, or nothing twice, and what may follow
        self.root: dict[str, list] = {}
        for piece, (s, i) in self.score.items():
            kids = self.root
            for c in piece:
                node = kids.setdefault(c, [None, None, {}])
                kids = node[2]
            node[:2] = s, (i,)
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.parts = re.compile(self._pattern())

    def _pattern(self) -> str:
        """Parts between which no piece reaches: runs of joining characters and runs of others, each with the space marks before it."""
        pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        if any(x[0] != MARK and x[1] == MARK for x in pairs):
            raise ValueError("pieces with a space mark after another character are not supported")
        joining = {c for c in map(chr, range(0x250)) if c.isalpha()}
        while more := {c for x in pairs if MARK not in x and (x[0] in joining) != (x[1] in joining) for c in x} - joining:
            joining |= more
        known = "".join(re.escape(c) for c in sorted(joining))
        return f"{MARK}*[{known}]+|{MARK}*[^{known}{MARK}]+|{MARK}+"

    def edges(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """By end position: (start, score, ids)."""
        out: list[list] = [[] for _ in range(len(part) + 1)]
        for a in range(len(part)):
            kids = self.root
            for b in range(a, len(part)):
                if (node := kids.get(part[b])) is None:
                    break
                s, ids, kids = node
                if s is not None:
                    out[b + 1].append((a, s, ids))
            if part[a] not in self.score:
                raw = part[a].encode("utf-8", "surrogatepass")
                out[a + 1].append((a, self.byte_score * len(raw), tuple(self.bytes[x] for x in raw)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def viterbi(vocabulary: Vocabulary, part: str) -> tuple[list[float], list[float], list]:
    """Forward: by position the best score, the best through another last edge, and the best one's last edge (of equal ones the longest)."""
    n, score, root = len(part), vocabulary.score, vocabulary.root
    best, second, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    for a in range(n):
        base, kids, b = best[a], root, a
        for c in part[a:] if a else part:
            if (node := kids.get(c)) is None:
                break
            b += 1
            s, ids, kids = node
            if s is not None:
                s += base
                if s > best[b]:
                    second[b], best[b], back[b] = best[b], s, (a, ids)
                elif s > second[b]:
                    second[b] = s
        if part[a] not in score:
            raw = part[a].encode("utf-8", "surrogatepass")
            s = base + vocabulary.byte_score * len(raw)
            if s > best[a + 1]:
                second[a + 1], best[a + 1], back[a + 1] = best[a + 1], s, (a, tuple(vocabulary.bytes[x] for x in raw))
            elif s > second[a + 1]:
                second[a + 1] = s
    return best, second, back


def n_best(edges: list[list], best: list[float], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths as (score, ids), by backward A* under forward Viterbi scores. No position needs more than n visits."""
    end, out = len(edges) - 1, []
    agenda, visits, made = [(-best[end], 0, end, 0.0, None)], [0] * len(edges), 0
    while agenda and len(out) < n:
        _, _, at, got, path = heapq.heappop(agenda)
        if visits[at] == n:
            continue
        visits[at] += 1
        if at == 0:
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((got, tuple(ids)))
            continue
        for a, s, ids in edges[at]:
            made += 1
            heapq.heappush(agenda, (-(got + s + best[a]), made, a, got + s, (ids, path)))
    return out


class Segmenter:
    """Keeps the parts it has solved, in about LIMIT bytes; a part over LONGEST is solved each time."""

    LIMIT, LONGEST = 96 << 20, 4096

    def __init__(self, path: str, n: int = N_BEST) -> None:
        self.vocabulary, self.n = Vocabulary(path), n
        self.parts: dict[str, tuple[bytes, float, float]] = {}
        self.held = 0

    def _solve(self, part: str) -> tuple[bytes, float, float]:
        """Best ids, their score, and how much the second-best path scores less: the least loss of another edge into a position of the best one."""
        best, second, back = viterbi(self.vocabulary, part)
        ids, gap, at = [], math.inf, len(part)
        while at:
            if (loss := best[at] - second[at]) < gap:
                gap = loss
            at, own = back[at]
            ids += own[::-1]
        known = struct.pack(f"<{len(ids)}I", *reversed(ids)), best[-1], gap
        if len(part) <= self.LONGEST:
            self.held += 300 + 4 * len(part) + len(known[0])  # the objects' own sizes and their place in the dict
            if self.held > self.LIMIT:
                self.parts.clear()
                self.held = 300 + 4 * len(part) + len(known[0])
            self.parts[part] = known
        return known

    def choices(self, part: str) -> list[tuple[float, bytes]]:
        """The n best of a part as (loss, ids); the first is the one kept for it."""
        best, _, _ = viterbi(self.vocabulary, part)
        found = [(best[-1] - s, struct.pack(f"<{len(ids)}I", *ids)) for s, ids in n_best(self.vocabulary.edges(part), best, self.n)]
        first = (self.parts.get(part) or self._solve(part))[0]
        return [(0.0, first), *[f for f in found if f[1] != first][: self.n - 1]]

    def normalize(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def segment(self, text: str) -> list[tuple[float, bytes]]:
        """The n best (score, ids as little-endian 32-bit bytes), best first."""
        parts = self.vocabulary.parts.findall(self.normalize(text))
        known, solve = self.parts.get, self._solve
        found = [known(p) or solve(p) for p in parts]
        ids, score = [f[0] for f in found], math.fsum([f[1] for f in found])
        ways: list[tuple[float, list]] = [(0.0, [])]
        gaps = [f[2] for f in found]
        # each of the n best differs from the best in at most n-1 parts, and some n best ones in no other parts than these
        for i in sorted(heapq.nsmallest(self.n - 1, range(len(gaps)), key=gaps.__getitem__)) if self.n > 1 else []:
            if gaps[i] < math.inf:
                options = self.choices(parts[i])
                ways = heapq.nsmallest(self.n, [(loss + more, [*picked, (i, own)] if k else picked) for loss, picked in ways for k, (more, own) in enumerate(options)], key=lambda w: (w[0], w[1]))
        out = []
        for loss, picked in ways:
            other = list(ids)
            for i, own in picked:
                other[i] = own
            out.append((score - loss, b"".join(other)))
        return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """doc_id, scores (best first), ids of each (binary)."""
    held: list[Segmenter] = []

    def per_batch(batch):
        held or held.append(Segmenter(path, n))
        found = [held[0].segment(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "scores": [[s for s, _ in f] for f in found], "ids": [[i for _, i in f] for f in found]}

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, scores array<double>, ids array<binary>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: of the best segmentation in encode()'s rows."""
    held: list[Vocabulary] = []

    def per_batch(batch):
        held or held.append(Vocabulary(path))
        return {"doc_id": batch.column(0), "text": [held[0].decode(np.frombuffer(i[0], "<u4").tolist()) for i in batch.column(2).to_pylist()]}

    return map_batches(encoded, per_batch, "doc_id long, text string")


def n_best_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, n_found, nbest_scores, nbest_crc32 (comma-joined), decoded_equal (whether the best one decodes to the text), decoded_sha256."""
    held: list[Segmenter] = []

    def per_batch(batch):
        import hashlib

        held or held.append(Segmenter(path, n))
        rows = []
        for text in batch.column(1).to_pylist():
            found = held[0].segment(text)
            back = [held[0].vocabulary.decode(np.frombuffer(i, "<u4").tolist()) for _, i in found[:1]]
            ok = back[0] == text.replace(MARK, " ")
            rows.append((len(found[0][1]) // 4, zlib.crc32(found[0][1]), found[0][0], len(found), ",".join(f"{s:.4f}" for s, _ in found), ",".join(str(zlib.crc32(i)) for _, i in found), ok, hashlib.sha256(back[0].encode("utf-8", "surrogatepass")).hexdigest()))
        names = ("n_pieces", "ids_crc32", "score", "n_found", "nbest_scores", "nbest_crc32", "decoded_equal", "decoded_sha256")
        return {"doc_id": batch.column(0)} | {name: [r[k] for r in rows] for k, name in enumerate(names)}

    return map_batches(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, n_pieces long, ids_crc32 long, score double, n_found int, nbest_scores string, nbest_crc32 string, decoded_equal boolean, decoded_sha256 string")
