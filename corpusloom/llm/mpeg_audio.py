"""MPEG audio columns: payloads as Layer III streams, and a parser for such streams.

encode_media() lays a text's bytes, 255-padded to a positive multiple of 576, into MPEG-2 Layer III frames: 576
mono samples at 16 kHz a frame, and 576 payload bytes, one a sample, in the ancillary bytes after an empty granule.
The stream starts with an ID3v2 tag (the unpadded length) and a frame with a Xing table: frames, bytes and 100 seek points.
Every frame carries a CRC-16 of its side information.

parse_stream() reads any MPEG-1/2/2.5 Layer I-III stream:
- tags: ID3v2.2 to 2.4 (their encodings, size formats, extended headers, footers and unsynchronisation) and ID3v1;
- sync: the first frame whose successor also starts with a fitting header; frame lengths from there, and a new search where a
  header is broken;
- tables: Xing/Info with its seek points and the encoder's delay and padding, VBRI with its seek points;
- checks: the CRC of protected frames, over header and side information (III), bit allocation (I), or bit allocation and
  scale-factor selection (II); frames of a kind are checked together;
- the offset of every frame, and durations in samples, whole and without delay and padding.

Defined results: null and empty texts are one payload of 576 bytes 255; equal texts give equal streams; a stream with no
frame has no payload, duration 0 and no offsets; a frame that the end of the stream cuts counts as none; a tag that is broken ends
at its declared size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.common import id_and_text, map_batches

UNIT = 576
#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1..14, sample rates, samples a frame.
BITRATES = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}
CRC_POLYNOMIAL = 0x8005
#: Bits of allocation by subband in Layer II, as (subbands, bits) in a row.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}
#: Text encodings of ID3v2 by their first byte, and names of 2.2 frames under their later ones.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
SHORT_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX", "TLE": "TLEN"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int
    bound: int  # subbands below it have an allocation for each channel


@lru_cache(4096)
def read_header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(raw[1] >> 3 & 3)
    layer, index, rate_index = 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or not 0 < index < 15 or rate_index == 3:
        return None
    family = "1" if version == "1" else "2"
    kbit, rate, pad, samples = BITRATES[family, layer][index - 1], SAMPLE_RATES[version][rate_index], raw[2] >> 1 & 1, SAMPLES[family, layer]
    slot, mode = 4 if layer == 1 else 1, raw[3] >> 6
    bound = (raw[3] >> 4 & 3) * 4 + 4 if mode == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbit, rate, mode == 3, (samples // 8 * kbit * 1000 // (slot * rate) + pad) * slot, samples, bound)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint16) << np.uint16(8)
    for _ in range(8):
        value = np.where(value & 0x8000, (value << np.uint16(1)) ^ np.uint16(CRC_POLYNOMIAL), value << np.uint16(1)).astype(np.uint16)
    return value


_TABLE = _crc_table()


def crc16(rows: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The CRC of each row of bytes, of its first `bits` where they end within a byte."""
    bits = 8 * rows.shape[1] if bits is None else bits
    value = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(bits // 8):
        value = (value << np.uint16(8)) ^ _TABLE[(value >> np.uint16(8)) ^ rows[:, k]]
    for k in range(bits // 8 * 8, bits):
        top = (value >> np.uint16(15)) ^ (rows[:, k // 8] >> np.uint8(7 - k % 8) & 1)
        value = (value << np.uint16(1)) ^ np.where(top, np.uint16(CRC_POLYNOMIAL), np.uint16(0))
    return value


def side_bytes(h: Header) -> int:
    return (17 if h.mono else 32) if h.version == "1" else (9 if h.mono else 17)


def allocation_bits(h: Header) -> list[int]:
    """Layer II: bits of allocation by subband."""
    if h.version != "1":
        kind = "lsf"
    else:
        each = h.bitrate // (1 if h.mono else 2)
        if each <= 48:
            kind = "d" if h.rate == 32000 else "c"
        else:
            kind = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[kind] for _ in range(n)]


def _bit(row: bytes, at: int) -> int:
    return row[at >> 3] >> (7 - (at & 7)) & 1


def checked_bits(h: Header, body: bytes) -> int:
    """So many bits after header and checksum are covered by it. body is needed for Layer II, whose selection bits follow the subbands in use."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * side_bytes(h)
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + min(h.bound, 32))
    at = used = 0
    for subband, bits in enumerate(allocation_bits(h)):
        own = channels if subband < h.bound else 1
        for _ in range(own):
            if at + bits > 8 * len(body):
                return 8 * len(body)
            used += any(_bit(body, at + k) for k in range(bits)) * (channels if own == 1 else 1)
            at += bits
    return min(at + 2 * used, 8 * len(body))


#: MPEG-2 Layer III, protected, 144 kbit/s, 16 kHz, mono: 648 bytes a frame.
_HEAD = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_FRAME = read_header(_HEAD)
_SIDE = bytes(side_bytes(_FRAME))
_LEAD = _HEAD + struct.pack(">H", int(crc16(np.frombuffer(_HEAD[2:] + _SIDE, np.uint8)[None])[0])) + _SIDE
_AT = len(_LEAD)


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(raw: bytes) -> bytes:
    payload = pad(raw)
    n = len(payload) // UNIT
    note = b"\x00length\x00" + str(len(raw)).encode()
    tag = b"TXXX" + struct.pack(">I", len(note)) + b"\x00\x00" + note
    id3 = b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag
    size = (n + 1) * _FRAME.length
    seek = bytes(256 * ((n + 1) * i // 100) // (n + 1) for i in range(100))
    xing = (_LEAD + b"Xing" + struct.pack(">III", 7, n, size) + seek).ljust(_FRAME.length, b"\0")
    frames = np.zeros((n, _FRAME.length), np.uint8)
    frames[:, :_AT] = np.frombuffer(_LEAD, np.uint8)
    frames[:, _AT : _AT + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return id3 + xing + frames.tobytes()


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    table: dict | None = None
    table_at: int | None = None
    offsets: list = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbit_sum: int = 0
    checked: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    ancillary: list = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    @property
    def played(self) -> int:
        """Samples without the encoder's delay and padding, where the table tells them."""
        t = self.table or {}
        return max(0, self.samples - t.get("delay", 0) - t.get("padding", 0))

    @property
    def seek_points(self) -> list[int]:
        """Byte offsets in the stream: at each hundredth of the duration (Xing), or after each entry's frames (VBRI)."""
        t = self.table or {}
        if t.get("kind") == "VBRI":
            return (np.cumsum(t["entries"], dtype=np.int64) + self.table_at).tolist() if t.get("entries") else []
        if "seek" in t and "bytes" in t:
            return [self.table_at + x * t["bytes"] // 256 for x in t["seek"]]
        return []


def _decoded(raw: bytes, encoding: int) -> str:
    return raw.decode(ENCODINGS[encoding] if encoding < 4 else "latin-1", "replace")


def _split(raw: bytes, encoding: int) -> tuple[bytes, bytes]:
    """Before and after the first terminator: a NUL, or two at an even place in the wide encodings."""
    if encoding not in (1, 2):
        a, _, b = raw.partition(b"\0")
        return a, b
    at = next((i for i in range(0, len(raw) - 1, 2) if raw[i : i + 2] == b"\0\0"), len(raw))
    return raw[:at], raw[at + 2 :]


def _sync_number(raw: bytes) -> int:
    out = 0
    for b in raw:
        out = out << 7 | b & 0x7F
    return out


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    major, flags, size = data[at + 3], data[at + 5], _sync_number(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\x00", b"\xff")
    p = 0
    if flags & 0x40 and major > 2 and len(body) >= 4:
        p = _sync_number(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    head, name_size = (6, 3) if major == 2 else (10, 4)
    while p + head <= len(body) and body[p : p + 1].isalnum():
        name = body[p : p + name_size].decode("latin-1")
        raw_size = body[p + name_size : p + 2 * name_size]
        n = _sync_number(raw_size) if major == 4 else int.from_bytes(raw_size, "big")
        value = body[p + head : p + head + n]
        if major == 4:
            marks = body[p + 9]
            if marks & 1:  # a length before the data
                value = value[4:]
            if marks & 2 or flags & 0x80:
                value = value.replace(b"\xff\x00", b"\xff")
        name = SHORT_NAMES.get(name, name)
        if name[0] == "T" and value:
            encoding, value = value[0], value[1:]
            if name == "TXXX":
                key, value = _split(value, encoding)
                out.tags[_decoded(key, encoding)] = _decoded(value, encoding).rstrip("\0")
            else:
                out.tags[name] = _decoded(value, encoding).rstrip("\0").replace("\0", " / ")
        p += head + n
    return end


def _id3v1(tag: bytes, out: Stream) -> None:
    """The last 128 bytes; fields that ID3v2 has stay as they are."""
    text = lambda raw: raw.split(b"\0")[0].decode("latin-1").rstrip()
    found = {"TIT2": text(tag[3:33]), "TPE1": text(tag[33:63]), "TALB": text(tag[63:93]), "TYER": text(tag[93:97]), "COMM": text(tag[97:127])}
    if tag[125] == 0 and tag[126]:
        found["TRCK"] = str(tag[126])
    found["TCON"] = str(tag[127]) if tag[127] != 255 else ""
    for k, v in found.items():
        if v:
            out.tags.setdefault(k, v)


def _table(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + side_bytes(h)
    for at in (at, at - 2 * h.protected):  # some writers leave no room for a checksum
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
                if flags & bit:
                    out[key] = frame[p : p + n] if key == "seek" else int.from_bytes(frame[p : p + n], "big")
                    p += n
            if len(frame) >= p + 24 and frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO"):
                gap = int.from_bytes(frame[p + 21 : p + 24], "big")
                out |= {"encoder": frame[p : p + 9].decode("latin-1").rstrip("\0 "), "delay": gap >> 12, "padding": gap & 0xFFF}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, _, size, frames, n, scale, width, each = struct.unpack(">HHIIHHHH", frame[42:62])
        cells = frame[62 : 62 + n * width] if width in (1, 2, 3, 4) else b""
        entries = [int.from_bytes(cells[k : k + width], "big") * scale for k in range(0, len(cells) // width * width, width)] if cells else []
        return {"kind": "VBRI", "bytes": size, "frames": frames, "entries": entries, "frames_each": each}
    return None


def _next_sync(data: bytes, at: int) -> int:
    """The next frame that the end of data or a header of the same kind follows; -1: none."""
    while (at := data.find(b"\xff", at)) >= 0:
        h = read_header(data[at : at + 4])
        if h and (end := at + h.length) <= len(data):
            after = read_header(data[end : end + 4])
            if end == len(data) or data[end : end + 3] == b"TAG" or after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate):
                return at
        at += 1
    return -1


def _check(data: bytes, frames: dict[Header, list[int]], out: Stream) -> None:
    """CRCs of the protected frames, those of a header and number of covered bits together."""
    raw = np.frombuffer(data, np.uint8)
    for h, starts in frames.items():
        by: dict[int, list[int]] = defaultdict(list)
        for s in starts:
            by[checked_bits(h, data[s + 6 : s + h.length] if h.layer == 2 else b"")].append(s)
        for bits, same in by.items():
            places = np.array(same)
            at = np.concatenate([[2, 3], np.arange(6, min(6 + -(-bits // 8), h.length))])
            rows = raw[places[:, None] + at]
            stored = raw[places + 4].astype(np.uint16) << np.uint16(8) | raw[places + 5]
            out.checked += len(same)
            out.bad_crc += int((crc16(rows, min(16 + bits, 8 * rows.shape[1])) != stored).sum())


def parse_stream(data: bytes) -> Stream:
    out, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and data[at + 3] in (2, 3, 4):
        at = _id3v2(data, at, out)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        _id3v1(data[end:], out)
    lost, protected = True, defaultdict(list)
    while at < end:
        h = read_header(data[at : at + 4])
        if lost or h is None or at + h.length > end:
            found = _next_sync(data, at if lost else at + 1)
            if not 0 <= found < end:
                break
            out.resyncs += bool(out.offsets) or found > at
            at, lost = found, False
            h = read_header(data[at : at + 4])
        if not out.offsets and out.table is None and h.layer == 3 and (table := _table(data[at : at + h.length], h)):
            out.table, out.table_at = table, at
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.kbit_sum += h.bitrate
            out.rate = out.rate or h.rate
            if h.protected:
                protected[h].append(at)
            out.ancillary.append(data[at + 4 + 2 * h.protected + (side_bytes(h) if h.layer == 3 else 0) : at + h.length])
        at += h.length
    _check(data, protected, out)
    return out


def payload_of(stream: Stream) -> bytes:
    return b"".join(x[:UNIT] for x in stream.ancillary)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (binary)."""
    return map_batches(id_and_text(docs, id_col, text_col), lambda b: {"doc_id": b.column(0), "media": [encode(t.encode()) for t in b.column(1).to_pylist()]}, "doc_id long, media binary")


FEATURES = "doc_id long, samples long, played_samples long, sample_rate int, seconds double, mean_kbit double, n_frames long, table_kind string, table_frames long, encoder_delay int, encoder_padding int, checked long, bad_crc long, resyncs long, frame_offsets array<long>, seek_points array<long>, tags map<string,string>, tag_length long, payload binary, media_bytes long, media_sha256 string"


def read_media(media: DataFrame) -> DataFrame:
    """What a stream holds, by row of (doc_id, media): tags, exact durations, checks, seek points, the offset of every frame and the payload."""
    names = [f.split()[0] for f in FEATURES.replace("map<string,string>", "map").split(", ")]

    def per_batch(batch):
        rows = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = data or b""
            s = parse_stream(data)
            n, table = len(s.offsets), s.table or {}
            tag = s.tags.get("length", "")
            length = int(tag) if tag.isascii() and tag.isdigit() and len(tag) < 19 else None
            rows.append((i, s.samples, s.played, s.rate, s.seconds, s.kbit_sum / n if n else 0.0, n, table.get("kind"), table.get("frames"), table.get("delay"), table.get("padding"), s.checked, s.bad_crc, s.resyncs, s.offsets, s.seek_points, list(s.tags.items()), length, payload_of(s), len(data), hashlib.sha256(data).hexdigest()))
        return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

    return map_batches(media, per_batch, FEATURES)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what read_media() reads back from encode_media()."""

    def per_batch(batch):
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        payloads = c["payload"]
        feature = [
            f"mpeg2-layer3;samples={s};rate={r};seconds={x:.3f};kbit={k:g};frames={n};table={t}:{tf};bad_crc={b};resyncs={y};offsets={zlib.crc32(np.asarray(o, '<u8').tobytes()):08x};last={o[-1] if o else -1}"
            for s, r, x, k, n, t, tf, b, y, o in zip(c["samples"], c["sample_rate"], c["seconds"], c["mean_kbit"], c["n_frames"], c["table_kind"], c["table_frames"], c["bad_crc"], c["resyncs"], c["frame_offsets"], strict=True)
        ]
        return {
            "doc_id": batch.column(0), "n_bytes": c["tag_length"], "payload_bytes": [len(p) for p in payloads], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads], "media_bytes": c["media_bytes"], "media_sha256": c["media_sha256"], "feature": feature,
        }

    return map_batches(read_media(encode_media(docs, id_col, text_col)), per_batch, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
