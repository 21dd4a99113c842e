"""Streams made by hand, of each layer, tag and table."""

import struct

import numpy as np
import pytest

from corpusloom.llm import mpeg_audio as M


def plain_crc(bits):
    value = 0xFFFF
    for bit in bits:
        top = value >> 15 ^ bit
        value = (value << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return value


def bits_of(raw):
    return [b >> k & 1 for b in raw for k in range(7, -1, -1)]


def frame(head, rng, covered=None):
    """A frame of random bytes under a header, with its checksum; covered: bits after the checksum."""
    h = M.read_header(head)
    body = rng.integers(0, 256, h.length - 6, np.uint8).tobytes()
    n = M.checked_bits(h, body) if covered is None else covered
    return head + struct.pack(">H", plain_crc(bits_of(head[2:]) + bits_of(body)[:n])) + body


HEADS = {
    "layer I stereo": bytes((0xFF, 0xFE, 0x54, 0x04)), "layer I joint": bytes((0xFF, 0xFE, 0x54, 0x64)), "layer I mono": bytes((0xFF, 0xFE, 0x54, 0xC4)),
    "layer II": bytes((0xFF, 0xFC, 0xA4, 0x04)), "layer II joint": bytes((0xFF, 0xFC, 0xA0, 0x54)), "layer II mono": bytes((0xFF, 0xFC, 0x20, 0xC4)), "layer II half rate": bytes((0xFF, 0xF4, 0x84, 0x04)),
    "layer III": bytes((0xFF, 0xFA, 0x90, 0x04)), "layer III mono": bytes((0xFF, 0xFA, 0x50, 0xC4)), "layer III half rate": bytes((0xFF, 0xF2, 0x84, 0x04)),
}


@pytest.mark.parametrize("name", HEADS)
def test_checksums_of_every_layer(name):
    rng = np.random.default_rng(len(name))
    frames = [frame(HEADS[name], rng) for _ in range(5)]
    s = M.parse_stream(b"".join(frames))
    assert (len(s.offsets), s.checked, s.bad_crc, s.resyncs) == (5, 5, 0, 0)
    hurt = [bytearray(f) for f in frames]
    hurt[1][6] ^= 0x10
    hurt[3][4] ^= 0x01
    assert M.parse_stream(b"".join(map(bytes, hurt))).bad_crc == 2


def test_bits_that_layers_cover():
    h = {n: M.read_header(x) for n, x in HEADS.items()}
    assert [M.checked_bits(h[n], b"") for n in ("layer I stereo", "layer I mono", "layer III", "layer III mono", "layer III half rate")] == [256, 128, 256, 136, 136]
    assert M.checked_bits(h["layer I joint"], b"") == 4 * (32 + 12)
    # 48 kHz, 96 kbit/s a channel: 27 subbands, 11 of 4 bits, 12 of 3, 4 of 2, for two channels; no subband in use
    assert M.checked_bits(h["layer II"], bytes(200)) == 2 * (11 * 4 + 12 * 3 + 4 * 2)
    assert M.checked_bits(h["layer II"], b"\x10" + bytes(200)) == 2 * 88 + 2


def _tag(major, frames, flags=0, extra=b"", footer=b""):
    body = extra + frames
    return b"ID3" + bytes((major, 0, flags)) + M._syncsafe(len(body)) + body + footer


def _text(major, name, value):
    if major == 2:
        return name + len(value).to_bytes(3, "big") + value
    size = M._syncsafe(len(value)) if major == 4 else struct.pack(">I", len(value))
    return name + size + b"\0\0" + value


LONG = "é" * 200
TAGS = [
    (_tag(3, _text(3, b"TIT2", b"\x01" + "Žena 日本".encode("utf-16"))), {"TIT2": "Žena 日本"}),
    (_tag(3, _text(3, b"TIT2", b"\x00caf\xe9\0")), {"TIT2": "café"}),
    (_tag(4, _text(4, b"TIT2", b"\x03" + LONG.encode()) + _text(4, b"TPE1", b"\x02" + "ab".encode("utf-16-be"))), {"TIT2": LONG, "TPE1": "ab"}),
    (_tag(2, _text(2, b"TT2", b"\x00short") + _text(2, b"TXX", b"\x00key\0value")), {"TIT2": "short", "key": "value"}),
    (_tag(3, _text(3, b"TXXX", b"\x01" + "k".encode("utf-16") + b"\0\0" + "v".encode("utf-16"))), {"k": "v"}),
    (_tag(4, _text(4, b"TIT2", b"\x00x"), flags=0x10, footer=b"3DI\x04\0\x10" + bytes(4)), {"TIT2": "x"}),
    (_tag(3, _text(3, b"TIT2", b"\x00x"), flags=0x40, extra=struct.pack(">I", 6) + bytes(6)), {"TIT2": "x"}),
    (_tag(4, _text(4, b"TIT2", b"\x00x"), flags=0x40, extra=M._syncsafe(6) + b"\x01\x00"), {"TIT2": "x"}),
    (_tag(3, _text(3, b"TIT2", b"\x00\xff\xe0").replace(b"\xff\xe0", b"\xff\x00\xe0"), flags=0x80), {"TIT2": "ÿà"}),
]


@pytest.mark.parametrize(("tag", "want"), TAGS)
def test_tags(tag, want):
    rng = np.random.default_rng(1)
    frames = b"".join(frame(HEADS["layer III"], rng) for _ in range(3))
    s = M.parse_stream(tag + frames)
    assert s.tags == want and s.offsets[0] == len(tag) and s.resyncs == 0


def test_the_old_tag():
    rng = np.random.default_rng(2)
    frames = b"".join(frame(HEADS["layer III"], rng) for _ in range(3))
    old = b"TAG" + b"Old title".ljust(30, b"\0") + b"Someone".ljust(30) + b"Album".ljust(30, b"\0") + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    s = M.parse_stream(_tag(3, _text(3, b"TIT2", b"\x00New")) + frames + old)
    assert s.tags == {"TIT2": "New", "TPE1": "Someone", "TALB": "Album", "TYER": "1999", "COMM": "note", "TRCK": "7", "TCON": "17"} and len(s.offsets) == 3


def test_tables():
    rng = np.random.default_rng(3)
    head = bytes((0xFF, 0xFB, 0x90, 0x04))
    h = M.read_header(head)
    plain = lambda: head + bytes(32) + rng.integers(0, 255, h.length - 36, np.uint8).tobytes()
    frames = b"".join(plain() for _ in range(10))
    size = 11 * h.length
    seek = bytes(range(0, 200, 2))
    xing = (head + bytes(32) + b"Xing" + struct.pack(">III", 7, 10, size) + seek + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")).ljust(h.length, b"\0")
    s = M.parse_stream(xing + frames)
    assert (s.samples, s.played, s.table["encoder"]) == (11520, 11520 - 1576, "LAME3.100")
    assert s.seek_points == [x * size // 256 for x in seek] and s.offsets == [h.length * (i + 1) for i in range(10)]
    vbri = (head + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, size, 10, 5, 1, 2, 2) + b"".join(struct.pack(">H", 2 * h.length) for _ in range(5))).ljust(h.length, b"\0")
    s = M.parse_stream(vbri + frames)
    assert (s.table["kind"], s.table["frames"], s.table["bytes"]) == ("VBRI", 10, size)
    assert s.seek_points == [2 * h.length * (i + 1) for i in range(5)]


def test_resync_and_cut_streams():
    rng = np.random.default_rng(4)
    frames = [frame(HEADS["layer III"], rng) for _ in range(6)]
    s = M.parse_stream(b"junk\xff\xfb" + b"".join(frames[:3]) + b"\xff\xe0 noise" + b"".join(frames[3:]) + frames[0][:100])
    assert (len(s.offsets), s.checked, s.bad_crc) == (6, 6, 0) and s.resyncs == 2
    for cut in (b"", b"ID3", b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"\xff" * 5000, frames[0][:50]):
        assert M.parse_stream(cut).samples == 0


def test_columns(spark):
    rng = np.random.default_rng(5)
    streams = [(1, bytearray(TAGS[0][0] + b"".join(frame(HEADS["layer II"], rng) for _ in range(4)))), (2, None), (3, bytearray(b""))]
    got = {r.doc_id: r for r in M.read_media(spark.createDataFrame(streams, "doc_id long, media binary")).collect()}
    assert got[1].tags == TAGS[0][1] and got[1].n_frames == 4 and got[1].checked == 4 and got[1].bad_crc == 0 and got[2].n_frames == got[3].n_frames == 0
