"""The parser on streams of all layers and kinds, and payloads that look like tags, headers and tables."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mpeg_audio as A
from tests.conftest import rows
from tests.llm.test_operators import table

MARKS = [b"TAG", b"ID3\x03", b"Info", b"Xing", b"VBRI", b"APETAGEX", b"LYRICSBEGIN", b"3DI", A.HEADER, b"\xff\xfb\x90\x64", b"\xff\xff\xff\xff", b"\0\0\0\0"]


@pytest.mark.parametrize("mark", MARKS)
def test_payloads_with_marks_at_every_place(mark):
    for units in (1, 2):
        for at in range(A.UNIT - len(mark) + 1):
            data = bytearray(b"x" * (A.UNIT * units))
            data[len(data) - A.UNIT + at : len(data) - A.UNIT + at + len(mark)] = mark
            media = A.store_payload(bytes(data))
            s = A.parse(media)
            assert A.read_payload(media, s) == data and (len(s.offsets), s.crc_ok, s.resyncs, s.skipped, s.tags) == (units, units, 0, 0, {})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MARKS) | st.binary(max_size=200), max_size=30).map(b"".join))
def test_any_payload_comes_back(data):
    media = A.store_payload(A.pad(data))
    assert A.read_payload(media, A.parse(media)) == A.pad(data)


def test_digests_match_hashlib(spark):
    random = np.random.default_rng(8)
    texts = ["".join(random.choice(list("TAGID3 Infoé的🙂\x00"), int(n))) for n in random.integers(0, 2500, 60)] + [None, "", "x" * 505 + "TAG" + "x" * 68, "\U0010ffff" * 144, "y" * 300_000]
    got = {r["doc_id"]: r for r in A.media_digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = A.pad(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(A.store_payload(payload)), hashlib.sha256(A.store_payload(payload)).hexdigest())
    assert rows(A.media_digests(table(spark, [(5, "same"), (6, "same"), (None, "same"), (5, "same")])).drop("doc_id").distinct())[0][0] == 4


def plain_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


def bits_of(raw):
    return [b >> 7 - k & 1 for b in raw for k in range(8)]


def stream(head, covered, n=4):
    """n frames of a header without a checksum bit, whose first covered data bits are random."""
    random = np.random.default_rng(covered)
    head = bytes([head[0], head[1] & 0xFE, *head[2:]])
    size, out = A.header_at(head + bytes(9000), 0).size, b""
    for _ in range(n):
        body = bytes(random.integers(0, 256, size - 6, dtype=np.uint8)).replace(b"\xff", b"\xfe")
        bits = covered(bits_of(body)) if callable(covered) else covered
        out += head + plain_crc(bits_of(head[2:]) + bits_of(body)[:bits]).to_bytes(2, "big") + body
    return out


@pytest.mark.parametrize("head, bits", [(b"\xff\xff\x90\x00", 256), (b"\xff\xff\x90\xc0", 128), (b"\xff\xff\x90\x40", 4 * (4 * 2 + 28)), (b"\xff\xff\x90\x60", 4 * (12 * 2 + 20))])
def test_layer_one_checksums(head, bits):
    data = stream(head, bits)
    s = A.parse(data)
    assert (s.header.layer, s.crc_ok, s.crc_bad, s.samples) == (1, 4, 0, 4 * 384)
    bad = bytearray(data)
    bad[6] ^= 1
    assert (A.parse(bytes(bad)).crc_ok, A.parse(bytes(bad)).crc_bad) == (3, 1)


@pytest.mark.parametrize("head, widths", [
    (b"\xff\xfd\xa4\xc0", [4] * 11 + [3] * 12 + [2] * 4),  # 48 kHz, 192 kbit/s, mono
    (b"\xff\xfd\xa0\xc0", [4] * 11 + [3] * 12 + [2] * 7),  # 44.1 kHz, 192 kbit/s, mono
    (b"\xff\xfd\x20\xc0", [4] * 2 + [3] * 6),  # 44.1 kHz, 48 kbit/s, mono
    (b"\xff\xfd\x28\xc0", [4] * 2 + [3] * 10),  # 32 kHz, 48 kbit/s, mono
    (b"\xff\xf5\x80\xc0", [4] * 4 + [3] * 7 + [2] * 19),  # 22.05 kHz
])
def test_layer_two_checksums(head, widths):
    random = np.random.default_rng(3)
    head = bytes([head[0], head[1] & 0xFE, *head[2:]])
    size, data = A.header_at(head + bytes(9000), 0).size, b""
    for _ in range(3):
        body = bytes(random.integers(0, 255, size - 6, dtype=np.uint8))
        every, at, chosen = bits_of(body), 0, 0
        for w in widths:
            chosen += any(every[at : at + w])
            at += w
        data += head + plain_crc(bits_of(head[2:]) + every[: at + 2 * chosen]).to_bytes(2, "big") + body
    s = A.parse(data)
    assert (s.header.layer, s.crc_ok, s.crc_bad) == (2, 3, 0)


def test_what_follows_the_last_frame():
    frames = A.store_payload(A.pad(b"q" * 2000))
    bare = bytearray(frames)
    for k in range(0, len(bare), A.FRAME):
        bare[k + 1] |= 1  # no checksum
    n = len(frames) // A.FRAME - 1
    plain = len(A.parse(bytes(bare)).offsets)
    for tail in (b"APETAGEX" + bytes(60), b"LYRICSBEGIN" + b"x" * 40, bytes(300), b"TAG" + bytes(125), b"APETAGEX" + b"x" * 60 + b"TAG" + bytes(125)):
        s = A.parse(bytes(bare) + tail)
        assert len(s.offsets) == plain and s.duration == A.parse(bytes(bare)).duration and s.resyncs == 0
        assert len(A.parse(frames + tail).offsets) == n
    # a tag behind frames that a table counts, and one over a frame that is cut off
    assert len(A.parse(frames[:-60] + b"TAG" + bytes(125)).offsets) == n - 1


def test_tags_of_all_versions():
    audio = A.store_payload(A.pad(b"x"))
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    two = b"TT2" + (6).to_bytes(3, "big") + b"\0Title"
    found = A.parse(b"ID3\x02\0\0" + size(len(two)) + two + audio)
    assert found.tags == {"TT2": "Title"} and len(found.offsets) == 1 and found.resyncs == 0
    three = b"TIT2" + (7).to_bytes(4, "big") + b"\0\0\0T\xfftle"
    extended = (6).to_bytes(4, "big") + bytes(6)
    assert A.parse(b"ID3\x03\0\x40" + size(len(extended + three)) + extended + three + audio).tags["TIT2"].startswith("T")
    hidden = three.replace(b"\xff", b"\xff\x00")
    assert A.parse(b"ID3\x03\0\x80" + size(len(hidden)) + hidden + audio).tags == A.parse(b"ID3\x03\0\0" + size(len(three)) + three + audio).tags
    four = b"TIT2" + size(10) + b"\0\x03" + size(5) + b"\0a\xff\x00bc"
    assert A.parse(b"ID3\x04\0\0" + size(len(four)) + four + audio).tags == {"TIT2": "aÿbc"}
    locked = b"TIT2" + (6).to_bytes(4, "big") + b"\0\x40\0Title"
    assert A.parse(b"ID3\x03\0\0" + size(len(locked)) + locked + audio).tags == {}


def test_free_format():
    head = b"\xff\xfb\x00\xc4"
    frame = head + b"y" * 396
    s = A.parse(frame * 5)
    assert (len(s.offsets), s.resyncs, set(s.sizes.tolist())) == (5, 0, {400}) and s.samples == 5 * 1152
