"""MPEG audio columns: a parser that resynchronises, and a lossless container for byte payloads.

The parser walks frame headers, skips what is not a frame, reads ID3 tags and Xing/Info/VBRI tables, verifies the
CRC-16 of frames of all three layers, and gives the exact duration as a fraction and the offset of every frame. Tags at
the end are looked for where frames end, never before. The container puts 576 payload bytes, a frame's number of samples
at the low sampling rates, into the ancillary part of a silent frame.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import bound_arrow

# Fixed values of the MPEG audio standards (ISO/IEC 11172-3 and 13818-3).
#: kbit/s by (low sampling rates, layer), for bit rate indices 1 to 14.
BITRATES = {
    (False, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by version bits: 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Generator of the frames' CRC-16, which starts from all ones.
CRC_POLYNOMIAL = 0x8005

#: Layer II: bits of a sub-band's allocation as (bits, sub-bands) from the lowest on, for the tables a to d and low rates.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}
#: Starts of what may follow the last frame besides an ID3v1 tag: APE tags, Lyrics3, an ID3v2 footer's tag, padding.
TRAILERS = (b"APETAGEX", b"LYRICSBEGIN", b"ID3", b"3DI", b"\0\0\0\0")
#: The longest frame of a stream that names no bit rate (free format), and the shortest.
FREE_MOST, FREE_LEAST = 8192, 24

#: Payload bytes of a frame of the container.
UNIT = 576
#: Container frames: MPEG-2 layer III, CRC, 144 kbit/s, 16 kHz, mono: 648 bytes.
HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])
FRAME = 648


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """Checksum of whole bytes, or of the first bits of them."""
    crc, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for byte in data[:whole]:
        crc = (crc << 8 & 0xFFFF) ^ CRC[crc >> 8 ^ byte]
    for k in range((bits or 0) % 8):
        bit = data[whole] >> 7 - k & 1
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if (crc >> 15) ^ bit else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    channels: int
    size: int
    samples: int
    #: Sub-bands that both channels have an allocation of their own in; the rest share one (joint stereo).
    bound: int = 32

    @property
    def kind(self) -> tuple:
        """What stays the same through a stream."""
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return {(3, 1): 17, (3, 2): 32}.get((self.version, self.channels), 9 if self.channels == 1 else 17) if self.layer == 3 else 0


def header_at(data: bytes, at: int, free: int | None = None) -> Header | None:
    """The frame header at an offset, or None. free: bytes of a frame without padding, for streams that name no bit rate."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer, rate, bits = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer == 4 or rate == 3 or bits == 15 or b3 & 3 == 2 or not bits and free is None:
        return None
    low, padding = version != 3, b2 >> 1 & 1
    hz, bitrate = RATES[version][rate], BITRATES[low, layer][bits - 1] * 1000 if bits else 0
    samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
    slot = 4 if layer == 1 else 1
    size = ((12 * bitrate // hz if layer == 1 else samples // 8 * bitrate // hz) + padding) * slot if bits else free + padding * slot
    mode = b3 >> 6
    return Header(version, layer, not b1 & 1, bitrate, hz, padding, 1 if mode == 3 else 2, size, samples, 4 * (b3 >> 4 & 3) + 4 if mode == 1 else 32)


def free_size(data: bytes, at: int) -> int | None:
    """Bytes of a frame without padding where a header names no bit rate: where the like headers of the next two frames stand."""
    h = header_at(data, at, 0)
    if not h or h.bitrate:
        return None
    slot, same = 4 if h.layer == 1 else 1, lambda k: len(data) >= k + 4 and data[at : at + 2] == data[k : k + 2] and data[at + 2] & 0xFC == data[k + 2] & 0xFC
    k = data.find(b"\xff", at + FREE_LEAST, at + FREE_MOST)
    while k >= 0:
        size = k - at - h.padding * slot
        if same(k) and (k + size + (data[k + 2] >> 1 & 1) * slot == len(data) or same(k + size + (data[k + 2] >> 1 & 1) * slot)):
            return size
        k = data.find(b"\xff", k + 1, at + FREE_MOST)
    return None


def _layer2_bits(data: bytes, at: int, h: Header) -> int | None:
    """Bits of allocations and scale factor choices of a layer II frame whose data begin at an offset."""
    per = h.bitrate // 1000 // h.channels
    if h.version != 3:
        table = "low"
    elif per and per < 56:
        table = "d" if h.rate == 32000 else "c"
    else:
        table = "a" if h.rate == 48000 or per and per <= 80 else "b"
    widths = [bits for bits, n in ALLOCATION[table] for _ in range(n)]
    raw, i, chosen = int.from_bytes(data[at : at + 64].ljust(64, b"\0"), "big"), 0, 0
    for band, bits in enumerate(widths):
        own = h.channels if band < h.bound else 1
        for _ in range(own):
            value = raw >> 512 - i - bits & (1 << bits) - 1
            chosen += (h.channels if own == 1 else 1) * (value > 0)
            i += bits
    return i + 2 * chosen


def crc_holds(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a frame's checksum holds; None where the frame has none.

    It covers the last two header bytes and the side information (layer III), or allocations (layer I), and the
    choice of scale factors (layer II).
    """
    if not h.protected:
        return None
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (min(h.bound, 32) * h.channels + 32 - min(h.bound, 32))
    else:
        bits = _layer2_bits(data, at + 6, h)
    stop = at + 6 + (bits + 7) // 8
    return stop <= len(data) and crc16(data[at + 2 : at + 4] + data[at + 6 : stop], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    """What parse() finds. offsets and sizes are those of audio frames, a table's own frame left out."""

    tags: dict = field(default_factory=dict)
    header: Header | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    vbr: dict = field(default_factory=dict)

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.header.rate) if self.header else Fraction(0)

    def seek(self, seconds: Fraction) -> int | None:
        """Offset of the frame that plays at a time."""
        if not self.header or not len(self.offsets) or seconds < 0:
            return None
        n = int(seconds * self.header.rate // self.header.samples)
        return int(self.offsets[n]) if n < len(self.offsets) else None


def _tag_text(raw: bytes) -> str:
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return raw[1:].decode(kinds.get(raw[0], "latin-1"), "replace").strip("\0") if raw else ""


def _synchronised(raw: bytes) -> bytes:
    """Bytes as they were before zeros were put behind bytes 255."""
    return raw.replace(b"\xff\x00", b"\xff")


def read_id3(data: bytes) -> tuple[dict, int]:
    """Text frames of an ID3v2.2, 2.3 or 2.4 tag at the start, by the tag's own names, and where the audio begins.

    Unsynchronised tags and frames are read as they were; extended headers, and frames that are compressed or encrypted,
    are skipped. A cut-off tag ends the file.
    """
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3] if len(b) == 4 else 0
    plain = lambda b: int.from_bytes(b, "big")
    version, flags, out = data[3], data[5], {}
    end = min(len(data), 10 + safe(data[6:10]))
    body = data[10:end] if version >= 4 or not flags & 0x80 else _synchronised(data[10:end])
    short = version < 3
    at = 0 if short or not flags & 0x40 else safe(body[:4]) if version >= 4 else 4 + plain(body[:4])
    wide, head = (3, 6) if short else (4, 10)
    while at + head <= len(body) and body[at : at + wide].strip(b"\0"):
        size = (safe if version >= 4 else plain)(body[at + wide : at + 2 * wide])
        name, text, marks = body[at : at + wide].decode("latin-1"), body[at + head : at + head + size], 0 if short else body[at + 9]
        if version >= 4:
            text = _synchronised(text) if marks & 2 or flags & 0x80 else text
            text = text[4:] if marks & 1 else text
        hidden = marks & (0x0C if version >= 4 else 0xC0)
        if name[0] == "T" and not hidden:
            out[name] = _tag_text(text)
        at += head + size
    return out, end + (10 if flags & 0x10 else 0)


def read_vbr(data: bytes, at: int, h: Header) -> dict:
    """The table of a Xing, Info or VBRI frame; empty if the frame is an audio frame."""
    number = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    x = at + 4 + (2 if h.protected else 0) + h.side
    if h.layer == 3 and data[x : x + 4] in (b"Xing", b"Info"):
        out, flags, i = {"kind": data[x : x + 4].decode()}, number(x + 4), x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], i = number(i), i + 4
        if flags & 4:
            out["toc"], i = list(data[i : i + 100]), i + 100
        if flags & 8:
            out["quality"] = number(i)
        return out
    v = at + 36
    if h.layer == 3 and data[v : v + 4] == b"VBRI":
        n, scale, width, per = number(v + 18, 2), number(v + 20, 2), number(v + 22, 2), number(v + 24, 2)
        table = [number(v + 26 + k * width, width) * scale for k in range(n)] if width and v + 26 + n * width <= len(data) else []
        return {"kind": "VBRI", "bytes": number(v + 10), "frames": number(v + 14), "toc": table, "frames_per_entry": per}
    return {}


def _run_length(raw: np.ndarray, at: int, size: int) -> int:
    """How many frames with the same four header bytes follow each other from an offset."""
    n = (len(raw) - at) // size
    if n <= 1:
        return n
    grid = raw[at : at + n * size].reshape(n, size)
    same = (grid[:, :4] == grid[0, :4]).all(axis=1)
    return n if same.all() else int(same.argmin())


def parse(data: bytes) -> Stream:
    """Read a stream of frames.

    A header counts if the next one of the same kind follows it, or the stream or its tags begin where its frame ends, or,
    in sync, its checksum holds; elsewhere the parser moves on to the next sync byte and counts the resynchronisation and
    the bytes skipped. A last frame that is cut off is skipped. An ID3v1 tag is one only where no frame in sync covers it,
    so a frame that ends with the stream keeps bytes that look like a tag, unless the table's frames have all come.
    """
    out, raw, n = Stream(), np.frombuffer(data, np.uint8), len(data)
    out.tags, at = read_id3(data)
    tag = n - 128 if n - at >= 128 and data[n - 128 : n - 125] == b"TAG" else n
    offsets, sizes, lost, count, free = [], [], False, 0, None
    while at < n:
        if at == tag or not lost and out.header and data.startswith(TRAILERS, at) and not header_at(data, at, free):
            break
        if free is None and out.header is None and (h := header_at(data, at, 0)) and not h.bitrate:
            free = free_size(data, at)
        h = header_at(data, at, free)
        stop = at + h.size if h else 0
        # in sync, a frame that ends with the stream owns what looks like a tag, unless a table says that all have come
        inside = h and (stop <= tag or stop == n and not lost and count < out.vbr.get("frames", count + 1))
        if inside and (out.header is None or h.kind == out.header.kind) and h.size >= 4:
            after = header_at(data, stop, free)
            ends = stop in (n, tag) or out.header is not None and not lost and data.startswith(TRAILERS, stop)
            if ends or after and after.kind == h.kind or not lost and crc_holds(data, at, h):
                lost = False
                first = out.header is None
                out.header = out.header or h
                if first and (table := read_vbr(data, at, h)):
                    out.vbr = table
                    at = stop
                    continue
                run = max(1, _run_length(raw[:tag], at, h.size))
                offsets.append(at + h.size * np.arange(run, dtype=np.int64))
                sizes.append(np.full(run, h.size, np.int64))
                count += run
                out.samples += run * h.samples
                _verify(out, raw, data, at, h, run)
                at += run * h.size
                continue
        step = data.find(b"\xff", at + 1, tag)
        step = tag if step < 0 else step
        out.resyncs += not lost
        out.skipped += step - at
        lost, at = True, step
    if at == tag < n:
        out.tags.setdefault("TIT2", data[tag + 3 : tag + 33].decode("latin-1").strip("\0 "))
    out.offsets = np.concatenate(offsets) if offsets else out.offsets
    out.sizes = np.concatenate(sizes) if sizes else out.sizes
    return out


def _verify(out: Stream, raw: np.ndarray, data: bytes, at: int, h: Header, run: int) -> None:
    """Verify the checksums of a run of like frames; layer III frames with the same protected bytes are computed once."""
    if not h.protected:
        return
    if run > 1 and h.layer == 3:
        grid = raw[at : at + run * h.size].reshape(run, h.size)[:, : 6 + h.side]
        if (grid == grid[0]).all():
            ok = run if crc_holds(data, at, h) else 0
        else:
            ok = sum(bool(crc_holds(data, at + k * h.size, h)) for k in range(run))
    else:
        ok = sum(bool(crc_holds(data, at + k * h.size, h)) for k in range(run))
    out.crc_ok += ok
    out.crc_bad += run - ok


def pad(data: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store_payload(payload: bytes) -> bytes:
    """A stream with an Info frame and a silent frame per UNIT payload bytes, which it holds as ancillary data."""
    n = len(payload) // UNIT
    side = bytes(9)
    start = HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, : len(start)] = np.frombuffer(start, np.uint8)
    frames[1:, len(start) : len(start) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + bytes(k * 256 // 100 for k in range(100))
    frames[0, len(start) : len(start) + len(info)] = np.frombuffer(info, np.uint8)
    return frames.tobytes()


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes of the container's frames."""
    skip = 15
    if not len(stream.offsets):
        return b""
    steps = np.diff(stream.offsets)
    if (steps == FRAME).all():
        first = int(stream.offsets[0])
        return np.frombuffer(data, np.uint8)[first : first + FRAME * len(stream.offsets)].reshape(-1, FRAME)[:, skip : skip + UNIT].tobytes()
    return b"".join(data[o + skip : o + skip + UNIT] for o in stream.offsets.tolist())


def feature(stream: Stream) -> str:
    """One line of what a parse found."""
    h, d = stream.header, stream.duration
    head = f"v{h.version} l{h.layer} {h.rate} Hz {h.channels} ch" if h else "none"
    last = int(stream.offsets[-1]) if len(stream.offsets) else -1
    return f"{head}; frames {len(stream.offsets)}; samples {stream.samples}; seconds {d.numerator}/{d.denominator}; crc {stream.crc_ok}/{stream.crc_bad}; resync {stream.resyncs}; table {stream.vbr.get('kind', '-')} {stream.vbr.get('frames', '-')}; last frame {last}"


def _schema(df: DataFrame, id_col: str, **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(k, v) for k, v in columns.items())])


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes long, media binary: every whole text as a stored stream; null counts as empty."""
    bound_arrow(docs.sparkSession)
    schema = _schema(docs, id_col, n_bytes=T.LongType(), media=T.BinaryType())

    def run(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([store_payload(pad(x)) for x in raw], pa.binary())], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def parse_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parse streams: id_col, tags, rates, exact duration, checksum and resynchronisation counts, table, seek offsets.

    Null and empty streams, and streams without a frame, give zero frames, a duration of 0/1 and empty lists.
    """
    bound_arrow(media.sparkSession)
    long, ints = T.LongType(), T.ArrayType(T.LongType())
    schema = _schema(media, id_col, tags=T.MapType(T.StringType(), T.StringType()), version=long, layer=long, sample_rate=long, channels=long, frames=long, samples=long, seconds_num=long, seconds_den=long, crc_ok=long, crc_bad=long, resyncs=long, skipped=long, table_kind=T.StringType(), table_frames=long, table_bytes=long, toc=ints, offsets=ints)

    def run(batches):
        for batch in batches:
            found = [parse(x or b"") for x in batch.column(1).to_pylist()]
            h = [s.header for s in found]
            columns = [
                [list(s.tags.items()) for s in found], [x and x.version for x in h], [x and x.layer for x in h], [x and x.rate for x in h], [x and x.channels for x in h],
                [len(s.offsets) for s in found], [s.samples for s in found], [s.duration.numerator for s in found], [s.duration.denominator for s in found],
                [s.crc_ok for s in found], [s.crc_bad for s in found], [s.resyncs for s in found], [s.skipped for s in found],
                [s.vbr.get("kind") for s in found], [s.vbr.get("frames") for s in found], [s.vbr.get("bytes") for s in found], [s.vbr.get("toc", []) for s in found], [s.offsets for s in found],
            ]
            kinds = [pa.map_(pa.string(), pa.string()), *[pa.int64()] * 12, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return media.select(media[id_col].alias("id"), media[media_col].alias("media")).mapInArrow(run, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a stream, read the stored bytes back, and keep digests and features.

    Result: id_col, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long (of the last 32 payload
    bytes), media_bytes long, media_sha256 string, feature string, a row per input row. Null counts as the empty
    text, whose payload is one unit of bytes 255. A very long text is one stream, built and read in one worker in about
    six times its bytes. Equal texts give equal values, so there are no ties to break; repeated rows and null ids are
    rows like others; columns besides the two named are not read; an empty table gives no rows.
    """
    bound_arrow(docs.sparkSession)
    long, string = T.LongType(), T.StringType()
    schema = _schema(docs, id_col, n_bytes=long, payload_bytes=long, payload_sha256=string, tail_crc32=long, media_bytes=long, media_sha256=string, feature=string)

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                payload = pad(raw)
                media = store_payload(payload)
                stream = parse(media)
                back = read_payload(media, stream)
                if back != payload:
                    raise ValueError("a stored stream doesn't give its payload back")
                rows.append((len(raw), len(back), sha(back), zlib.crc32(back[-32:]), len(media), sha(media), feature(stream)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
