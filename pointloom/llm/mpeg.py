"""MPEG audio columns: reading any stream of Layer I, II or III frames, and a stream that carries bytes.

The reader finds frame headers by resynchronising (a header counts if the next frame, or the end, follows where it says),
steps over ID3v2, ID3v1 and APE tags, reads Xing/Info and VBRI tables, checks the CRC of protected frames (Layers I and III;
what Layer II protects depends on its allocation tables and is not checked) and gives exact durations (samples over sample rate)
and the byte offset of every frame. A tag at the end is one only where no frame reaches: frames may carry any bytes.

The writer lays a payload out as MPEG-2 Layer III frames of 576 samples at 16 kHz, 144 kbit/s: 648 bytes with header, CRC, an
empty side information (so that a decoder plays silence) and 576 payload bytes as ancillary data, one for each sample. Before
them stand an ID3v2 tag with the payload's size and a Xing frame with a table of contents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
# Fixed values of the standard: kbit/s by index, for version 1 layers I, II, III and version 2 layer I, then II and III.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: float  # 1, 2 or 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    samples: int
    size: int  # bytes of the frame, header included
    side: int  # bytes of Layer III side information


def _header(word: int) -> Header | None:
    """A frame header from its 32 bits; None if it isn't one (free-format streams count as none)."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    kbps = BITRATES[family, layer if family == 1 else min(layer, 2)][index]
    hz = int(RATES[rate] / {1: 1, 2: 2, 2.5: 4}[version])
    samples = 384 if layer == 1 else 576 if layer == 3 and family == 2 else 1152
    pad = word >> 9 & 1
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = word >> 6 & 3 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if family == 1 else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, kbps, hz, 1 if mono else 2, samples, size, side)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005) & 0xFFFF if x & 0x8000 else x << 1
        out.append(x)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005 from 0xFFFF."""
    x = 0xFFFF
    for b in data:
        x = (x << 8 & 0xFF00) ^ _CRC[x >> 8 ^ b]
    return x


@dataclass
class Stream:
    """What parse() finds. ``offsets`` are of audio frames; the frame with the variable-bitrate table is none."""

    tags: dict[str, str] = field(default_factory=dict)
    tail: int = 0  # bytes of the tags at the end
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    protected: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    skipped: int = 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Bytes of an ID3v2 tag at the start, its text frames added to ``tags``; 0 if there is none."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] == 0xFF or max(data[6:10]) > 127:
        return 0
    end = 10 + _syncsafe(data[6:10])
    at, wide = 10, data[3] >= 3
    while at + (10 if wide else 6) <= min(end, len(data)) and data[at]:
        name = data[at : at + (4 if wide else 3)].decode("latin-1")
        if wide:
            n = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        else:
            n = int.from_bytes(data[at + 3 : at + 6], "big")
        at += 10 if wide else 6
        body = data[at : min(at + n, end)]
        if name[:1] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            tags[name] = body[1:].decode(code, "replace").strip("\0").replace("\0", "=")
        at += n
    return end + (10 if data[5] & 16 else 0)


def _tags_at_end(data: bytes) -> list[int]:
    """Where an APE tag, an ID3v1 tag or both may begin that end the stream: the longest first."""
    end, starts = len(data), []
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        starts.append(end)
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        start = end - int.from_bytes(data[end - 20 : end - 16], "little") - (32 if data[end - 9] & 0x80 else 0)
        if 0 <= start <= end - 32:
            starts.insert(0, start)
    return starts


def _id3v1(data: bytes, tags: dict[str, str]) -> None:
    end = len(data) - 128
    if end >= 0 and data[end : end + 3] == b"TAG":
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[name] = text


def _allocation(last: int, h: Header) -> int:
    """Bytes of a Layer I frame's bit allocation, from the header's last byte: four bits for each subband of each channel,
    one channel's alone from the bound of joint stereo on."""
    bound = 4 * ((last >> 4 & 3) + 1) if last >> 6 == 1 else 32
    return 16 if h.channels == 1 else (bound + 32) // 2


def _vbr(frame: bytes, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table in a frame's body, if it holds one."""
    at = 4 + h.side + (2 if h.protected and frame[4 + h.side : 8 + h.side] not in (b"Xing", b"Info") else 0)
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out: dict[str, object] = {"kind": frame[at : at + 4].decode()}
        flags = int.from_bytes(frame[at + 4 : at + 8], "big")
        at += 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                part = frame[at : at + n]
                out[name] = list(part) if name == "toc" else int.from_bytes(part, "big")
                at += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, delay, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
        step = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "delay": delay, "quality": quality, "bytes": size, "frames": frames, "each": each, "steps": step}
    return {}


def parse(data: bytes) -> Stream:
    """All frames, tags and tables of a stream; bytes that belong to none are skipped and counted. Any input is read."""
    out = Stream()
    at, end = _id3v2(data, out.tags), len(data)
    tail = _tags_at_end(data)
    known: dict[bytes, Header | None] = {}
    checks: dict[bytes, int] = {}
    in_step, seconds = False, {}

    def header(i: int) -> Header | None:
        b = data[i : i + 4]
        if b not in known:
            if len(known) > 4096:
                known.clear()
            known[b] = _header(int.from_bytes(b, "big")) if len(b) == 4 else None
        return known[b]

    while at + 4 <= end and at not in tail:
        h = header(at)
        # out of step a header counts only if a like one, or the end, follows where it says
        if h and not in_step:
            after = at + h.size
            g = header(after) if after + 4 <= end else None
            if not (after == end or after in tail or g and (g.version, g.layer, g.rate) == (h.version, h.layer, h.rate)):
                h = None
        if h is None or at + h.size > end:
            if in_step:
                out.resyncs += 1
                in_step = False
            new = data.find(b"\xff", at + 1, end)
            new = min([end if new < 0 else new, *(t for t in tail if t > at)])
            out.skipped += new - at
            at = new
            continue
        in_step = True
        if h.protected and h.layer != 2:
            out.protected += 1
            told = data[at + 2 : at + 6 + (h.side if h.layer == 3 else _allocation(data[at + 3], h))]
            if told not in checks:
                if len(checks) > 4096:
                    checks.clear()
                checks[told] = crc16(told[:2] + told[4:])
            out.bad_crc += checks[told] != int.from_bytes(told[2:4], "big")
        if not out.offsets and not out.table and (table := _vbr(data[at : at + h.size], h)):
            out.table = table
        else:
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.headers.append(h)
            seconds[h.rate] = seconds.get(h.rate, 0) + h.samples
        at += h.size
    if at in tail:
        out.tail = end - at
        _id3v1(data, out.tags)
    else:
        out.skipped += max(0, end - at)
    out.duration = sum((Fraction(n, rate) for rate, n in seconds.items()), Fraction(0))
    return out


#: Version 2, layer III, protected, 144 kbit/s (index 13), 16 kHz, stereo.
_WORD = 0x7FF << 21 | 2 << 19 | 1 << 17 | 13 << 12 | 2 << 10
_OWN = _header(_WORD)
_HEAD = _WORD.to_bytes(4, "big")
_START = _HEAD + crc16(_HEAD[2:] + bytes(_OWN.side)).to_bytes(2, "big") + bytes(_OWN.side)
_DATA = len(_START)
_TAIL = bytes(_OWN.size - _DATA - UNIT)


def write(payload: bytes) -> bytes:
    """A stream whose frames carry the payload (a multiple of UNIT bytes)."""
    if len(payload) % UNIT:
        raise ValueError(f"the payload must be a multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    size = f"payload\0{len(payload)}".encode("latin-1")
    frame = b"TXXX" + (len(size) + 1).to_bytes(4, "big") + b"\0\0" + b"\0" + size
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 127 for s in (21, 14, 7, 0)) + frame
    toc = bytes(min(255, (_OWN.size + i * n // 100 * _OWN.size) * 256 // (_OWN.size * (n + 1))) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * _OWN.size).to_bytes(4, "big") + toc
    first = (_START + xing).ljust(_OWN.size, b"\0")
    parts = [tag, first]
    for at in range(0, len(payload), UNIT):
        parts += [_START, payload[at : at + UNIT], _TAIL]
    return b"".join(parts)


def read_payload(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload that write() laid out, from the frames that parse() finds."""
    stream = stream or parse(data)
    body = b"".join([data[at + _DATA : at + _DATA + UNIT] for at in stream.offsets])
    size = stream.tags.get("TXXX", "").partition("payload=")[2]
    return body[: int(size)] if size.isdigit() else body


def to_payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def describe(stream: Stream) -> str:
    """The features of a stream in one line."""
    rates = sorted({h.kbps for h in stream.headers})
    return f"frames={len(stream.offsets)};seconds={stream.duration};kbps={'/'.join(map(str, rates))};table={stream.table.get('kind', '-')}:{stream.table.get('frames', '-')};crc={stream.protected - stream.bad_crc}/{stream.protected};resyncs={stream.resyncs};first={stream.offsets[0] if stream.offsets else '-'};last={stream.offsets[-1] if stream.offsets else '-'}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            media = pa.array([write(to_payload(x.as_py())) for x in batch.column(1)], pa.binary())
            n = pa.array([len((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, media], ["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, ``n_bytes`` of its text and the ``media`` that carries it. A null text is stored as an empty one.

    Texts are stored whole, however long; rows that repeat and null ids pass as they are, equal texts give equal media; other
    columns are left out, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse(x.as_py() or b"") for x in batch.column(1)]
        cols = {
            "n_frames": pa.array([len(s.offsets) for s in found], pa.int64()),
            "samples": pa.array([sum(h.samples for h in s.headers) for s in found], pa.int64()),
            "duration_num": pa.array([s.duration.numerator for s in found], pa.int64()),
            "duration_den": pa.array([s.duration.denominator for s in found], pa.int64()),
            "offsets": pa.array([s.offsets for s in found], pa.list_(pa.int64())),
            "tags": pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string())),
            "table_kind": pa.array([s.table.get("kind") for s in found], pa.string()),
            "protected": pa.array([s.protected for s in found], pa.int64()),
            "bad_crc": pa.array([s.bad_crc for s in found], pa.int64()),
            "resyncs": pa.array([s.resyncs for s in found], pa.int64()),
            "skipped": pa.array([s.skipped for s in found], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols.values()], ["id", *cols])


def probe(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """What a media column holds: frames, exact duration as a fraction of seconds, seek offsets, tags, table and checks.

    A null or empty cell has no frames; bytes that are no MPEG audio are skipped and counted.
    """
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_probe, f"id {kind}, n_frames long, samples long, duration_num long, duration_den long, offsets array<long>, tags map<string,string>, table_kind string, protected long, bad_crc long, resyncs long, skipped long")
    return out.withColumnRenamed("id", id_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for x in batch.column(2):
            media = x.as_py()
            if media is None:
                rows.append((None,) * 6)
                continue
            stream = parse(media)
            payload = read_payload(media, stream)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(stream)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)


def media_digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored media back: digests of payload and media, and the features of the stream.

    A null media cell gives nulls; bytes that are no MPEG audio, an empty cell too, give an empty payload. Rows that repeat
    and null ids pass as they are; other columns are left out; an empty table gives an empty one.
    """
    rows = stored.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_digest, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
