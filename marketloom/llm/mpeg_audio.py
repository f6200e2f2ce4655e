"""Media columns: MPEG audio frames, parsed and written.

``parse`` reads any bytes: it skips and reads tags, finds frame headers (again after damage),
reads variable-bitrate tables, verifies frame checksums and gives the exact duration as a
count of samples and the byte offset of every frame. ``store`` writes a payload losslessly as
the main data of checksummed MPEG-1 Layer III frames behind a tag and a variable-bitrate
table; ``payload`` reads it back out of the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks

# Fixed values of the MPEG audio format: bitrates in kbit/s by (version 1?, layer), sample
# rates in Hz of version 1 (halved for version 2, quartered for 2.5).
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
UNIT = 192


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    checked: bool
    kbps: int
    rate: int
    channels: int
    samples: int
    size: int
    side: int
    joint: int | None = None

    @property
    def body(self) -> int:
        """Where the main data begin in the frame."""
        return 4 + 2 * self.checked + self.side


@lru_cache(maxsize=4096)
def header(word: int, free: int = 0) -> Header | None:
    """The frame header in 32 bits, or None if they are not one; of a frame in free format the size must be given.

    ``joint`` is the first subband that both channels share, where they do.
    """
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate, slot = word >> 10 & 3, word >> 12 & 15
    if version is None or layer == 4 or rate == 3 or slot == 15 or (slot == 0 and not free) or word & 3 == 2:
        return None
    one = version == 1
    kbps = BITRATES[one, layer][slot - 1] if slot else 0
    hz = RATES[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    pad = word >> 9 & 1
    mono = word >> 6 & 3 == 3
    samples = 384 if layer == 1 else 1152 if one or layer == 2 else 576
    size = free if not slot else (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
    joint = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else None
    return Header(version, layer, not word >> 16 & 1, kbps, hz, 1 if mono else 2, samples, size, side, joint)


#: Bits of the allocation of each subband of Layer II, by table.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 1:
        return ALLOCATION["low"]
    each = h.kbps // h.channels
    if 0 < each < 56:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if h.rate == 48000 or 0 < each < 96 else "b"]


def _protected(data: bytes, at: int, h: Header) -> tuple[int, int]:
    """The bits that a frame's checksum covers, as a number and its length: the header's last half and the side information or allocation."""
    start = at + 6
    if h.layer == 3:
        body = data[start : start + h.side]
        return int.from_bytes(data[at + 2 : at + 4] + body, "big"), 16 + 8 * len(body)
    frame = data[start : at + h.size]
    bits, total = int.from_bytes(frame, "big"), 8 * len(frame)
    read = lambda p, n: bits >> max(total - p - n, 0) & ((1 << n) - 1)
    p, given = 0, 0
    for band, n in enumerate(_allocation(h)):
        for channel in range(1 if h.joint is not None and band >= h.joint else h.channels):
            # scale factor selections of Layer II follow for every channel of a subband in use
            shared = h.channels if h.joint is not None and band >= h.joint else 1
            given += (read(p, n) > 0) * shared
            p += n
    p += 2 * given if h.layer == 2 else 0
    return int.from_bytes(data[at + 2 : at + 4], "big") << p | read(0, p), 16 + p


def bit_checksum(bits: int, n: int) -> int:
    """``checksum`` of the first ``n`` bits of a number's binary form, which need not be whole bytes."""
    crc = 0xFFFF
    for i in range(n - 1, -1, -1):
        crc = (crc << 1 ^ (0x18005 if (crc >> 15 ^ bits >> i) & 1 else 0)) & 0xFFFF
    return crc


def checksum(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, highest bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = crc << 1 ^ (0x18005 if crc & 0x8000 else 0)
    return crc


_checks: dict[bytes, int] = {}


def _checksum(data: bytes) -> int:
    got = _checks.get(data)
    if got is None:
        if len(_checks) > 100_000:
            _checks.clear()
        got = _checks[data] = checksum(data)
    return got


@dataclass
class Audio:
    """What ``parse`` finds. Offsets, sizes and samples of frames without the table's own frame."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    skipped: int = 0
    checked: int = 0
    failed: list[int] = field(default_factory=list)

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> Fraction:
        """Exact seconds."""
        out: dict[int, int] = {}
        for h in self.headers:
            out[h.rate] = out.get(h.rate, 0) + h.samples
        return sum((Fraction(n, rate) for rate, n in out.items()), Fraction(0))


def _sync_safe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """The length of the tag at the start; its text frames go to ``tags``."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = 10 + _sync_safe(data[6:10])
    major, flags = data[3], data[5]
    tag = data[10:end]
    if flags & 128 and major < 4:
        tag = tag.replace(b"\xff\0", b"\xff")  # a zero after each 0xFF hid it from frame search
    at = 0
    if flags & 64 and major >= 3 and len(tag) >= 4:
        at = _sync_safe(tag[:4]) if major == 4 else 4 + int.from_bytes(tag[:4], "big")
    # version 2.2 has names and sizes of three bytes and no flags
    name, head = (3, 6) if major < 3 else (4, 10)
    while at + head <= len(tag) and tag[at : at + name].isalnum():
        raw = tag[at + name : at + 2 * name]
        size = _sync_safe(raw) if major == 4 else int.from_bytes(raw, "big")
        if size <= 0 or at + head + size > len(tag):
            break
        if tag[at : at + 1] == b"T":
            body = tag[at + head : at + head + size]
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[tag[at : at + name].decode()] = body[1:].decode(code, "replace").rstrip("\0")
        at += head + size
    return end + (10 if flags & 16 else 0)


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    frame = data[at : at + h.size]
    start = 4 + h.side  # by convention counted without the checksum
    for where in (start, start + 2 * h.checked):
        if frame[where : where + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[where + 4 : where + 8], "big"), where + 8
            out: dict = {"kind": frame[where : where + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 58:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62]) if len(frame) >= 62 else (*struct.unpack(">II", frame[46:54]), 0, 0, 0, 0)
        raw = frame[62 : 62 + entries * width] if width else b""
        # bytes of each run of ``frames_each`` frames
        steps = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw) - width + 1, width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "frames_each": per, "steps": steps}
    return None


def _free_size(data: bytes, at: int, end: int, word: int, known: int) -> int:
    """The size of a frame in free format: up to the next header like it; of a last frame, that of the ones before. 0 if there is none."""
    like = word & 0xFFFFFC00 & ~0x200
    found = data.find(b"\xff", at + 24, end)
    while 0 <= found <= end - 4:
        other = int.from_bytes(data[found : found + 4], "big")
        if other & 0xFFFFFC00 & ~0x200 == like and not other >> 12 & 15:
            return found - at
        found = data.find(b"\xff", found + 1, end)
    return known if known and at + known <= end else 0


def parse(data: bytes) -> Audio:
    """All frames of ``data``. A frame counts if its header is followed by another header, a tag or the end.

    Frames in free format are as long as the way to the next header of their kind. Checksums
    are verified for all three layers.
    """
    out = Audio()
    at, end = _id3v2(data, out.tags), len(data)
    if data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            out.tags.setdefault(name, data[end + lo : end + hi].rstrip(b"\0 ").decode("latin-1"))
    in_step = False
    free = 0
    while at + 4 <= end:
        word = int.from_bytes(data[at : at + 4], "big")
        if word >> 21 == 0x7FF and not word >> 12 & 15:
            free = _free_size(data, at, end, word, free)
        h = header(word, free)
        after = at + h.size if h else 0
        if h and after <= end and (in_step or after >= end - 3 or header(int.from_bytes(data[after : after + 4], "big"), free)):
            if not out.headers and out.table is None and (table := _vbr(data, at, h)):
                out.table = table
            else:
                out.offsets.append(at)
                out.headers.append(h)
                if h.checked:
                    out.checked += 1
                    own = _checksum(data[at + 2 : at + 4] + data[at + 6 : at + h.body]) if h.layer == 3 else bit_checksum(*_protected(data, at, h))
                    if own != int.from_bytes(data[at + 4 : at + 6], "big"):
                        out.failed.append(len(out.offsets) - 1)
            at, in_step = after, True
            continue
        in_step = False
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        out.skipped += found - at
        at = found
    out.skipped += max(0, end - at)
    return out


def _word(kbps: int) -> int:
    """A checksummed mono frame of MPEG-1 Layer III at 32 kHz."""
    return 0xFFFA0000 | (BITRATES[True, 3].index(kbps) + 1) << 12 | RATES.index(32000) << 10 | 3 << 6


#: Units of payload that fit a frame, by bitrate.
FITS = {k: (header(_word(k)).size - header(_word(k)).body) // UNIT for k in BITRATES[True, 3]}
MOST = FITS[320]
_RATE_OF = {n: min(k for k, m in FITS.items() if m >= n) for n in range(1, MOST + 1)}


@lru_cache(maxsize=64)
def _start(kbps: int, units: int) -> bytes:
    """Header, checksum and side information; the latter's first byte holds the units of payload."""
    word = _word(kbps).to_bytes(4, "big")
    side = bytes([units]) + bytes(16)
    return word + checksum(word[2:] + side).to_bytes(2, "big") + side


def store(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of ``UNIT`` bytes) as an MPEG audio file."""
    units = len(payload) // UNIT
    if units * UNIT != len(payload) or not units:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    full, rest = divmod(units, MOST)
    size = header(_word(320)).size
    body = np.zeros((full, size), np.uint8)
    first = _start(320, MOST)
    body[:, : len(first)] = np.frombuffer(first, np.uint8)
    body[:, len(first) : len(first) + MOST * UNIT] = np.frombuffer(payload, np.uint8, full * MOST * UNIT).reshape(full, MOST * UNIT)
    tail = b""
    if rest:
        start = _start(_RATE_OF[rest], rest)
        tail = (start + payload[full * MOST * UNIT :]).ljust(header(_word(_RATE_OF[rest])).size, b"\0")
    frames = full + bool(rest)
    info = header(_word(96))
    total = info.size + full * size + len(tail)
    # where a hundredth of the playing time is, in 256ths of the bytes
    ends = [info.size + min(i * frames // 100, full) * size for i in range(100)]
    toc = bytes(min(255, e * 256 // total) for e in ends)
    table = _start(96, 0) + b"Xing" + struct.pack(">III", 7, frames, total) + toc
    return _tag() + table.ljust(info.size, b"\0") + body.tobytes() + tail


@lru_cache(maxsize=1)
def _tag() -> bytes:
    text = b"\x03payload"
    frame = b"TIT2" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
    return b"ID3\x04\0\0" + bytes([0, 0, 0, len(frame)]) + frame


def payload(data: bytes, audio: Audio | None = None) -> bytes:
    """The payload of what ``store`` wrote."""
    audio = audio or parse(data)
    if audio.failed:
        raise ValueError(f"frame {audio.failed[0]} fails its checksum")
    return b"".join(data[at + h.body : at + h.body + UNIT * data[at + 6]] for at, h in zip(audio.offsets, audio.headers))


def feature(audio: Audio) -> str:
    """Exact duration, frames, table, checksums and a digest of the seek offsets, as text."""
    d = audio.duration
    seek = zlib.crc32(np.array(audio.offsets, "<u8").tobytes())
    table = audio.table or {}
    return f"seconds={d.numerator}/{d.denominator};samples={audio.samples};frames={len(audio.offsets)};table={table.get('kind')}:{table.get('frames')};checked={audio.checked};failed={len(audio.failed)};skipped={audio.skipped};seek={seek:08x}"


AUDIO = "duration_num long, duration_den long, samples long, frames int, skipped long, checked int, failed int, tags map<string,string>, offsets array<long>"


def read_audio(files: DataFrame, *, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and what ``parse`` finds of a binary column: exact duration, tags, checks and seek offsets.

    Null and empty media have no frames and a duration of 0/1; bytes that are no audio are skipped.
    """

    def run(batches):
        for batch in batches:
            got = [parse(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            rows = [(a.duration.numerator, a.duration.denominator, a.samples, len(a.offsets), a.skipped, a.checked, len(a.failed), list(a.tags.items()), a.offsets) for a in got]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], *[c.split()[0] for c in AUDIO.split(", ")]])

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, media).mapInArrow(run, f"{schema}, {AUDIO}")


def text_to_audio(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): every row's text, padded by spaces to a positive multiple of ``UNIT`` bytes, as ``store`` writes it. Null: empty."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch.column(1), 1 << 21):
                raw = data.tobytes()
                out = [store(padded(raw[bounds[i] : bounds[i + 1]])) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], [key, "media"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, media binary")


def padded(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def media_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, duration_num, duration_den, seek_offsets) of every row.

    The text is stored as ``text_to_audio`` does, and everything but n_bytes is computed from
    the stored bytes, read back. Null and empty texts are one unit of spaces. Equal texts give
    equal values, rows are neither merged nor dropped, null keys stay null, other columns are
    ignored; an empty table gives an empty result. The duration in seconds is exact, as a
    fraction; seek_offsets are the bytes at which frames begin. One pass, no shuffle; a task
    holds about 2 MB of texts (or one text) at a time.
    """
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_num", "duration_den", "seek_offsets"]

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch.column(1), 1 << 21):
                rows = []
                for i in range(hi - lo):
                    stored = store(padded(data[bounds[i] : bounds[i + 1]].tobytes()))
                    audio = parse(stored)
                    back = payload(stored, audio)
                    rows.append((int(bounds[i + 1] - bounds[i]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(audio), audio.duration.numerator, audio.duration.denominator, audio.offsets))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, seek_offsets array<long>")
