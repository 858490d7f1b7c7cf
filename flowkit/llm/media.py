"""MPEG audio columns: writing bytes as a valid frame stream, and reading any stream back.

``store`` keeps bytes losslessly as an MPEG-1 Layer III stream: an ID3v2 tag, a
Xing frame with the frame count, byte count and seek table, then mono 48 kHz
frames of variable bit rate with CRC-16, whose side information says "silence"
and whose ancillary space holds the bytes. ``read`` takes any MPEG-1, 2 or 2.5
stream of layers I to III: it skips and parses ID3 tags, finds frame headers
(and finds them again after damage: a header counts if the one that should
follow it is there too, or the stream ends), parses Xing and VBRI tables,
verifies the CRC of frames of all three layers, and gives the exact duration in samples
and the offset of every frame. Free-format streams (bit rate index 0) are not
recognised as frames.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# Bit rates in kbit/s by (MPEG version 1?, layer) and index, sample rates by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Header(NamedTuple):
    length: int
    samples: int
    rate: int
    layer: int
    kind: int  # bits that stay the same through a stream: version, layer, sample rate
    crc: bool
    side: int  # bytes of Layer III side information
    channels: int
    bound: int  # subbands below it have an allocation for each channel
    allocations: tuple[int, ...]  # bits of a subband's allocation, layers I and II


@lru_cache(4096)
def header(bits: int) -> Header | None:
    """The frame header in these 32 bits, or None."""
    version, layer = bits >> 19 & 3, 4 - (bits >> 17 & 3)
    index, rate = bits >> 12 & 15, bits >> 10 & 3
    if bits >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first = version == 3
    hertz = SAMPLE_RATES[version][rate]
    bps, pad = BITRATES[first, layer][index] * 1000, bits >> 9 & 1
    if layer == 1:
        length, samples = (12 * bps // hertz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or first else 576
        length = samples // 8 * bps // hertz + pad
    mono = bits >> 6 & 3 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    allocations = () if layer == 3 else (4,) * 32 if layer == 1 else _layer2_bits(first, hertz, bps // (1000 if mono else 2000))
    bound = 0 if mono else min(len(allocations), 4 * (bits >> 4 & 3) + 4) if bits >> 6 & 3 == 1 else len(allocations)
    return Header(length, samples, hertz, layer, bits & 0xFFFE0C00, not bits >> 16 & 1, side, 1 if mono else 2, bound, allocations)


# Runs of (bits, subbands) of the Layer II allocation tables; the last is that of MPEG-2.
LAYER2_TABLES = (((4, 11), (3, 12), (2, 4)), ((4, 11), (3, 12), (2, 7)), ((4, 2), (3, 6)), ((4, 2), (3, 10)), ((4, 4), (3, 7), (2, 19)))


def _layer2_bits(first: bool, hertz: int, rate: int) -> tuple[int, ...]:
    """The allocation table of Layer II for the kbit/s of one channel."""
    if not first:
        which = 4
    elif rate <= 48:
        which = 3 if hertz == 32000 else 2
    else:
        which = 0 if hertz == 48000 or rate <= 80 else 1
    return tuple(bits for bits, n in LAYER2_TABLES[which] for _ in range(n))


def protected(frame: bytes, h: Header) -> tuple[int, int]:
    """(number, how many bits) of what a frame's CRC covers behind its header: side information, or allocations and scale factor choices."""
    if h.layer == 3:
        return int.from_bytes(frame[6 : 6 + h.side], "big"), 8 * h.side
    body, at, used = int.from_bytes(frame[6:134], "big"), 8 * len(frame[6:134]), 0
    for sub, n in enumerate(h.allocations):
        each = h.channels if sub < h.bound else 1
        for _ in range(each):
            at -= n
            used += (body >> at & (1 << n) - 1 > 0) * (h.channels if each == 1 else 1) if at >= 0 else 0
    at = max(0, at - (2 * used if h.layer == 2 else 0))
    size = 8 * len(frame[6:134]) - at
    return body >> at, size


@lru_cache(65536)
def crc16(number: int, bits: int) -> int:
    """CRC-16 of the low ``bits`` of a number with the polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for i in range(bits - 1, -1, -1):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ number >> i) & 1 else crc << 1) & 0xFFFF
    return crc


def frame_crc(frame: bytes, h: Header) -> int:
    number, bits = protected(frame, h)
    return crc16(int.from_bytes(frame[2:4], "big") << bits | number, 16 + bits)


_SIDE = bytes(17)
_ROOM = 4 + 2 + len(_SIDE)


@lru_cache(16)
def _frame_head(index: int) -> bytes:
    """Header, CRC and silent side information of a mono 48 kHz Layer III frame."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return head + struct.pack(">H", frame_crc(head + b"\0\0" + _SIDE, header(int.from_bytes(head, "big")))) + _SIDE


def _sized(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def to_stream(payload: bytes) -> bytes:
    """``payload`` as an MPEG stream."""
    rates = BITRATES[True, 3]
    room = 3 * rates[14] - _ROOM
    whole, rest = divmod(len(payload), room)
    sizes = [3 * rates[14]] * whole
    frames = np.zeros((whole, 3 * rates[14]), np.uint8)
    frames[:, :_ROOM] = np.frombuffer(_frame_head(14), np.uint8)
    frames[:, _ROOM:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
    body = frames.tobytes()
    if rest or not whole:
        index = next(i for i in range(1, 15) if 3 * rates[i] - _ROOM >= rest)
        sizes.append(3 * rates[index])
        body += (_frame_head(index) + payload[whole * room :]).ljust(sizes[-1], b"\0")
    first = 3 * rates[5]
    total, starts = first + len(body), first + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    toc = bytes(min(255, int(starts[len(sizes) * i // 100]) * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(sizes), total) + toc + struct.pack(">I", 0)
    xing = (bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]) + _SIDE + table).ljust(first, b"\0")
    notes = b"".join(b"TXXX" + struct.pack(">I", 1 + len(x)) + b"\0\0\0" + x for x in (b"payload_bytes\0%d" % len(payload), b"payload_crc32\0%08x" % zlib.crc32(payload)))
    return b"ID3\3\0\0" + _sized(len(notes)) + notes + xing + body


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text fields of ID3v2 and ID3v1 tags, and where the audio between them begins and ends."""
    found, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        size = 0
        for x in data[begin + 6 : begin + 10]:
            size = size << 7 | x & 127
        at, stop, v4 = begin + 10, min(begin + 10 + size, len(data)), data[begin + 3] == 4
        while at + 10 <= stop and data[at : at + 4].isalnum() and data[begin + 3] in (3, 4):
            raw = data[at + 4 : at + 8]
            n = (raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]) if v4 else int.from_bytes(raw, "big")
            name, value = data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + n, stop)]
            if name[0] == "T" and value:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
                text = value[1:].decode(coding, "replace").rstrip("\0")
                key, _, text = text.partition("\0") if name == "TXXX" else (name, "", text)
                found[key] = text
            at += 10 + n
        begin = stop
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                found.setdefault(key, text)
    return found, begin, end


def _table(frame: bytes, side: int) -> dict | None:
    """The Xing, Info or VBRI table of a frame."""
    for at, names in ((4 + side, (b"Xing", b"Info")), (36, (b"VBRI",))):
        if frame[at : at + 4] in names and len(frame) >= at + 18:
            if names[0] == b"VBRI":
                size, frames = struct.unpack(">II", frame[at + 10 : at + 18])
                return {"frames": frames, "bytes": size, "toc": b""}
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"frames": None, "bytes": None, "toc": b""}
            for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    out[key] = frame[at : at + n] if key == "toc" else int.from_bytes(frame[at : at + n], "big")
                    at += n
            return out
    return None


def from_stream(data: bytes) -> dict:
    """Everything that ``read`` gives of one stream."""
    tags, at, end = _tags(data)
    out = {"tags": tags, "layer": None, "sample_rate": None, "samples": 0, "offsets": [], "crc_checked": 0, "crc_failed": 0, "skipped": 0, "vbr_frames": None, "vbr_bytes": None, "toc": b""}
    kept, kind, seen = [], None, False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h and kind is None:
            after = at + h.length
            if after < end:
                h2 = header(int.from_bytes(data[after : after + 4], "big"))
                h = h if h2 and h2.kind == h.kind else None
        if not h or kind not in (None, h.kind) or at + h.length > end:
            kind, nxt = None, data.find(b"\xff", at + 1, end)
            out["skipped"] += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        frame, kind = data[at : at + h.length], h.kind
        if not seen:
            seen = True
            out["layer"], out["sample_rate"] = h.layer, h.rate
            if table := _table(frame, h.side):
                out["vbr_frames"], out["vbr_bytes"], out["toc"] = table["frames"], table["bytes"], table["toc"]
                at += h.length
                continue
        if h.crc:
            out["crc_checked"] += 1
            out["crc_failed"] += frame_crc(frame, h) != int.from_bytes(frame[4:6], "big")
        kept.append(frame[4 + 2 * h.crc + h.side :])
        out["offsets"].append(at)
        out["samples"] += h.samples
        at += h.length
    out["skipped"] += max(0, end - at)
    size = tags.get("payload_bytes", "")
    out["payload"] = b"".join(kept)[: int(size)] if size.isdigit() else None
    out["payload_ok"] = None if out["payload"] is None else len(out["payload"]) == int(size) and f"{zlib.crc32(out['payload']):08x}" == tags.get("payload_crc32")
    return out


def store():
    """Column function: bytes -> an MPEG stream that holds them; null: the stream of no bytes."""

    @F.arrow_udf("binary")
    def store(payloads: pa.Array) -> pa.Array:
        return pa.array([to_stream(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in payloads], pa.binary())

    return store


_TYPES = {
    "tags": pa.map_(pa.string(), pa.string()),
    "layer": pa.int32(),
    "sample_rate": pa.int32(),
    "samples": pa.int64(),
    "offsets": pa.list_(pa.int64()),
    "crc_checked": pa.int64(),
    "crc_failed": pa.int64(),
    "skipped": pa.int64(),
    "vbr_frames": pa.int64(),
    "vbr_bytes": pa.int64(),
    "toc": pa.binary(),
    "payload": pa.binary(),
    "payload_ok": pa.bool_(),
}
_SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary", pa.bool_(): "boolean", pa.map_(pa.string(), pa.string()): "map<string,string>"}


def read(*fields: str):
    """Column function: an MPEG stream -> its tags, frames, duration, seek offsets, checks and stored bytes.

    ``fields`` names those of them that are wanted (without names: all), so
    that payloads and tables that nobody reads do not leave the task. A null or
    empty stream, or one without frames, has no layer and 0 samples. payload is
    null for streams that ``store`` did not write.
    """
    wanted = {k: _TYPES[k] for k in fields or _TYPES}

    @F.arrow_udf(f"struct<{','.join(f'{k}:{_SQL_TYPES[t]}' for k, t in wanted.items())}>")
    def read(streams: pa.Array) -> pa.Array:
        columns: dict[str, list] = {k: [] for k in wanted}
        for x in streams:
            facts = from_stream(x.as_buffer().to_pybytes() if x.is_valid else b"")
            facts["tags"] = list(facts["tags"].items())
            for k, column in columns.items():
                column.append(facts[k])
        return pa.StructArray.from_arrays([pa.array(columns[k], t) for k, t in wanted.items()], list(wanted))

    return read
