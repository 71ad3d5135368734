"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

``parse`` reads any MPEG-1/2/2.5 Layer I-III stream. It skips ID3v2 and ID3v1 tags,
reads a Xing/Info or VBRI table, follows frame headers by their own lengths and, where
a header is broken, resynchronises on the next one that another of the same kind (or
the end) follows. Layer III checksums are verified. The duration is exact: samples
over the sample rate; every audio frame's offset is kept for seeking.

``wrap`` stores bytes losslessly: one 240-byte Layer III frame (80 kbit/s, 48 kHz, mono,
with checksum) for each 192 bytes, which stand in the ancillary part of the frame, after
side information that claims no audio bits. The frame's own checksum covers its header
and side information only, so a CRC-32 of the 192 bytes follows them. An Info table with
seek points, an ID3v2 and an ID3v1 tag surround the frames. ``unwrap`` returns the bytes
and raises ValueError where they don't fit their CRC-32. ``feature`` tells what the medium
says, and statistics of the bytes read back as signed 8-bit samples.

Defined results: a null or empty medium has no frames, no rate and duration 0. Null and
empty texts are stored as one unit of spaces. Equal rows get equal values; extra
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from siftline.llm.common import map_batches, narrow

UNIT, FRAME, RATE, SAMPLES = 192, 240, 48_000, 1152
SIDE, DATA = 17, 4 + 2 + 17  # mono side information; where a frame's data start

# Fixed values of the format: kbit/s by header index 1-14, Hz by index 0-2, samples a frame.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
FRAME_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
VERSION = {0: 25, 2: 2, 3: 1}
LAYER = {1: 3, 2: 2, 3: 1}


@lru_cache(1)
def header_tables() -> tuple[np.ndarray, ...]:
    """By the header's second and third byte: frame bytes (0: invalid), Hz, samples, side bytes base."""
    size, hz, samples = (np.zeros(1 << 16, np.int32) for _ in range(3))
    for b1 in range(0xE0, 0x100):
        version, layer = VERSION.get(b1 >> 3 & 3), LAYER.get(b1 >> 1 & 3)
        if version is None or layer is None:
            continue
        family = 1 if version == 1 else 2
        for b2 in range(256):
            k, r, pad = b2 >> 4, b2 >> 2 & 3, b2 >> 1 & 1
            if not 1 <= k <= 14 or r == 3:
                continue
            rate, n = HZ[version][r], FRAME_SAMPLES[family, layer]
            bits = KBPS[family, layer][k - 1] * 1000
            at = b1 << 8 | b2
            size[at] = (12 * bits // rate + pad) * 4 if layer == 1 else n // 8 * bits // rate + pad
            hz[at], samples[at] = rate, n
    return size, hz, samples


@lru_cache(1)
def crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes, from 0xFFFF on."""
    table, crc = crc_table(), np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ table[(crc >> 8) ^ column]
    return crc


def seek_table(frames: int, total: int, first: int) -> bytes:
    """100 seek points: at each hundredth of the duration, the byte position in 256ths of the file."""
    at = first + np.arange(100, dtype=np.int64) * frames // 100 * FRAME
    return np.minimum(255, at * 256 // max(total, 1)).astype(np.uint8).tobytes()


def checks(payload: bytes) -> np.ndarray:
    """The CRC-32 of each unit as four bytes."""
    raw = memoryview(payload)
    return np.array([zlib.crc32(raw[i : i + UNIT]) for i in range(0, len(raw), UNIT)], ">u4").view(np.uint8).reshape(-1, 4)


def wrap(payload: bytes) -> bytes:
    """An MPEG audio file that carries the payload, a positive multiple of 192 bytes."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = np.array([0xFF, 0xFA, 0x64, 0xC4], np.uint8)  # MPEG-1 Layer III with checksum, 80 kbit/s, 48 kHz, mono
    frames = np.zeros((len(units) + 1, FRAME), np.uint8)
    frames[:, :4] = head
    check = int(crc16(np.concatenate((head[2:], np.zeros(SIDE, np.uint8)))[None])[0])
    frames[:, 4], frames[:, 5] = check >> 8, check & 255
    frames[1:, DATA : DATA + UNIT] = units
    frames[1:, DATA + UNIT : DATA + UNIT + 4] = checks(payload)
    audio = frames.size
    table = b"Info" + (7).to_bytes(4) + len(units).to_bytes(4) + audio.to_bytes(4) + seek_table(len(units), audio, FRAME)
    frames[0, DATA : DATA + len(table)] = np.frombuffer(table, np.uint8)
    text = b"\0siftline"
    tag = b"TSSE" + len(text).to_bytes(4) + b"\0\0" + text
    return b"ID3\3\0\0" + bytes([0, 0, len(tag) >> 7, len(tag) & 127]) + tag + frames.tobytes() + b"TAG".ljust(128, b"\0")


def id3v2_end(data: bytes, at: int = 0) -> int:
    """Where the ID3v2 tags at a place end."""
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = 0
        for b in data[at + 6 : at + 10]:
            size = size << 7 | b & 127
        at += 10 + size + 10 * bool(data[at + 5] & 16)
    return min(at, len(data))


def id3v2_frames(data: bytes) -> dict[str, int]:
    """Frame ids of a leading ID3v2.3/2.4 tag with their sizes in bytes."""
    out: dict[str, int] = {}
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (3, 4):
        return out
    at, end = 10, id3v2_end(data)
    while at + 10 <= end and data[at]:
        raw = data[at + 4 : at + 8]
        size = int.from_bytes(raw) if data[3] == 3 else sum((b & 127) << 7 * (3 - i) for i, b in enumerate(raw))
        out[data[at : at + 4].decode("latin-1")] = size
        at += 10 + size
    return out


def vbr_table(data: bytes, at: int, size: int, mono: bool, first_version: bool) -> dict:
    """The Xing/Info or VBRI table of a frame, if it holds one."""
    for protected in (0, 2):
        p = at + 4 + protected + ((17 if mono else 32) if first_version else (9 if mono else 17))
        if (kind := data[p : p + 4]) in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[p + 4 : p + 8]), p + 8
            out: dict = {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(data[p : p + 4]), p + 4
            if flags & 4:
                out["toc"], p = list(data[p : p + 100]), p + 100
            p += 4 * bool(flags & 8)
            if data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
                gap = int.from_bytes(data[p + 21 : p + 24])
                out |= {"delay": gap >> 12, "padding": gap & 0xFFF}
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        v = data[at + 36 :]
        n, scale, width = (int.from_bytes(v[i : i + 2]) for i in (18, 20, 22))
        steps = [int.from_bytes(v[26 + i * width : 26 + (i + 1) * width]) * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": int.from_bytes(v[10:14]), "frames": int.from_bytes(v[14:18]), "delay": int.from_bytes(v[6:8]), "toc": steps}
    return {}


def parse(data: bytes | None) -> dict:
    """Frames and what they say; ``offsets`` and ``sizes`` are those of audio frames."""
    data = data or b""
    d, size, hz, samples = np.frombuffer(data, np.uint8), *header_tables()
    start, end = id3v2_end(data), len(data) - 128 * (len(data) >= 128 and data[-128:-125] == b"TAG")
    sync = np.flatnonzero((d[: max(end - 3, 0)] == 0xFF) & (d[1 : max(end - 2, 1)] >= 0xE0)) if end > 3 else np.zeros(0, int)
    code = d[sync + 1].astype(np.int32) << 8 | d[sync + 2]
    keep = (size[code] > 0) & (sync >= start) & (sync + size[code] <= end)
    sync, code = sync[keep], code[keep]
    after = np.minimum(np.searchsorted(sync, sync + size[code]), max(len(sync) - 1, 0))
    kind = code & 0xFE0C  # version, layer and sample rate
    linked = (sync[after] == sync + size[code]) & (kind[after] == kind) if len(sync) else np.zeros(0, bool)
    last = sync + size[code] == end
    step, good, ends = after.tolist(), (linked | last).tolist(), (sync + size[code]).tolist()
    chain, resyncs, skipped, at, i, n = [], 0, 0, start, 0, len(sync)
    places, kinds = sync.tolist(), kind.tolist()
    while i < n:
        own = not chain or kinds[i] == kinds[chain[-1]]
        if places[i] != at or not (own or good[i]):  # a gap: go on at the next header of its kind that another follows
            while i < n and not (good[i] and (not chain or kinds[i] == kinds[chain[-1]])):
                i += 1
            if i == n:
                break
            resyncs, skipped = resyncs + 1, skipped + places[i] - at
        chain.append(i)
        at = ends[i]
        i = step[i] if linked[i] else int(np.searchsorted(sync, at))
    skipped += max(0, end - at)
    frames = np.array(chain, np.int64)
    off, code = sync[frames], code[frames]
    out = {"tag_bytes": start + len(data) - end, "tags": id3v2_frames(data), "table": {}, "resyncs": resyncs, "skipped": skipped}
    mono = (d[off + 3] >> 6) == 3 if len(off) else np.zeros(0, bool)
    first = (code >> 8 & 0x18) == 0x18
    if len(off) and (found := vbr_table(data, int(off[0]), int(size[code[0]]), bool(mono[0]), bool(first[0]))):
        out["table"] = found
        off, code, mono, first = off[1:], code[1:], mono[1:], first[1:]
    guarded = ((code >> 8 & 1) == 0) & ((code >> 8 & 6) == 2)  # checksum present, Layer III
    right = 0
    for m in (False, True):
        for f in (False, True):
            rows = off[guarded & (mono == m) & (first == f)]
            side = (17 if m else 32) if f else (9 if m else 17)
            rows = rows[rows + 6 + side <= len(d)]
            if len(rows):
                bytes_ = d[rows[:, None] + np.r_[2:4, 6 : 6 + side]]
                right += int((crc16(bytes_) == (d[rows + 4].astype(np.uint32) << 8 | d[rows + 5])).sum())
    rates = np.unique(hz[code])
    rate = int(rates[0]) if len(rates) == 1 else None
    total = int(samples[code].sum())
    out |= {
        "frames": len(off), "rate": rate, "samples": total, "crc_frames": int(guarded.sum()), "crc_ok": right,
        "micros": int(sum(int(samples[code[hz[code] == r]].sum()) * 1_000_000 // int(r) for r in rates)),
        "offsets": off, "sizes": size[code],
    }
    return out


def unwrap(data: bytes, found: dict) -> bytes:
    """The payload of a file made by ``wrap``, from its frame offsets."""
    d = np.frombuffer(data, np.uint8)
    stored = d[found["offsets"][:, None] + np.arange(DATA, DATA + UNIT + 4)]
    payload = stored[:, :UNIT].tobytes()
    if wrong := np.flatnonzero((checks(payload) != stored[:, UNIT:]).any(1)).tolist():
        raise ValueError(f"bytes of frame {wrong[0]} don't fit their CRC-32")
    return payload


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with spaces up to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def sound(payload: bytes) -> dict[str, int]:
    """Statistics of bytes as samples around 128: peak, thousandths of the mean square, sign changes, distinct values."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return {"peak": int(np.abs(x).max()), "power": int((x * x).sum()) * 1000 // len(x), "crossings": int(((x[1:] < 0) != (x[:-1] < 0)).sum()), "levels": len(np.unique(x))}


def feature(found: dict, payload: bytes) -> str:
    """What the medium says, and its samples' statistics: equal media, equal strings."""
    o = found["offsets"]
    told = {k: found[k] for k in ("frames", "rate", "samples", "micros", "crc_frames", "crc_ok", "resyncs", "skipped", "tag_bytes")} | sound(payload)
    told |= {"table": found["table"].get("kind"), "table_frames": found["table"].get("frames"), "seek": [int(o[len(o) * i // 4]) for i in range(4)] if len(o) else []}
    return json.dumps(told, sort_keys=True, separators=(",", ":"))


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media): each whole text stored as MPEG audio."""
    rows = narrow(docs, key=key, text=text)
    make = lambda: lambda key, text: {"key": key, "media": [wrap(padded(t)[1]) for t in text]}
    return map_batches(rows, make, f"key {dict(rows.dtypes)['key']}, media binary").withColumnRenamed("key", key)


def describe_media(frame: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row of typed columns for each medium, with its frame seek offsets."""
    names = ("frames", "samples", "rate", "micros", "crc_frames", "crc_ok", "resyncs", "skipped", "tag_bytes")

    def make():
        def f(key, media):
            found = [parse(m) for m in media]
            out = {"key": key} | {n: [x[n] for x in found] for n in names}
            out["vbr_table"] = [x["table"].get("kind") for x in found]
            out["vbr_frames"] = [x["table"].get("frames") for x in found]
            out["seek_offsets"] = [x["offsets"] for x in found]
            return out

        return f

    rows = narrow(frame, key=key, media=media)
    schema = f"key {dict(rows.dtypes)['key']}, " + ", ".join(f"{n} bigint" for n in names) + ", vbr_table string, vbr_frames bigint, seek_offsets array<bigint>"
    return map_batches(rows, make, schema, text="media").withColumnRenamed("key", key)


def media_digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each whole text, read the stored bytes back, and digest both."""

    def make():
        def f(key, text):
            out: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for t in text:
                n, payload = padded(t)
                media = wrap(payload)
                found = parse(media)
                back = unwrap(media, found)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found, back))
                for name, value in zip(out, row):
                    out[name].append(value)
            return {"key": key} | out

        return f

    rows = narrow(docs, key=key, text=text)
    schema = f"key {dict(rows.dtypes)['key']}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_batches(rows, make, schema).withColumnRenamed("key", key)
