"""MPEG audio columns: write, resynchronise, verify and index Layer III streams.

``read_stream`` is the operator: it skips an ID3v2 tag (and reads its TXXX frames) and an ID3v1 trailer, finds frame
headers again after damage (a header counts when the next one, or the end, follows where it says), checks the CRC-16
of protected frames (Layers I and III; what it covers in Layer II follows from allocation tables and is not checked),
parses a Xing/Info or VBRI table, and stores exact durations (samples over rate) and frame offsets.

``write_stream`` stores any bytes losslessly in such a stream: they are the frames' main data, a Xing table comes
first, the tag says how many bytes there are. Frames have 320 kbit/s; the last has the least rate that holds the rest.

Defined cases: a null text counts as empty; an empty or broken stream has no frames, duration 0 and no payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of ISO 11172-3 / 13818-3, by version (MPEG-1; MPEG-2 and 2.5) and layer (1, 2, 3), kbit/s of index 1 to 14.
BITRATES = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
#: What write_stream uses: MPEG-1 Layer III, 32 kHz, mono, protected.
RATE, SIDE, HEAD = 32000, 17, 6
SIZES = [144 * 1000 * b // RATE for b in BITRATES[1, 3]]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ rows[:, k]]
    return c


def parse_header(data: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """(frame bytes, samples, rate, kbit/s, side bytes, protected) of a valid header, else None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, b2 = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2]
    if version == 1 or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3:
        return None
    first, rate = version == 3, RATES[version][b2 >> 2 & 3]
    kbit = BITRATES[1 if first else 2, layer][(b2 >> 4) - 1]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbit // rate + (b2 >> 1 & 1)) * 4 if layer == 1 else samples * 125 * kbit // rate + (b2 >> 1 & 1)
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    if layer == 3:
        side = (17 if mode == 3 else 32) if first else (9 if mode == 3 else 17)
    else:  # allocation of 32 bands, four bits each: of one channel, of two, or of two up to a bound
        side = 0 if layer == 2 else 16 if mode == 3 else 18 + 2 * extension if mode == 1 else 32
    return size, samples, rate, kbit, side, int(not data[at + 1] & 1)


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def read_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """Where an ID3v2.3/2.4 tag ends, and its TXXX texts."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, texts = min(len(data), 10 + size(data[6:10])), 10, {}
    while at + 10 <= end and data[at]:
        n = size(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at : at + 4] == b"TXXX" and data[at + 10 : at + 11] == b"\x03":
            key, _, value = data[at + 11 : at + 10 + n].decode("utf-8", "replace").partition("\0")
            texts[key] = value
        at += 10 + n
    return end, texts


def frame(index: int) -> bytearray:
    """An empty frame of bitrate index - 1, CRC set."""
    out = bytearray(SIZES[index])
    out[:4] = bytes([0xFF, 0xFA, (index + 1) << 4 | 2 << 2, 0xC0])
    return out


def write_stream(payload: bytes) -> bytes:
    top, room = len(SIZES) - 1, SIZES[-1] - HEAD - SIDE
    whole, rest = divmod(len(payload), room)
    last = next(i for i, s in enumerate(SIZES) if s - HEAD - SIDE >= rest) if rest else None
    sizes = [SIZES[top]] * whole + ([SIZES[last]] if rest else [])
    table = frame(9)
    body = np.zeros(sum(sizes), np.uint8)
    if whole:
        block = body[: whole * SIZES[top]].reshape(whole, -1)
        block[:, HEAD + SIDE :] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
        block[:, :4] = np.frombuffer(bytes(frame(top)[:4]), np.uint8)
    if rest:
        tail = body[whole * SIZES[top] :]
        tail[:4] = np.frombuffer(bytes(frame(last)[:4]), np.uint8)
        tail[HEAD + SIDE : HEAD + SIDE + rest] = np.frombuffer(payload, np.uint8, rest, whole * room)
    starts = np.r_[0, np.cumsum([len(table), *sizes])[:-1]]
    total = len(table) + len(body)
    toc = bytes(int(256 * starts[min(len(starts) - 1, len(starts) * p // 100)] // total) for p in range(100))
    table[HEAD + SIDE : HEAD + SIDE + 116] = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    out = np.concatenate([np.frombuffer(bytes(table), np.uint8), body])
    covered = out[starts[:, None] + np.array([2, 3, *range(HEAD, HEAD + SIDE)])]
    crc = crc16(covered)
    out[starts + 4], out[starts + 5] = crc >> 8, crc & 0xFF
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + out.tobytes()


def read_stream(data: bytes | None) -> dict[str, Any]:
    data = data or b""
    at, texts = read_tag(data)
    end = len(data) - 128 if len(data) >= at + 128 and data[-128:-125] == b"TAG" else len(data)
    offs, facts, skipped, synced = [], [], 0, False
    while at + 4 <= end:
        h = parse_header(data, at)
        good = h is not None and at + h[0] <= end and (synced or at + h[0] == end or parse_header(data, at + h[0]) is not None)
        if good:
            offs.append(at)
            facts.append(h)
            at += h[0]
            synced = True
        else:  # resynchronise at the next byte that may start a header
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped, at, synced = skipped + nxt - at, nxt, False
    raw, o, f = np.frombuffer(data, np.uint8), np.array(offs, np.int64), np.array(facts, np.int64).reshape(-1, 6)
    good = bad = 0
    for side in np.unique(f[:, 4][(f[:, 5] == 1) & (f[:, 4] > 0)]):
        x = o[(f[:, 4] == side) & (f[:, 5] == 1)]
        ok = crc16(raw[x[:, None] + np.array([2, 3, *range(6, 6 + side)])]) == (raw[x + 4].astype(np.uint32) << 8 | raw[x + 5])
        good, bad = good + int(ok.sum()), bad + int((~ok).sum())
    info: dict[str, int] = {}
    if offs:
        x = offs[0] + 4 + 2 * int(f[0, 5]) + int(f[0, 4])
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    info[name] = int.from_bytes(data[x : x + 4], "big") if n == 4 else zlib.crc32(data[x : x + n])
                    x += n
            o, f = o[1:], f[1:]
        elif data[(x := offs[0] + 36) : x + 4] == b"VBRI":
            entries, width = int.from_bytes(data[x + 18 : x + 20], "big"), int.from_bytes(data[x + 22 : x + 24], "big")
            info |= {"bytes": int.from_bytes(data[x + 10 : x + 14], "big"), "frames": int.from_bytes(data[x + 14 : x + 18], "big"), "toc": zlib.crc32(data[x + 26 : x + 26 + entries * width])}
            o, f = o[1:], f[1:]
    payload = b"".join(data[a + 4 + 2 * p + s : a + n] for a, n, s, p in zip(o.tolist(), f[:, 0].tolist(), f[:, 4].tolist(), f[:, 5].tolist(), strict=True))
    samples, rate = int(f[:, 1].sum()), int(f[0, 2]) if len(f) else 0
    stated = texts.get("payload_bytes", "")
    return {
        "tags": texts, "table": info, "n_frames": len(o), "samples": samples, "rate": rate, "duration_s": samples / rate if rate else 0.0,
        "offsets": o, "kbits": f[:, 3], "crc_good": good, "crc_bad": bad, "skipped": skipped, "payload": payload[: int(stated)] if stated.isdigit() else payload,
    }


def padded(text: str | None) -> bytes:
    """The text as UTF-8 and bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes((-len(raw)) % 64 or (0 if raw else 64))


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row of ``docs`` (doc_id, text; other columns are ignored)."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            texts = b.column("text").to_pylist()
            n = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array([write_stream(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(stored: DataFrame, with_payload: bool = False) -> DataFrame:
    """Digests and facts of a column ``media``; the other columns stay in front. A null or broken stream has no frames."""
    common.configure(stored.sparkSession)
    keep = [c for c in stored.columns if c != "media"]
    own = {
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
        "n_frames": pa.int64(), "samples": pa.int64(), "rate": pa.int64(), "duration_s": pa.float64(), "crc_good": pa.int64(), "crc_bad": pa.int64(), "skipped": pa.int64(), "seek_offsets": pa.list_(pa.int64()),
    }
    own |= {"payload": pa.binary()} if with_payload else {}

    def facts(data: bytes | None) -> tuple:
        x, data = read_stream(data), data or b""
        p = x["payload"]
        rates, counts = np.unique(x["kbits"], return_counts=True)
        feature = f"frames={x['n_frames']} samples={x['samples']} rate={x['rate']} kbits={','.join(f'{r}x{n}' for r, n in zip(rates, counts, strict=True))} crc={x['crc_good']}/{x['crc_good'] + x['crc_bad']} table={x['table'].get('frames', 0)}:{x['table'].get('bytes', 0)}:{x['table'].get('toc', 0):08x} seek={zlib.crc32(x['offsets'].astype('<i8').tobytes()):08x} payload={zlib.crc32(p):08x}"
        return (
            len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature,
            x["n_frames"], x["samples"], x["rate"], x["duration_s"], x["crc_good"], x["crc_bad"], x["skipped"], x["offsets"], *([p] if with_payload else []),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "media"):
            rows = list(zip(*map(facts, b.column("media").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(rows, own.values(), strict=True))], names=[*keep, *own])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    ahead = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != "media"]
    return stored.select(*(F.col(f"`{c}`") for c in keep), "media").mapInArrow(run, ", ".join([*ahead, *(f"{c} {kinds[t]}" for c, t in own.items())]))
