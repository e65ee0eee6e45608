"""Substring dedup: words of repeated fixed-length windows go, but for the window's earliest place.

Plan, in four moves:

1. Each task cuts its rows into blocks of about BLOCK words, hashes every window (Rabin-Karp modulo 2**64 over 64-bit
   word hashes) and keeps, for each hash, the block's earliest place: that is the pre-aggregation. A window that a third
   of the corpus holds leaves one entry a block. Later places in the block are repeats already; they go, packed, to the
   buckets of their documents, so a common passage gathers nowhere.
2. Entries go, packed, to buckets by the top bits of the hash. A bucket counts its hashes; of each that has several
   places, all but the earliest (doc_id, start) are repeats. (Counting is a group of Spark's, its arithmetic numpy's:
   windows as rows of their own would shuffle more.)
3. Repeats, and the texts, packed, go to buckets by document and text; equal rows of a block go as one with a count.
   There the repeats of a document merge into maximal removal intervals.
4. How many buckets there are follows from the corpus' bytes, so one holds about the same at any size.

Windows are judged on the input. Two windows count as equal when their 64-bit hashes are (see README for the odds).

Defined cases: a null text counts as empty (no words; the hash of the empty string); a null doc_id sorts before all;
rows with the same doc_id are one document: places with the same start are equally early and don't remove each other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

BLOCK = 1 << 20
#: Bytes of text that one bucket of window hashes, and one bucket of documents, stand for.
WINDOW_BUCKET, TEXT_BUCKET = 16 << 20, 8 << 20
#: Kinds of rows that a bucket of documents gets.
TEXTS, REPEATS = 0, 1
ROWS = "bucket int, kind int, payload binary"


def blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """Rows, gathered until they have about so many words (six bytes each), ordered by doc_id."""
    have, size = [], 0
    for b in common.slices(batches, "text"):
        have.append(b)
        size += b.column("text").nbytes
        if size >= 6 * words:
            yield pa.Table.from_batches(have)
            have, size = [], 0
    if have:
        yield pa.Table.from_batches(have)


def crc_of(texts: list[str | None]) -> np.ndarray:
    return np.fromiter((zlib.crc32((t or "").encode()) for t in texts), np.uint32, len(texts))


def pack_places(doc_id: np.ndarray, crc: np.ndarray, start: np.ndarray) -> bytes:
    """Places, ordered by document and start, as runs of documents and differences of starts."""
    new = np.r_[True, (doc_id[1:] != doc_id[:-1]) | (crc[1:] != crc[:-1])] if len(doc_id) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    step = np.diff(start, prepend=0)
    step[at] = start[at]
    parts = [np.diff(doc_id[at], prepend=0).astype("<i8"), crc[at].astype("<u4"), np.diff(np.r_[at, len(doc_id)]).astype("<u4"), step.astype("<u4")]
    return zstandard.compress(struct.pack("<II", len(at), len(doc_id)) + b"".join(p.tobytes() for p in parts), 1)


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    d, n = struct.unpack_from("<II", raw)
    doc = np.cumsum(np.frombuffer(raw, "<i8", d, 8))
    crc = np.frombuffer(raw, "<u4", d, 8 + 8 * d)
    runs = np.frombuffer(raw, "<u4", d, 8 + 12 * d).astype(np.int64)
    total = np.cumsum(np.frombuffer(raw, "<u4", n, 8 + 16 * d).astype(np.int64))
    ends = np.cumsum(runs)
    before = np.r_[0, total[ends[:-1] - 1]] if d else np.zeros(0, np.int64)
    # repeated rows of a document are one run, in which starts begin again: differences count modulo 2**32
    return np.repeat(doc, runs), np.repeat(crc, runs), (total - np.repeat(before, runs)) & 0xFFFFFFFF


def window_places(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, doc_id, crc, start of every window, ordered by doc_id, crc, start."""
    doc, crc = common.ids(table.column("doc_id")), crc_of(table.column("text").to_pylist())
    order = np.lexsort((crc, doc))
    doc, crc = doc[order], crc[order]
    offs, words = common.split_words(table.column("text").take(pa.array(order)), lower=False)
    hashes = common.rolling(common.hash_words(words), width)
    lens = np.diff(offs)
    row = np.repeat(np.arange(len(lens)), lens)[: len(hashes)]
    at = np.arange(len(hashes)) - offs[row]
    whole = at + width <= lens[row]
    row, at = row[whole], at[whole]
    return hashes[whole], doc[row], crc[row], at


def later_places(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which places have a strictly earlier one with the same hash; places may come in any order."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = hs[1:] == hs[:-1]
    many = order[np.r_[False, same] | np.r_[same, False]] if len(h) else order
    many = many[np.lexsort((start[many], doc[many], h[many]))]
    new = np.r_[True, h[many][1:] != h[many][:-1]] if len(many) else np.zeros(0, bool)
    first = many[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(many) else many
    out = np.zeros(len(h), bool)
    out[many] = (doc[many] != doc[first]) | (start[many] != start[first])
    return out


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    for s, e in zip(at, [*at[1:], len(b)], strict=False):
        yield int(b[s]), order[s:e]


def doc_bucket(doc: np.ndarray, crc: np.ndarray, n: int) -> np.ndarray:
    """By document and text: rows that share a doc_id spread."""
    return (common.mix(doc.view(np.uint64) ^ common.mix(crc.astype(np.uint64) + np.uint64(1))) & np.uint64(n - 1)).astype(np.int32)


def repeat_rows(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((start, crc, doc))
    doc, crc, start = doc[order], crc[order], start[order]
    for b, x in by_bucket(doc_bucket(doc, crc, n)):
        yield b, REPEATS, pack_places(doc[x], crc[x], start[x])


def as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def row_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return as_batch(rows, ["bucket", "kind", "payload"], [pa.int32(), pa.int32(), pa.binary()])


def removal_mask(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words covered by a window that starts at one of ``starts``."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def intervals(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def substring_dedup(docs: DataFrame, width: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (maximal intervals [start, end) of words), and the kept text if asked.

    ``docs`` needs doc_id and text; other columns are ignored.
    """
    spark = docs.sparkSession
    common.configure(spark)
    docs = docs.select("doc_id", "text")
    n_text = common.buckets_for(docs, "text", TEXT_BUCKET)
    bits = max(4, (n_text * TEXT_BUCKET // WINDOW_BUCKET).bit_length() - 1)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes and places for buckets of hashes; negative buckets are those of documents and hold packed repeats."""
        for block in blocks(batches, BLOCK):
            h, doc, crc, start = window_places(block, width)
            later = later_places(h, doc, start)
            rows = [(-1 - b, b"", data) for b, _, data in repeat_rows(doc[later], crc[later], start[later], n_text)]
            h, doc, crc, start = h[~later], doc[~later], crc[~later], start[~later]
            for b, x in by_bucket((h >> np.uint64(64 - bits)).astype(np.int32)):
                rows.append((b, h[x].tobytes(), pack_places(doc[x], crc[x], start[x])))
            yield as_batch(rows, ["bucket", "hashes", "places"], [pa.int32(), pa.binary(), pa.binary()])

    def judge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.Table.from_batches([row_batch([(-1 - bucket, REPEATS, x) for x in group.column("places").to_pylist()])])
        h = np.concatenate([np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()])
        doc, crc, start = (np.concatenate(x) for x in zip(*map(unpack_places, group.column("places").to_pylist()), strict=True))
        later = later_places(h, doc, start)
        return pa.Table.from_batches([row_batch(list(repeat_rows(doc[later], crc[later], start[later], n_text)))])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK):
            count = Counter(zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True))
            part = pa.table({"doc_id": pa.array([k[0] for k in count], pa.int64()), "text": pa.array([k[1] for k in count], pa.large_string()), "copies": pa.array(count.values(), pa.int64())})
            rows = []
            for b, x in by_bucket(doc_bucket(common.ids(part.column("doc_id")), crc_of([k[1] for k in count]), n_text)):
                sink = pa.BufferOutputStream()
                own = part.take(pa.array(x))
                with pa.ipc.new_stream(sink, own.schema) as w:
                    w.write_table(own)
                rows.append((b, TEXTS, zstandard.compress(sink.getvalue(), 1)))
            yield row_batch(rows)

    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    kinds |= {"text": pa.string()} if with_text else {}

    def finish(group: pa.Table) -> pa.Table:
        kind, payload = group.column("kind").to_pylist(), group.column("payload").to_pylist()
        repeats: dict[tuple[int, int], list[np.ndarray]] = {}
        for k, data in zip(kind, payload, strict=True):
            if k == REPEATS:
                doc, crc, start = unpack_places(data)
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]) if len(doc) else []
                for s, e in zip(new, [*new[1:], len(doc)], strict=False):
                    repeats.setdefault((int(doc[s]), int(crc[s])), []).append(start[s:e])
        out = []
        for k, data in zip(kind, payload, strict=True):
            if k != TEXTS:
                continue
            part = pa.ipc.open_stream(zstandard.decompress(data)).read_all()
            for doc_id, text, copies in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "copies")), strict=True):
                raw = (text or "").encode()
                words = raw.split()
                starts = repeats.get((common.NULL_ID if doc_id is None else doc_id, zlib.crc32(raw)))
                spans: list[dict[str, int]] = []
                n = len(words)
                if starts:
                    mask = removal_mask(np.concatenate(starts), n, width)
                    begin, end = intervals(mask)
                    spans = [{"start": s, "end": e} for s, e in zip(begin, end, strict=True)]
                    for s, e in zip(reversed(begin), reversed(end), strict=True):
                        del words[s:e]
                kept = b" ".join(words)
                out += [(doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), spans, *([kept.decode()] if with_text else []))] * copies
        return pa.Table.from_batches([as_batch(out, list(kinds), list(kinds.values()))])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>" + ", text string" * with_text
    entries = docs.mapInArrow(windows, "bucket int, hashes binary, places binary")
    judged = entries.groupBy("bucket").applyInArrow(judge, ROWS)
    return judged.union(docs.mapInArrow(texts, ROWS)).groupBy("bucket").applyInArrow(finish, schema)
