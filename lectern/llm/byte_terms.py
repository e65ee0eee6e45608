"""A byte-level tokenizer: a lookup table over concatenated UTF-8 finds where terms begin and end, xxhash groups them, and
their bytes are compared, so two terms count as one only if they are equal.

The table gives every byte a class; classes are what a caller makes of them. Bytes from 0x80 on are parts of longer
characters and can be given a class like others, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from . import common

#: A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def table_of(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    """A class for each byte: 0, but for the (first, last, class) that are given."""
    table = np.zeros(256, np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    return table


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Rows put together until they have about ``size`` bytes of ``column``."""
    have, total = [], 0
    for b in common.slices(batches, column):
        have.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(have)
            have, total = [], 0
    if have:
        yield pa.Table.from_batches(have)


class Terms:
    """The terms of a column of texts: for each its row, the place of its first byte, and its group; ``words`` has a group's bytes.

    ``kind`` is a table by byte: 1 stands for bytes of a term. ``seeds`` (a number for each row) keep equal terms of
    different rows apart unless the rows' seeds are equal.
    """

    def __init__(self, texts: pa.ChunkedArray, kind: np.ndarray, seeds: np.ndarray | None = None) -> None:
        a = pc.fill_null(texts.cast(pa.large_string()).combine_chunks(), "")
        offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        data = a.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bytes, self.offsets = LOWER[raw], offs - offs[0]
        inside = kind[raw] == 1
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True  # a row's end ends its last term
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash, self.group, self.first = self._groups(seeds[self.row] if seeds is not None else None)

    def _groups(self, seeds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        view, hashed = memoryview(self.bytes.tobytes()), xxhash.xxh3_64_intdigest
        h = np.empty(len(self.start), np.uint64)
        for at in range(0, len(h), 1 << 16):  # lists of numbers are many times an array's size
            part = slice(at, at + (1 << 16))
            edges = zip(self.start[part].tolist(), self.end[part].tolist(), strict=True)
            found = (hashed(view[s:e]) for s, e in edges) if seeds is None else (hashed(view[s:e], k) for (s, e), k in zip(edges, seeds[part].tolist(), strict=True))
            h[part] = np.fromiter(found, np.uint64, len(h[part]))
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        unlike = self._unlike(first[group], seeds)
        if len(unlike):  # terms that share a hash and are not equal get groups of their own
            own, extra = {}, []
            for k in unlike.tolist():
                key = (int(h[k]), bytes(view[self.start[k] : self.end[k]]), None if seeds is None else int(seeds[k]))
                if key not in own:
                    own[key] = len(first) + len(extra)
                    extra.append(k)
                group[k] = own[key]
            first = np.r_[first, np.array(extra, np.int64)]
        return h, group, first

    def _unlike(self, other: np.ndarray, seeds: np.ndarray | None, step: int = 1 << 18) -> np.ndarray:
        """Terms whose bytes (or seeds) differ from those of the ``other`` term beside them."""
        size = self.end - self.start
        bad = size != size[other]
        if seeds is not None:
            bad |= seeds != seeds[other]
        for s in range(0, len(other), step):
            part = np.flatnonzero(~bad[s : s + step]) + s
            part = part[self.start[other[part]] != self.start[part]]
            if len(part):
                n = size[part]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                differs = self.bytes[np.repeat(self.start[part], n) + within] != self.bytes[np.repeat(self.start[other[part]], n) + within]
                bad[part] |= np.add.reduceat(differs, np.cumsum(n) - n) > 0
        return np.flatnonzero(bad)

    def words(self) -> pa.Array:
        at = self.first
        return pa.array([self.bytes[s:e].tobytes() for s, e in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each run of equal ones begins, and how long it is."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(keys)])
