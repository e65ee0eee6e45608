"""Title similarity that Spark has no expression for: the gestalt ratio, 2 M / (characters of both), M being the characters in
matching blocks: the longest common block (of equals the first in a, then in b), and so on left and right of it.

A batch of pairs is one set of matrices: all pairs' open stretches are compared at once, row by row of the dynamic programme,
and split at their longest blocks until none matches. From 200 characters on, characters that stand in more than a hundredth
of b (and one more place) begin no block but may extend one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Texts of so many characters have popular ones; a text's characters are popular from one in so many on.
LONG, SHARE = 200, 100
#: Cells of one matrix row over all open stretches.
CELLS = 1 << 20


def _codes(texts: list[str], pad: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), pad, np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _popular(b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which places of b hold popular characters."""
    out = np.zeros(b.shape, bool)
    for k in np.flatnonzero(length >= LONG):
        kinds, at, n = np.unique(b[k, : length[k]], return_inverse=True, return_counts=True)
        out[k, : length[k]] = (n > length[k] // SHARE + 1)[at]
    return out


def _longest(a: np.ndarray, b: np.ndarray, plain: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches (pair, a's start and end, b's start and end) the longest block: its starts in a and b, and its length."""
    pair, a0, a1, b0, b1 = s.T
    width = int((b1 - b0).max())
    column = np.minimum(b0[:, None] + np.arange(width), b.shape[1] - 1)
    own = np.where((np.arange(width) < (b1 - b0)[:, None]) & plain[pair[:, None], column], b[pair[:, None], column], -3)
    run, size, i, j = np.zeros((len(s), width), np.int32), np.zeros(len(s), np.int32), a0.copy(), b0.copy()
    for t in range(int((a1 - a0).max())):
        x = np.where(a0 + t < a1, a[pair, np.minimum(a0 + t, a.shape[1] - 1)], -4)
        longer = np.empty_like(run)
        longer[:, 0], longer[:, 1:] = 1, run[:, :-1] + 1
        run = np.where(own == x[:, None], longer, 0)
        end = run.argmax(axis=1)
        best = run[np.arange(len(s)), end]
        more = best > size
        size = np.where(more, best, size)
        i, j = np.where(more, a0 + t + 1 - best, i), np.where(more, b0 + end + 1 - best, j)
    return i, j, size.astype(np.int64)


def _extend(a: np.ndarray, b: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> None:
    """Blocks grow at both ends while characters are equal (only popular ones still can be)."""
    pair, a0, a1, b0, b1 = s.T
    going = np.ones(len(s), bool)
    while going.any():
        going &= (i > a0) & (j > b0) & (a[pair, np.maximum(i - 1, 0)] == b[pair, np.maximum(j - 1, 0)])
        i -= going
        j -= going
        size += going
    going[:] = True
    while going.any():
        going &= (i + size < a1) & (j + size < b1) & (a[pair, np.minimum(i + size, a.shape[1] - 1)] == b[pair, np.minimum(j + size, b.shape[1] - 1)])
        size += going


def matching(first: list[str], second: list[str]) -> np.ndarray:
    """Characters in matching blocks of each pair of texts; none is empty."""
    a, b = _codes(first, -1), _codes(second, -2)
    la, lb = np.array([len(t) for t in first]), np.array([len(t) for t in second])
    plain = ~_popular(b, lb)
    total = np.zeros(len(first), np.int64)
    zero = np.zeros(len(first), np.int64)
    open_ = np.stack([np.arange(len(first)), zero, la, zero, lb], axis=1)
    while len(open_):
        i, j, size = _longest(a, b, plain, open_)
        if not plain.all():
            _extend(a, b, open_, i, j, size)
        hit = size > 0
        s, i, j, size = open_[hit], i[hit], j[hit], size[hit]
        np.add.at(total, s[:, 0], size)
        left = np.stack([s[:, 0], s[:, 1], i, s[:, 3], j], axis=1)
        right = np.stack([s[:, 0], i + size, s[:, 2], j + size, s[:, 4]], axis=1)
        open_ = np.concatenate([left, right])
        open_ = open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]
    return total


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    la, lb = a.str.len().to_numpy(), b.str.len().to_numpy()
    out = np.where((a == b) & (la > 0), 1.0, 0.0)
    todo = np.flatnonzero((la > 0) & (lb > 0) & (a != b).to_numpy())
    todo = todo[np.lexsort((la[todo], lb[todo]))]  # pairs of like lengths share matrices
    while len(todo):
        n = max(1, int(np.searchsorted(lb[todo] * np.arange(1, len(todo) + 1), CELLS)))
        part, todo = todo[:n], todo[n:]
        out[part] = 2.0 * matching(a.iloc[part].tolist(), b.iloc[part].tolist()) / (la[part] + lb[part])
    return pd.Series(out)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio can reach at most, from the lengths alone."""
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) | (lb == 0), 0.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


def title_ratio(a: Column, b: Column) -> Column:
    """Ratio of two normalised titles; 0 when either is empty. Not symmetric."""
    return _ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


#: Letters of title keys, and how many of one are counted.
LETTERS, COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 ", 16
#: Rows of small groups that are compared together, and pairs of one set of matrices.
TOGETHER, PAIRS = 256, 1 << 14


def _letters(codes: np.ndarray) -> np.ndarray:
    """Longs in which each letter of LETTERS has as many bits set as a row holds it, COUNTED at most."""
    at = np.arange(COUNTED)
    bits = np.concatenate([(codes == ord(x)).sum(axis=1)[:, None] > at for x in LETTERS], axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.uint64)


def bounded_distance(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of codes (which are over 1, behind a row's length anything): those over the largest
    ``most`` are that plus 1. All pairs' matrices are filled at once row by row, in a band of the largest ``most``."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    d, last = int(most.max()), n_a.max()
    order = np.argsort(n_a, kind="stable")
    a, b, n_a, n_b = a[order].T.copy(), b[order], n_a[order], n_b[order]
    kind = np.uint8 if d < 250 else np.uint16 if d < 65000 else np.int64
    text = np.ones((last + 2 * d + 1, len(n_b)), b.dtype)  # row d + j is b's letter j
    width = min(b.shape[1], last + d + 1)
    text[d : d + width] = np.where(np.arange(width) < n_b[:, None], b[:, :width], 1).T
    now = np.full((2 * d + 1, len(n_b)), d + 1, kind)  # row d + k is the distance of a's first i letters and b's first i + k
    now[d:] = np.arange(d + 1, dtype=kind)[:, None]
    found = np.full(len(n_b), d + 1, np.int64)
    ends = np.searchsorted(n_a, np.arange(last + 2))
    for i in range(last + 1):
        if i:
            before = now
            now = before + (text[i - 1 : i + 2 * d] != a[i - 1])
            np.minimum(now[:-1], before[1:] + kind(1), out=now[:-1])
            for k in range(1, 2 * d + 1):
                np.minimum(now[k], now[k - 1] + kind(1), out=now[k])
            np.minimum(now, kind(d + 1), out=now)
        mine = np.arange(ends[i], ends[i + 1])
        k = n_b[mine] - i + d
        inside = (k >= 0) & (k <= 2 * d)
        found[mine[inside]] = now[k[inside], mine[inside]]
    out[order] = found
    return out


def _near(codes: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Levenshtein similarity of rows x and y where it is ``least`` or more, else -1."""
    out = np.full(len(x), -1.0)
    longer = np.maximum(n[x], n[y])
    for part in np.array_split(np.argsort(longer, kind="stable"), -(-len(x) // PAIRS) or 1):
        if not len(part):
            continue
        size, most = longer[part], np.floor(longer[part] * (1.0 - least) + 1e-9).astype(np.int64)
        step = max(1, (PAIRS << 10) // int(size.max() + 2 * most.max() + 1))
        for s in range(0, len(part), step):
            p, z, m = part[s : s + step], size[s : s + step], most[s : s + step]
            width = int(z.max())
            distance = bounded_distance(codes[x[p], :width], n[x[p]], codes[y[p], :width], n[y[p]], m)
            similarity = 1.0 - distance / np.maximum(z, 1)
            out[p] = np.where((distance <= m) & (similarity >= least), similarity, -1.0)
    return out


def _met(codes: np.ndarray, n: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``first`` and one of ``second`` (both by length) that fit (a matrix says which) and that counts of letters do not tell apart: a letter put in or
    left out turns one bit of ``_letters`` at most, one in place of another two, and a difference in length takes as many
    edits of the first kind."""
    bits = _letters(codes)
    own, step = n[second], max(1, (1 << 17) // max(1, len(second)))
    for s in range(0, len(first), step):
        x = first[s : s + step]
        low, high = np.searchsorted(own, np.floor(n[x[0]] * least - 1e-9), "left"), np.searchsorted(own, np.ceil(n[x[-1]] / least + 1e-9) if least > 0 else np.inf, "right")
        y = second[low:high]
        longer, apart = np.maximum(n[x][:, None], n[y]), np.abs(n[x][:, None] - n[y])
        most = np.floor(longer * (1.0 - least) + 1e-9).astype(np.int64)
        turned = np.zeros(most.shape, np.int64)
        for w in range(bits.shape[1]):
            turned += np.bitwise_count(bits[x, w][:, None] ^ bits[y, w])
        i, j = np.nonzero((apart <= most) & (turned <= 2 * most - apart) & fits(x, y))
        yield x[i], y[j]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ASCII texts in rows of one width, and their lengths."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(x.encode().ljust(n.max(), b"\1") for x in texts), np.uint8).reshape(len(texts), -1), n


def _cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Whole cells, end to end; a cell is what is equal in ``names``."""
    kept, cell = [], None
    for batch in batches:
        t = pa.table(batch)
        start = 0
        for at, name in enumerate(zip(*(t[c].to_pylist() for c in names), strict=True)):
            if name != cell:
                if at > start:
                    kept.append(t.slice(start, at - start))
                if kept:
                    yield pa.concat_tables(kept)
                kept, cell, start = [], name, at
        kept.append(t.slice(start))
    if kept:
        yield pa.concat_tables(kept)


def _together(cells: Iterator[pa.Table], alone: Callable[[pa.Table], bool] = lambda t: False) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cells, small ones several at once (but those that are ``alone``), with the number of each row's cell."""
    small, held = [], 0
    for t in cells:
        if t.num_rows > TOGETHER or alone(t):
            yield t, np.zeros(t.num_rows, np.int64)
            continue
        if held + t.num_rows > TOGETHER:
            yield pa.concat_tables(small), np.repeat(np.arange(len(small)), [x.num_rows for x in small])
            small, held = [], 0
        small.append(t)
        held += t.num_rows
    if small:
        yield pa.concat_tables(small), np.repeat(np.arange(len(small)), [x.num_rows for x in small])


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """block, order_a, key_a, key_b, similarity of rows (block, i, j, part, key, scan_order, k) whose ``k`` (of LETTERS) are alike, ``scan_order`` of the first
    being the lower: each of ``i`` meets each of ``j`` of its block. Rows lie block by block and ``i`` by ``j``."""

    def apart(t: pa.Table) -> bool:
        return t["i"][0].as_py() != t["j"][0].as_py()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _together(_cells(batches, ["block", "i", "j"]), apart):
            codes, n = _coded(t["k"].to_pylist())
            across, order, part = apart(t), t["scan_order"].to_numpy(), t["part"].to_numpy()
            by_length = np.argsort(n, kind="stable")
            first, second = (by_length[part[by_length] == t[c][0].as_py()] for c in ("i", "j")) if across else (by_length, by_length)
            for x, y in _met(codes, n, lambda x, y, group=group: group[x][:, None] == group[y], first, second, least):
                todo = order[x] != order[y] if across else order[x] < order[y]
                x, y = x[todo], y[todo]
                similarity = _near(codes, n, x, y, least)
                x, y, similarity = x[similarity >= 0], y[similarity >= 0], similarity[similarity >= 0]
                a, b = pa.array(np.where(order[x] < order[y], x, y)), pa.array(np.where(order[x] < order[y], y, x))
                if len(x):
                    yield from pa.table({"block": t["block"].take(a), "order_a": t["scan_order"].take(a), "key_a": t["key"].take(a), "key_b": t["key"].take(b), "similarity": similarity}).to_batches()

    kind = dict(rows.dtypes)
    return rows.select("block", "i", "j", "part", "key", "scan_order", "k").mapInArrow(of, f"block string, order_a {kind['scan_order']}, key_a {kind['key']}, key_b {kind['key']}, similarity double")


def first_near(rows: DataFrame, cell: list[str], least: float) -> DataFrame:
    """p, p_name, unordered, scan_order, key, t, similarity: for each probe of a cell its first item that is alike. Rows (the columns of
    ``cell``, by which they lie, and asks, text, name, held, scan_order, key) are probes, which ask, and items: the text ``held`` of an
    item contains the probe's, and the names are equal or the probe has none. Items without an order come last."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _together(_cells(batches, cell)):
            asks = t["asks"].to_numpy()
            if asks.all() or not asks.any():
                continue
            text, name, held, key, orders = (t[c].to_pylist() for c in ("text", "name", "held", "key", "scan_order"))
            codes, n = _coded(text)
            by_length = np.argsort(n, kind="stable")
            number: dict[str, int] = {"": 0}
            names = np.array([number.setdefault(x, len(number)) for x in name])
            rank = np.empty(len(text), np.int64)
            rank[sorted(range(len(text)), key=lambda k: (orders[k] is None, 0 if orders[k] is None else orders[k], key[k] or ""))] = np.arange(len(text))
            fits = lambda x, y, group=group, names=names: (group[x][:, None] == group[y]) & ((names[x][:, None] == 0) | (names[x][:, None] == names[y]))
            best: dict[int, tuple[int, float]] = {}
            for x, y in _met(codes, n, fits, by_length[asks[by_length]], by_length[~asks[by_length]], least):
                similarity = _near(codes, n, x, y, least)
                near = np.flatnonzero(similarity >= 0)
                near = near[np.lexsort((rank[y[near]], x[near]))]
                for p, i, value in zip(x[near].tolist(), y[near].tolist(), similarity[near].tolist(), strict=True):
                    if p not in best and held[p] in held[i]:
                        best[p] = (i, value)  # a probe's items are all met at once
            if best:
                out = [(text[p], name[p], orders[i] is None, orders[i], key[i], text[i], value) for p, (i, value) in best.items()]
                kinds = [t["text"].type, t["name"].type, pa.bool_(), t["scan_order"].type, t["key"].type, t["text"].type, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["p", "p_name", "unordered", "scan_order", "key", "t", "similarity"])

    kind = dict(rows.dtypes)
    return rows.select(*cell, "asks", "text", "name", "held", "scan_order", "key").mapInArrow(of, f"p string, p_name string, unordered boolean, scan_order {kind['scan_order']}, key {kind['key']}, t string, similarity double")
