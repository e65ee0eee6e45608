"""Packing: documents become token sequences of a fixed window with little padding, by best-fit decreasing.

Texts are tokenized where they are read; the windows that a document fills alone are cut off there. Only piece
descriptions travel. They are dealt to shards of about SHARD documents, repeated rows to different ones; in each, the
rests are placed longest first into the tightest open window, which a segment tree indexed by remaining capacity finds.

Token ids come from a byte-level BPE vocabulary file of the ``tokenizers`` library. Where that file's ids are its merge
ranks (checked when it is loaded) the same ids are computed by ``tiktoken``, four times as fast; else by ``tokenizers``,
which also takes the texts with a run of LONG_BLANKS blanks or more: tiktoken's pattern engine has no room for these.

Defined cases: a null text counts as empty, so the document is its end id alone; repeated rows are packed each; a null
doc_id stays null; no documents give no pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

SHARD = 1 << 15
LONG_BLANKS = 50_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids, without added tokens; strings of the file's special tokens become their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    pre = spec["pre_tokenizer"]
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
    loaded = []

    def slow(text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if not loaded:
            loaded.append(Tokenizer.from_file(path))
        return np.array(loaded[0].encode(text, add_special_tokens=False).ids, "<u4")

    plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None
    if not plain or any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merged)):
        return slow
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(char[c] for c in k): v for k, v in vocab.items()}
    made = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def fast(text: str) -> np.ndarray:
        if len(text) >= LONG_BLANKS and max((len(x) for x in re.findall(r"\s+", text)), default=0) >= LONG_BLANKS:
            return slow(text)
        return made.encode_to_numpy(text, allowed_special="all" if any(s in text for s in special) else set(), disallowed_special=())

    return fast


class Windows:
    """Open windows by remaining capacity; a segment tree over the capacities finds the least that is enough."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with capacity >= need, which is then no longer open."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right neighbour has some
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(sequence, offset) of each length, given in descending order, and how many sequences there are."""
    tree, sequence, offset, n = Windows(window), [], [], 0
    for need in lengths:
        found = tree.take(need)
        capacity, which = found or (window, n)
        n += found is None
        sequence.append(which)
        offset.append(window - capacity)
        if capacity > need:
            tree.put(capacity - need, which)
    return sequence, offset, n


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, shards: int, with_ids: bool) -> DataFrame:
    """One row a piece: the windows that a document fills, then its rest. A document's pieces share a shard; equal rows of a
    task are counted apart, so that they get shards of their own, whatever order they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, met = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for b in common.slices(batches, "text", 1 << 20):
            rows, ids = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                key = xxhash.xxh3_64_intdigest(own.tobytes(), seed=(doc_id or 0) & common.MASK)
                met[key] += 1
                shard = xxhash.xxh3_64_intdigest(f"{key} {task} {met[key]}") % shards
                for at in range(0, len(own), window):
                    part = own[at : at + window]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(own), shard))
                    ids.append(part.astype(np.int32) if with_ids else None)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", shard long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece (and its ids, if asked).

    ``docs`` needs doc_id and text; other columns are ignored. Windows are whole sequences of their own.
    """
    common.configure(docs.sparkSession)
    n, shards = docs.count(), 1
    while shards * SHARD < n:
        shards *= 2

    def place(group: pa.Table) -> pa.Table:
        base = group.column("shard")[0].as_py() << 40
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset, _ = best_fit(group.column("length").to_pylist(), window)
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array(np.array(sequence, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64()))

    schema = PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return pieces(docs, tokenizer, window, end_id, shards, with_ids).groupBy("shard").applyInArrow(place, schema)
