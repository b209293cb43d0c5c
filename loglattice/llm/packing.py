"""Packs tokenised documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences and a rest; the rest is halved
again and again (1/2, 1/4, ... of it), so that a batch has pieces of all sizes
and the smallest can even out what the largest leave. The pieces of a batch of
documents go through multiway differencing: every piece starts as a partial partition of its own
(its length in one window, the others empty); the two partial partitions with
the widest spread are merged, the fullest windows of one upon the emptiest of
the other, until one partition is left, whose windows are near-equal. If its
fullest window exceeds the capacity, the number of windows rises and the batch
is partitioned again.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, cut, flat, shared_blank
from .common import Workspace, steps, text_or_empty
from .token_counts import check

CAPACITY = 1024
#: A document's rest is halved until at most so many ids are left.
SMALLEST = 16
#: Ids of rests that a batch holds on average: about 64 windows.
BATCH_IDS = 64 * CAPACITY
#: Rows of a partition whose repeats are looked for at a time.
REMEMBERED = 1 << 18


def difference(lengths: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: the places of ``lengths`` in each of ``windows`` windows.

    A partial partition is kept as its windows' sums less the smallest, in
    ascending order, with the pieces of each. Ties go to the older partition,
    so the result is the same in every run.
    """
    heap = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        sums = np.zeros(windows, np.int64)
        sums[-1] = lengths[i]
        heap.append((-int(lengths[i]), len(heap), sums, [None] * (windows - 1) + [(i,)]))
    if not heap:
        return [[] for _ in range(windows)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        sums = a + b[::-1]
        own = [(x, y) if x and y else x or y for x, y in zip(own_a, reversed(own_b), strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), made, sums, [own[k] for k in order.tolist()]))
        made += 1
    out = []
    for tree in heap[0][3]:
        stack, flat = [tree] if tree else [], []
        while stack:
            x = stack.pop()
            if isinstance(x, int):
                flat.append(x)
            else:
                stack.extend(x)
        out.append(sorted(flat))
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; their number starts at what the total needs and rises until none exceeds it."""
    windows = max(1, -(-int(lengths.sum()) // capacity)) if len(lengths) else 0
    while windows:
        found = difference(lengths, windows)
        if max(int(lengths[w].sum()) for w in found) <= capacity:
            return [w for w in found if w]
        windows += 1
    return []


class TokenIds:
    """Ids of texts as the tokenizers library gives them, by that library; remembers distinct chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            check(json.load(f))
        added = self.tokenizer.get_added_tokens_decoder()
        special = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.leads = np.zeros(max([*vocab.values(), *added]) + 1, bool)
        self.leads[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True  # how byte-level vocabularies write a blank
        self._forget()
        self.table = ChunkTable(self._learn, self._forget)

    def _forget(self) -> None:
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes], block: int = 8192) -> None:
        """Joined chunks are told apart by the blank that starts each; the others go one by one."""
        plain, odd = shared_blank(chunks)
        sizes, order, parts = np.zeros(len(chunks), np.int64), np.r_[plain, odd], []
        for i in range(0, len(plain), block):
            (ids,) = self._encode([b"".join(chunks[k] for k in plain[i : i + block]).decode()])
            sizes[plain[i : i + block]] = np.diff(np.flatnonzero(self.leads[ids]), append=len(ids))
            parts.append(ids)
        for i in range(0, len(odd), block // 4):
            some = odd[i : i + block // 4]
            for k, ids in zip(some, self._encode([chunks[k].decode() for k in some]), strict=True):
                sizes[k] = len(ids)
                parts.append(ids)
        ends = np.cumsum(sizes[order])
        self.ids = _gather(np.concatenate(parts), (ends - sizes[order])[np.argsort(order)], sizes, before=self.ids)
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(sizes)]

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        data, bounds = flat(texts)
        starts = cut(data, bounds)
        number = self.table.find(data, starts)
        sizes = self.at[number + 1] - self.at[number]
        ids = _gather(self.ids, self.at[number], sizes)
        ends = np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, bounds)].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        if self.special and self.special.search(raw := data.tobytes()):
            for i in range(len(texts)):
                if self.special.search(text := raw[bounds[i] : bounds[i + 1]]):
                    out[i] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return out


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The runs of ``pool`` that start at ``starts``, one after another, behind ``before``."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    found = pool[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]
    return found if before is None else np.concatenate([before, found])


_coders: dict[str, TokenIds] = {}


def coder(path: str) -> TokenIds:
    """One for each worker process and vocabulary, kept between tasks."""
    if path not in _coders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _coders[path] = TokenIds(path)
    return _coders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread long"


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, smallest: int = SMALLEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cuts every document's ids, with ``end_id`` behind them: full sequences, then the rest halved down to ``smallest``.

    Ids themselves aren't kept, only each piece's checksum; a reader takes
    them from the document again by ``start`` and ``length``. ``spread`` is a
    hash of key and text that deals documents to batches; rows that repeat both
    within a partition are told apart there, so that they spread as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = coder(path), np.array([end_id], np.uint32)
        seen: dict[int, int] = {}
        for part in steps(batches, "t"):
            if len(seen) > REMEMBERED:
                seen.clear()
            rows = []
            for k, ids, s in zip(part.column(0).to_pylist(), c.of(part.column(1)), part.column(2).to_pylist(), strict=True):
                copy = seen[s] = seen.get(s, -1) + 1
                if copy:
                    s = hash((s, copy, TaskContext.get().partitionId()))  # of numbers: the same in every process
                ids, n = np.concatenate([ids, end]).astype("<u4").tobytes(), len(ids) + 1
                full = n // capacity * capacity
                cuts = [*range(0, full, capacity), full]
                while n - cuts[-1] > smallest:
                    cuts.append(n - (n - cuts[-1]) // 2)
                if cuts[-1] < n:
                    cuts.append(n)
                rows += [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, s) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])

    narrow = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t")).withColumn("s", F.xxhash64("k", "t"))
    return narrow.mapInArrow(run, PIECES)


def pack(cut: DataFrame, batches: int, capacity: int = CAPACITY) -> DataFrame:
    """Gives every piece its sequence and its offset there.

    Pieces are dealt to ``batches`` batches by ``spread``, so no source, length
    or key gathers in one. In a batch, full pieces are sequences of their own;
    the others are partitioned by differencing, and as its cost grows with
    pieces times windows, a batch that got more than twice its share of ids is
    partitioned in parts. ``sequence_id`` is the batch in the high bits and a
    running number within.
    """

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "spread", "start", "ids_crc32"], kind="stable", na_position="last", ignore_index=True)
        lengths = batch["length"].to_numpy()
        full = np.flatnonzero(lengths == capacity)
        short = np.flatnonzero(lengths < capacity)
        sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        sequence[full] = np.arange(len(full))
        number = len(full)
        ids = np.cumsum(lengths[short])
        parts = ids // (BATCH_IDS + 1) if len(ids) and ids[-1] > 2 * BATCH_IDS else np.zeros(len(ids), np.int64)
        for part in np.split(short, np.flatnonzero(np.diff(parts)) + 1):
            for window in pack_lengths(lengths[part], capacity):
                at = part[window]
                sequence[at] = number
                offset[at] = np.cumsum(lengths[at]) - lengths[at]
                number += 1
        return batch.assign(sequence_id=(batch["batch"].to_numpy() << 32) + sequence, offset=offset).drop(columns=["spread", "batch"])

    dealt = cut.withColumn("batch", F.pmod(F.xxhash64(F.lit("pack"), "spread"), F.lit(batches)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("batch").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, smallest: int = SMALLEST, rows: int | None = None) -> DataFrame:
    """One row for each piece of every document: where it comes from, its checksum, its sequence and offset there.

    A null or empty text still has its end id, so it gives one piece. Repeated
    rows and null keys are packed like any other row; other columns are left
    aside. An empty table gives no row. The pieces are written first: the sum
    of the rests' ids sets the number of batches. ``rows``: the number of rows,
    if known; it is not needed.
    """
    cut = Workspace(docs.sparkSession).put(pieces(docs, path, capacity=capacity, smallest=smallest))
    rest = cut.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    return pack(cut, max(1, -(-rest // BATCH_IDS)), capacity)
