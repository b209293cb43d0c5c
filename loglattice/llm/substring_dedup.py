"""Repeated passages by level-wise doubling of word windows.

The window of ``size`` words that decides is reached from shorter ones, each
level about twice as long: size / 4, size / 2, size, and a last level of nearly
2 * size. Only windows that repeat in another document at one length are
extended to the next, until no candidates survive.

Level 1 chooses, out of every run of short windows that a full window covers,
the one with the smallest hash. Equal full windows choose alike, so looking at
chosen windows (anchors) loses nothing, and a twentieth of all positions is
enough. Level 2 extends an anchor that repeats to its left and to its right.
Level 4 takes the anchor with all words that a full window around it may hold:
where that repeats, all full windows in it repeat in the same document, and the
earliest such document can speak for all. Only where an anchor stands in
different surroundings are full windows (level 3) hashed one by one, once for
each surrounding. Anchors of one document that are alike in all of this (a
repeated word or line) are one row with their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Workspace, lookup, mix64, steps, text_or_empty, word_ids

SIZE = 50
#: Odd multipliers of the two rolling hashes; only full windows need both.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def window_hashes(ids: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """The hash of every window of ``size`` ids: sum of id * factor ** place, built from halves, then spread."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    total, done, block, power, length, rest = np.zeros(len(ids) - size + 1, np.uint64), 0, ids, int(factor), 1, size
    while rest:
        if rest & 1:
            total = total * np.uint64(power) + block[done : done + len(total)]
            done += length
        rest >>= 1
        if rest:
            block = block[: len(block) - length] * np.uint64(power) + block[length:]
            power = power * power % (1 << 64)
            length *= 2
    return mix64(total + np.uint64(1))


def chosen(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of short windows, and for every full window the place of its anchor: the first smallest of them."""
    short = size // 4
    hashes = window_hashes(ids, short, FIRST)
    view = np.lib.stride_tricks.sliding_window_view(hashes, size - short + 1)
    return hashes, view.argmin(axis=1) + np.arange(len(view))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


ANCHORS = "doc_id long, tag long, h long, half_left int, half_right int, wide long, end int, places array<int>"


def anchors(texts: DataFrame, size: int) -> DataFrame:
    """One row for all anchors of a text that are alike: their hash, those of their two extensions and of their surroundings, and their places.

    Surroundings are 64 bits and only compared among anchors with the same
    hash. An extension that a text's border cuts off has the hash of what is
    there; it can't match a whole one, and any full window has one of the two
    whole. ``end`` is the text's number of words.
    """
    short, half = size // 4, size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            for k, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = word_ids(text.split())
                n = len(ids)
                if n < size or k is None:
                    continue
                hashes, anchor = chosen(ids, size)
                pos = anchor[np.diff(anchor, prepend=-1) > 0]  # anchors ascend
                halves = window_hashes(ids, half, FIRST)
                begin, end = np.maximum(pos - (size - short), 0), np.minimum(pos + size, n)
                left = np.where(pos >= half - short, halves[np.maximum(pos - (half - short), 0)], hashes[pos])
                right = np.where(pos <= n - half, halves[np.minimum(pos, n - half)], hashes[pos])
                wide = _span_hashes(ids, begin, end, SECOND)
                order = np.lexsort((wide, hashes[pos]))
                own, around = hashes[pos][order], wide[order]
                lead = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(around) != 0)])
                at = order[lead]
                row = (
                    np.full(len(at), k), np.full(len(at), tag), own[lead], (left >> np.uint64(32)).astype(np.uint32).view(np.int32)[at], (right >> np.uint64(32)).astype(np.uint32).view(np.int32)[at],
                    around[lead], np.full(len(at), n, np.int32), (pos[order].astype(np.int32), np.diff(lead, append=len(order))),
                )
                for column, values in zip(out, row, strict=True):
                    column.append(values)
            if out[0]:
                joined = [np.concatenate(c) for c in out[:7]]
                places = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.concatenate([sizes for _, sizes in out[7]]))].astype(np.int32), np.concatenate([p for p, _ in out[7]]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, joined[:2]), _signed(joined[2]), *map(pa.array, joined[3:5]), _signed(joined[5]), pa.array(joined[6]), places], [c.split()[0] for c in ANCHORS.split(", ")])

    return texts.mapInArrow(run, ANCHORS)


def _span_hashes(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Hashes of ids[begin:end] for arrays of bounds, from prefix sums of id * factor ** place; the length counts too."""
    n, inverse = len(ids), np.uint64(pow(int(factor), -1, 1 << 64))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, factor)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse)])
    sums = np.r_[np.uint64(0), np.cumsum(ids * powers)]
    return mix64(mix64((sums[end] - sums[begin]) * back[begin]) + (end - begin).astype(np.uint64))


def full_windows(marked: DataFrame, size: int) -> DataFrame:
    """The full windows around marked anchors: (a, b, doc_id, tag, start), a and b their two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            for k, tag, text, places in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids = word_ids(text.as_py().split())
                _, anchor = chosen(ids, size)
                start = np.flatnonzero(np.isin(anchor, places.values.to_numpy()))
                hashes = (_signed(window_hashes(ids, size, f)[start]) for f in (FIRST, SECOND))
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(np.full(len(start), k.as_py())), pa.array(np.full(len(start), tag.as_py())), pa.array(start.astype(np.int32))], ["a", "b", "doc_id", "tag", "start"])

    return marked.select("doc_id", "tag", "t", "places").mapInArrow(run, "a long, b long, doc_id long, tag long, start int")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def without(spanned: DataFrame, with_text: bool) -> DataFrame:
    """Removes the words of ``spans`` (array of begin and end; null: none) from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            rows = []
            for k, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split()
                n = len(words)
                if spans.is_valid:
                    edges = spans.values.flatten()
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, edges[0].to_numpy(), 1)
                    np.add.at(step, edges[1].to_numpy(), -1)
                    words = list(compress(words, np.cumsum(step[:-1]) == 0))
                kept = b" ".join(words)
                rows.append((k.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = spanned.select("doc_id", "t", "spans").mapInArrow(run, RESULT)
    return out if with_text else out.drop("kept_text")


def in_other_documents(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that stand in more than one document, and in how many rows; they combine before the shuffle."""
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    return found.where("lo <> hi").select(*keys, "n")


def _spread() -> Column:
    return F.xxhash64("doc_id", "tag")


def substring_dedup(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): every row without the words that windows of earlier documents cover.

    A word goes if a window of ``size`` consecutive words that covers it also
    starts in a document with a smaller key, both judged on the input. What
    stays is joined by one blank; ``with_text`` adds it as ``kept_text``. A
    null text has no words; a text of fewer than ``size`` words, or a row with
    a null key, keeps all and lends none. Rows that share a key are one
    document and never take from each other. Other columns are left aside; an
    empty table gives no row. ``size`` is 8 or more.
    """
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("t"))
    texts = texts.select("doc_id", F.xxhash64("t").alias("tag"), "t")
    every = work.put(anchors(texts, size))

    # level 1
    level1 = work.put(lookup(every, work.put(in_other_documents(every, "h")), ["h"]))
    work.drop(every)
    # level 4: each surrounding of an anchor, with the first document that has it
    wide = work.put(level1.groupBy("h", "wide").agg(F.min("doc_id").alias("first"), F.min("half_left").alias("half_left"), F.min("half_right").alias("half_right"), F.count(F.lit(1)).alias("n")))
    firsts = wide.withColumnRenamed("first", "doc_id").drop("n")
    several = work.put(in_other_documents(firsts, "h"))
    # level 2: of anchors in different surroundings, those survive of which either extension stands in several
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("half_left").alias("half")), F.struct(F.lit(1).alias("side"), F.col("half_right").alias("half")))
    halves = work.put(lookup(firsts, several, ["h"]).select("h", "wide", "doc_id", F.explode(sides).alias("x")).select("h", "wide", "doc_id", "x.side", "x.half"))
    again = lookup(halves, work.put(in_other_documents(halves, "h", "side", "half")), ["h", "side", "half"]).select("h", "wide").distinct()
    surrounded = work.put(wide.select("h", "wide", "first", "n").join(again.withColumn("extend", F.lit(True)), ["h", "wide"], "left"))
    told = lookup(level1, surrounded, ["h", "wide"]).where("doc_id > first or extend")
    told = work.put(told.select("doc_id", "tag", "places", "end", "first"))
    for done in (level1, wide, several, halves, surrounded):
        work.drop(done)

    # rows that repeat key and text tell the same places and spans: sets keep each once, before the shuffle too
    settled = told.where("doc_id > first").select("doc_id", "tag", "end", F.explode("places").alias("pos"))
    settled = settled.select("doc_id", "tag", F.greatest(F.lit(0), F.col("pos") - (size - size // 4)).alias("begin"), F.least(F.col("pos") + size, "end").alias("end"))
    marked = work.put(told.where("doc_id = first").groupBy("doc_id", "tag").agg(F.flatten(F.collect_set("places")).alias("places")))
    near = texts.where(Bloom(marked.select(_spread().alias("x"))).column(_spread()))
    windows = work.put(full_windows(near.join(marked, ["doc_id", "tag"]), size))
    earliest = windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    repeated = lookup(windows, work.put(earliest.select("a", "b", "lo", "n")), ["a", "b"]).where("doc_id > lo")
    repeated = repeated.select("doc_id", "tag", F.col("start").alias("begin"), (F.col("start") + size).alias("end"))
    spans = work.put(settled.unionByName(repeated).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    work.drop(windows)
    # texts that keep all their words are told apart beside the row and not shuffled
    hit = Bloom(spans.select(_spread().alias("x"))).column(_spread())
    cut = texts.where(hit).join(spans, ["doc_id", "tag"], "left").select("doc_id", "t", "spans")
    whole = texts.where(~hit).select("doc_id", "t", F.lit(None).cast(cut.schema["spans"].dataType).alias("spans"))
    return without(cut, with_text).unionByName(without(whole, with_text))
