"""Exact deduplication by a Golomb-coded fingerprint exchange.

Every partition of the fingerprint table sends its distinct 64-bit
fingerprints to their owners (ranges of the fingerprint), sorted, their gaps
Golomb-Rice coded. An owner decodes all lists, finds fingerprints that occur
twice, and answers each list with a bitmap, from which the partition knows its
suspects. Texts are then read again; those whose fingerprint is a suspect's
(and, as a Bloom filter says so, a few others) are shuffled and compared byte
by byte. All others are known to be alone and don't move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Bloom, Workspace, lookup, shuffle_partitions, steps, text_or_empty

#: Fingerprints that an owner holds on average at most: 128 MB when decoded.
OWNED = 1 << 24


def rice_encode(values: np.ndarray, low: int, high: int) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of ascending distinct ``values`` in [low, high): (bits of a remainder, unary quotients, remainders)."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    bits = max(0, ((high - low) // len(values)).bit_length() - 1)
    quotient = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return bits, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(count: int, bits: int, unary: bytes, rest: bytes, low: int) -> np.ndarray:
    """The values that ``rice_encode`` was given."""
    if not count:
        return np.zeros(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:count]
    gaps = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(bits)
    if bits:
        table = np.unpackbits(np.frombuffer(rest, np.uint8))[: count * bits].reshape(count, bits).astype(np.uint64)
        gaps |= (table << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def owner_bounds(owners: int) -> list[int]:
    """Owner i has the fingerprints from bounds[i] up to bounds[i + 1]."""
    return [(1 << 64) * i // owners for i in range(owners + 1)]


#: Rows of the working table: one for each document, then one for each owner that the partition has fingerprints of.
TABLE = "part int, doc_id long, print long, code_points long, text_sha256 string, owner int, n long, bits int, unary binary, rest binary, twice binary"
LISTS = ["part", "owner", "n", "bits", "unary", "rest", "twice"]


def fingerprints(docs: DataFrame, owners: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of a partition's documents, and behind them the coded lists that it sends to the owners."""
    bounds = owner_bounds(owners)
    inner = np.array(bounds[1:-1], np.uint64)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("print", pa.int64()), ("code_points", pa.int64()), ("text_sha256", pa.string()), ("owner", pa.int32()), ("n", pa.int64()), ("bits", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("twice", pa.binary())])

    def filled(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), []
        for batch in steps(batches, "t"):
            plain = [t.translate(None, SPACE) for t in batch.column(1).to_pylist()]
            prints = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain))
            sent.append(prints)
            yield filled(batch.num_rows, part=np.full(batch.num_rows, part), doc_id=batch.column(0), print=prints.view(np.int64), code_points=batch.column(2), text_sha256=[hashlib.sha256(t).hexdigest() for t in plain])
        if not sent:
            return
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        cuts = [0, *np.searchsorted(values, inner).tolist(), len(values)]
        for owner, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                bits, unary, rest = rice_encode(values[a:b], bounds[owner], bounds[owner + 1])
                yield filled(1, part=[part], owner=[owner], n=[b - a], bits=[bits], unary=[unary], rest=[rest], twice=[np.packbits(counts[a:b] > 1).tobytes()])

    return _texts(docs, text, key).mapInArrow(run, TABLE)


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    narrow = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    return narrow.select("k", F.col("t").cast("binary").alias("t"), F.length("t").cast("long").alias("n"))


def duplicate_bitmaps(lists: DataFrame, owners: int) -> DataFrame:
    """(part, owner, bitmap): which fingerprints of each list occur twice or more in all lists together."""
    bounds = owner_bounds(owners)

    def own(group: pd.DataFrame) -> pd.DataFrame:
        low = bounds[int(group["owner"].iloc[0])]
        decoded = [rice_decode(int(r.n), int(r.bits), r.unary, r.rest, low) for r in group.itertuples()]
        twice = [np.unpackbits(np.frombuffer(r.twice, np.uint8))[: int(r.n)].astype(bool) for r in group.itertuples()]
        values, counts = np.unique(np.concatenate([*decoded, *(d[t] for d, t in zip(decoded, twice, strict=True))]), return_counts=True)
        repeated = values[counts > 1]
        found = [np.packbits(np.isin(d, repeated, assume_unique=True)).tobytes() for d in decoded]
        return pd.DataFrame({"part": group["part"], "owner": group["owner"], "bitmap": found})

    return lists.groupBy("owner").applyInPandas(own, "part int, owner int, bitmap binary")


def suspects(lists: DataFrame, bitmaps: DataFrame, owners: int) -> DataFrame:
    """(part, print): what each partition learns from the bitmaps that answer its lists."""
    bounds = owner_bounds(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = rice_decode(r["n"], r["bits"], r["unary"], r["rest"], bounds[r["owner"]])
                hit = values[np.unpackbits(np.frombuffer(r["bitmap"], np.uint8))[: r["n"]].astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r["part"]), pa.int32()), pa.array(hit.view(np.int64))], ["part", "print"])

    return lists.join(bitmaps, ["part", "owner"]).mapInArrow(run, "part int, print long")


def suspected_texts(docs: DataFrame, known: Bloom, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n, plain) of rows whose fingerprint may be a suspect's: key, code points, and the text without white space."""
    test = known.test()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            plain = [t.translate(None, SPACE) for t in batch.column(1).to_pylist()]
            hit = test(np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain)))
            at = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([plain[i] for i in at.to_pylist()], pa.binary())], ["id", "n", "plain"])

    return _texts(docs, text, key).mapInArrow(run, "id long, n long, plain binary")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", owners: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for every row of ``docs``.

    Texts are equal when identical without white space. Of equal texts the
    row with the most code points in the original text, then the smallest
    doc_id, stays; a null doc_id comes after all others. A null text counts
    as empty, and empty texts are equal to each other. Rows that repeat both
    doc_id and text have equal rows here, all of them kept where that
    document is. Other columns are left aside. An empty table gives none.

    A text that a third of all rows share is never gathered: within a
    partition its fingerprint is sent once, and equal texts meet in
    aggregates that combine before the shuffle.
    """
    work = Workspace(docs.sparkSession)
    owners = owners or max(1, shuffle_partitions(docs.sparkSession), -(-docs.count() // OWNED))
    sent = work.put(fingerprints(docs, owners, text, key))
    lists = sent.where(F.col("owner").isNotNull()).select(*LISTS)
    rows = sent.where(F.col("owner").isNull()).select("part", "doc_id", "print", "code_points", "text_sha256")
    known = work.put(suspects(lists, duplicate_bitmaps(lists, owners), owners))
    found = work.put(rows.join(known.withColumn("suspect", F.lit(True)), ["part", "print"], "left"))

    texts = suspected_texts(docs, Bloom(known.select("print").distinct()), text, key)
    best = F.max(F.struct("n", F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("negative")))
    groups = texts.groupBy("plain").agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    groups = work.put(groups.select(F.sha2("plain", 256).alias("text_sha256"), (-F.col("best.negative")).alias("keep"), F.col("best.n").alias("most"), "size"))
    alone = found.where(F.col("suspect").isNull()).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    checked = lookup(found.where("suspect"), groups.withColumn("rows", F.col("size")), ["text_sha256"], "rows")
    checked = checked.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("code_points") == F.col("most"))).alias("kept"), "text_sha256")
    return alone.unionByName(checked)
