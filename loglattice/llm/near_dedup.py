"""Near-duplicate documents by MinHash: banding, signature verification, full sets, connected components.

1. Every document becomes the set of its word shingles and, over many
   universal hash functions, that set's minima. Documents with the same words
   are one class; only a class's smallest document goes on.
2. Minima in groups (bands) give buckets. In every bucket each document is
   paired with the bucket's smallest, so a bucket gives as many pairs as it has
   documents.
3. Pairs whose signatures agree too little are dropped, far below the limit;
   the others are confirmed on their full sets. Only their texts move.
4. Links make components. Buckets that still hold several components, and
   more than the pair already tried, compare the signatures of documents of
   different components, block by block; pairs that agree are confirmed, too,
   so that no link between components is lost.
5. Links of both steps make the final components, by alternating large-star
   and small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Workspace, lookup, mix64, steps, text_or_empty, word_ids
from .components import components

BANDS, ROWS = 32, 5
SEED = 11
#: Pairs go to their full sets if signatures agree in this share less than the limit: six standard deviations.
SLACK = 0.18
#: Documents of a bucket that are compared at once with as many others.
BLOCK = 512
#: Shingles that make a document count for one in its block; longer ones count for more.
LONG = 2000
#: Documents that meet one centre of pairs in a task.
MEMBERS = 256

_random = np.random.default_rng(SEED)
#: The universal family: the high half of a * x + b modulo 2 ** 64, a odd.
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
MIXES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles; a shorter text's words are one shingle together; no words, none."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    ids = word_ids(words)
    n = len(ids) - size + 1
    found = np.zeros(n, np.uint64)
    for i in range(size):
        found = mix64(found + ids[i : i + n] * MIXES[i % len(MIXES)] + np.uint64(i))
    return np.unique(found)


def minima(found: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The minimum under each function of the family, 32 bits each."""
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    if len(found) <= 2 * chunk:
        for at in range(0, len(found), chunk):
            out = np.minimum(out, (FACTORS[:, None] * found[None, at : at + chunk] + TERMS[:, None]).min(axis=1))
        return out >> np.uint64(32)
    values = np.empty(16 * chunk, np.uint64)
    for at in range(0, len(found), len(values)):
        part = found[at : at + len(values)]
        for i in range(len(FACTORS)):
            np.multiply(part, FACTORS[i], out=values[: len(part)])
            np.add(values[: len(part)], TERMS[i], out=values[: len(part)])
            out[i] = min(out[i], values[: len(part)].min())
    return out >> np.uint64(32)


NODES = "doc_id long, n_shingles long, class_a long, class_b long, bands array<long>, signature binary"


def nodes(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Set size, 128-bit digest of the lower-cased words, band keys and signature (the low byte of each minimum) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)
        for part in steps(batches, "t"):
            counts, a, b, bands, signs = [], [], [], [], []
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = shingles(t, size)
                counts.append(len(found))
                if not len(found) or k is None:
                    for x in (a, b, bands, signs):
                        x.append(None)
                    continue
                digest = hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest()
                a.append(int.from_bytes(digest[:8], "big", signed=True))
                b.append(int.from_bytes(digest[8:], "big", signed=True))
                least = minima(found)
                keys = salt
                for row in least.reshape(BANDS, ROWS).T:
                    keys = mix64(keys * MIXES[0] + row)
                bands.append(keys.view(np.int64))
                signs.append(least.astype(np.uint8).tobytes())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip((counts, a, b, bands, signs), types, strict=True))], ["doc_id", "n_shingles", "class_a", "class_b", "bands", "signature"])

    narrow = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).cast("binary").alias("t"))
    return narrow.mapInArrow(run, NODES)


def agreeing(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, n) whose signatures agree well enough to be worth their full sets."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
                yield batch.select(["u", "v", "n"]).filter(pa.array((x == y).mean(axis=1) >= least))

    one = signatures.select(F.col("doc_id").alias("u"), F.col("signature").alias("x"))
    two = signatures.select(F.col("doc_id").alias("v"), F.col("signature").alias("y"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "n", "x", "y").mapInArrow(run, "u long, v long, n long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def texts_of(docs: DataFrame, ids: DataFrame, work: Workspace, text: str, key: str) -> DataFrame:
    """(doc_id, t) of the documents ``ids`` and of a few others, as a Bloom filter lets them pass; written, nothing is shuffled."""
    known = Bloom(ids.select(F.xxhash64("doc_id").alias("h")))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("t"))
    return work.put(texts.where(known.column(F.xxhash64("doc_id"))))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, work: Workspace, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pairs whose full shingle sets pass the limit. ``pairs``: written (u, v, n), ``n`` the pairs of v at most.

    Only texts of documents in pairs are shuffled. A centre v is sent once to
    every ``MEMBERS`` of its partners, not with each, and rows pass one by
    one, so neither a hot centre nor long texts gather.
    """
    texts = texts_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), work, text, key)
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64(F.lit("member"), "u"), blocks).cast("int"))
    members = dealt.join(texts, dealt["u"] == texts["doc_id"]).select("v", "block", "u", "t")
    centres = pairs.groupBy("v").agg(F.max(blocks).alias("blocks")).select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    centres = centres.join(texts, centres["v"] == texts["doc_id"]).select("v", "block", F.lit(None).cast("long").alias("u"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sets = None, []
        for part in steps(batches, "t"):
            hit = []
            for v, block, u, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != (v, block):
                    own, sets = (v, block), []
                if u is None:
                    sets.append(shingles(t, size))
                else:
                    found = shingles(t, size)
                    if any(linked(found, x, percent) for x in sets):
                        hit.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in hit], pa.int64()) for i in (0, 1)], ["u", "v"])

    together = members.unionByName(centres).repartition("v", "block").sortWithinPartitions("v", "block", F.col("u").asc_nulls_first())
    return together.select("v", "block", "u", "t").mapInArrow(run, "u long, v long").distinct()


def rest_of_buckets(members: DataFrame, grouped: DataFrame, shown: DataFrame, docs: DataFrame, size: int, percent: int, work: Workspace, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Links (u, v) between different components that share a bucket, confirmed on full sets, in blocks.

    ``members``: (bucket, doc_id, weight) of buckets with three documents
    or more; ``grouped``: (u, v), document and component, where it has one;
    ``shown``: bands and signatures. A bucket's documents are dealt to blocks
    of about ``BLOCK`` (of longer documents fewer): those of a component that
    fills blocks to blocks of its own, all others together. Each two blocks
    meet in a task of their own, so none holds more than two; two blocks of
    one component have nothing to compare and don't meet. Two documents are
    compared in the first bucket that both are in.

    Signatures meet first; texts follow only of documents with a signature
    that agrees, so they aren't moved for all pairs of blocks. A task returns
    no more links than it takes to join its components.
    """
    least = percent / 100 - SLACK
    placed = members.join(grouped, members["doc_id"] == grouped["u"], "left").select("bucket", "doc_id", "weight", F.coalesce("v", "doc_id").alias("component"))
    placed = work.put(placed)
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    large = F.col("weight") >= BLOCK
    own = F.when(large, F.struct("component", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")))
    figures = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("n"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("weight"))) / BLOCK).cast("int").alias("mixed"), F.sort_array(F.collect_list(own)).alias("large"))
    figures = work.put(figures.where("components > 1").drop("components"))
    # blocks are numbered: the mixed ones, then those of each large component in turn
    rows = lookup(placed, figures, ["bucket"])

    def blocks(of: Column) -> Column:
        return F.aggregate(of, F.lit(0), lambda total, x: total + x["blocks"])

    at = F.array_position(F.transform("large", lambda x: x["component"]), F.col("component")).cast("int")
    rows = rows.withColumn("at", at).withColumn("total", F.col("mixed") + blocks(F.col("large")))
    rows = rows.withColumn("start", F.when(F.col("at") > 0, F.col("mixed") + blocks(F.slice("large", 1, F.col("at") - 1))))
    rows = rows.withColumn("end", F.col("start") + F.get("large", F.col("at") - 1)["blocks"])
    block = F.coalesce("start", F.lit(0)) + F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.coalesce(F.col("end") - F.col("start"), F.col("mixed"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: F.col("start").isNull() | (o < F.col("start")) | (o >= F.col("end")))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    rows = work.put(rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component"))

    def compared(texts: bool):
        def compare(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("doc_id", ignore_index=True)
            i, j, bucket = (int(group[c].iloc[0]) for c in ("i", "j", "bucket"))
            signs = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
            bands = np.stack(group["bands"].to_numpy())
            before = bands[:, : int(np.flatnonzero(bands[0] == bucket)[0])]
            ids, own = group["doc_id"].to_numpy(), group["block"].to_numpy()
            comps = group["component"].to_numpy().copy()
            sets: dict[int, np.ndarray] = {}
            links, agreed = [], np.zeros(len(ids), bool)

            def full(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(group["t"].iloc[k], size)
                return sets[k]

            for k in np.flatnonzero(own == i):
                other = np.flatnonzero((own == j) & (comps != comps[k]))
                if i == j:
                    other = other[other > k]
                other = other[(signs[other] == signs[k]).mean(axis=1) >= least]
                other = other[~(before[other] == before[k]).any(axis=1)]
                if not texts:
                    agreed[other] = True
                    agreed[k] |= len(other) > 0
                    continue
                for o in other:
                    if comps[o] != comps[k] and linked(full(k), full(o), percent):
                        links.append((ids[k], ids[o]))
                        comps[comps == comps[o]] = comps[k]
            return pd.DataFrame(links, columns=["u", "v"], dtype="int64") if texts else group.loc[agreed, ["bucket", "i", "j", "block", "doc_id", "component"]]

        return compare

    agreed = rows.join(shown, "doc_id").groupBy("bucket", "i", "j").applyInPandas(compared(False), "bucket long, i int, j int, block int, doc_id long, component long")
    agreed = work.put(agreed)
    work.drop(rows)
    texts = texts_of(docs, agreed.select("doc_id").distinct(), work, text, key)
    return agreed.join(shown, "doc_id").join(texts, "doc_id").groupBy("bucket", "i", "j").applyInPandas(compared(True), "u long, v long")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the component of near-duplicates of every row.

    Words are lower-cased (A-Z) and taken in shingles of ``size``; documents
    are linked if 100 * intersection >= ``percent`` * union of their distinct
    shingles. A text of fewer words is one shingle. A null or empty text, or
    one without words, has no shingles and no links, nor has a row with a null
    key; its component is its own key. ``kept`` marks the smallest key of a
    component. Rows that share a key are one document with several texts.
    Other columns are left aside; an empty table gives no row.

    Banding misses a link at the very limit with a chance of (1 - p ** ROWS) ** BANDS,
    which is below 1e-8 at 85 % and below 1e-5 at 80 %.
    """
    work = Workspace(docs.sparkSession)
    every = work.put(nodes(docs, size, text, key))
    classes = every.where(F.col("class_a").isNotNull()).groupBy("class_a", "class_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = work.put(classes)
    weight = F.greatest(F.lit(1), F.col("n_shingles") / LONG).cast("int")
    shown = work.put(every.join(classes.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "bands", "signature", weight.alias("weight")))
    signed = shown.select("doc_id", "bands", "signature")

    banded = shown.select("doc_id", "weight", F.explode("bands").alias("bucket"))
    buckets = work.put(banded.groupBy("bucket").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = work.put(lookup(banded, buckets.withColumn("size", F.col("n")), ["bucket"]))
    star = members.where("doc_id <> v").groupBy(F.col("doc_id").alias("u"), "v").agg(F.max("size").alias("n"))
    star = work.put(agreeing(star, signed, percent))
    grouped = components(work.put(confirmed(star, docs, size, percent, work, text, key)), work)

    more = work.put(rest_of_buckets(members.where("size > 2").select("bucket", "doc_id", "weight"), grouped, signed, docs, size, percent, work, text, key))
    if more.limit(1).count():
        grouped = components(grouped.unionByName(more), work)

    # a class's component comes from its first document, so it is found once a class
    of_class = classes.join(grouped, classes["first"] == grouped["u"], "left").select("class_a", "class_b", "n", F.coalesce("v", "first").alias("component_id"))
    rows = every.select("doc_id", "n_shingles", "class_a", "class_b")
    alone = rows.where(F.col("class_a").isNull()).withColumn("component_id", F.col("doc_id"))
    named = lookup(rows, work.put(of_class), ["class_a", "class_b"]).unionByName(alone)
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
