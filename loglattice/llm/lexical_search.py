"""Ranked lexical search by MaxScore, shard by shard.

``build_index`` writes, for each shard (a few MB of texts), one row a term
with the documents that hold it and how often, and one row with the shard's
documents. A search reads the rows of its items' terms, sums their document
counts, and goes through the shards: an item's terms are ordered by the most
that each can add in the shard, and the longest run of them that together stay
below the item's 20th best score so far is not essential. Only documents of
essential lists are scored; the other lists are probed for those documents
alone, from the strongest to the weakest, and only while what is left could
still bring a document among the best. Thresholds go on from shard to shard
within a task, and a task returns its best documents only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, steps, text_or_empty

#: Bytes of text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Bytes of items' texts that one search takes to the executors; more items are searched for in several blocks.
BLOCK_BYTES = 8 << 20

#: From bytes to what terms are made of: other ASCII characters become blanks, A-Z lower case.
FOLD = bytes(0x20 if c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80 else c + 32 if 0x41 <= c < 0x5B else c for c in range(256))

INDEX = "shard long, term string, n long, total long, docs binary, counts binary, known binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(df: int, n_docs: int) -> int:
    """A term's weight, in doubles: a term of every document weighs 0."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _shard(number: int, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The rows of one shard: its documents under the empty term, then each term's documents in order of place."""
    numbers: dict[bytes, int] = {}
    per, lengths, held = [], [], []
    for place, text in enumerate(texts.to_pylist()):
        own = terms_of(text)
        if own:
            held.append(place)
            lengths.append(len(own))
            per.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in own), np.int64, len(own)))
    ids = keys.take(pa.array(held, pa.int64()))
    rows = {"term": [""], "n": [len(held)], "total": [sum(lengths)]}
    rows |= {"docs": [np.array(ids.fill_null(0), "<i8").tobytes()], "counts": [np.array(lengths, "<i8").tobytes()], "known": [np.array(ids.is_valid(), np.uint8).tobytes()]}
    if held:
        size = len(held)
        pairs, counts = np.unique(np.concatenate(per) * size + np.repeat(np.arange(size), lengths), return_counts=True)
        places, counts, cuts = (pairs % size).astype("<i4"), counts.astype("<i4"), np.flatnonzero(np.diff(pairs // size, prepend=-1)).tolist()
        ends = [*cuts[1:], len(pairs)]
        rows["term"] += [t.decode("utf-8", "replace") for t in numbers]
        rows["n"] += [b - a for a, b in zip(cuts, ends, strict=True)]
        rows["docs"] += [places[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        rows["counts"] += [counts[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
    more = len(numbers)
    columns = [pa.array(np.full(more + 1, number)), pa.array(rows["term"], pa.string()), pa.array(rows["n"], pa.int64()), pa.array(rows["total"] + [None] * more, pa.int64()), pa.array(rows["docs"], pa.binary()), pa.array(rows["counts"], pa.binary()), pa.array(rows["known"] + [None] * more, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "total", "docs", "counts", "known"])


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index rows of all documents, made beside them without a shuffle; write them before searching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rows = _shard(number, both.column(0), both.column(1))
            for at in range(0, rows.num_rows, 1 << 14):
                yield rows.slice(at, 1 << 14)

        for batch in steps(batches, "t", shard_bytes):
            own = batch.column(1).nbytes
            if held and size + own > shard_bytes:
                yield from shard()
                number, held, size = number + 1, [], 0
            held, size = [*held, batch], size + own
        if held:
            yield from shard()

    narrow = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).cast("binary").alias("t"))
    return narrow.mapInArrow(run, INDEX)


@dataclass
class Query:
    """An item's terms as numbers, each once, and how often it has them."""

    terms: list[int]
    times: list[int]


class Best:
    """The best documents of one item so far: highest score, then smallest doc_id, a null one last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """The least score with which a document can still come in."""
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        own = zip((-scores).tolist(), (known == 0).tolist(), ids.tolist(), strict=True)
        self.rows = sorted([*self.rows, *own])[: self.k]


class Shard:
    """A shard's lists for the terms of a search, scored once for all items."""

    def __init__(self, header: dict, lists: list[dict], weights: list[int], n_docs: int, n_terms: int):
        self.ids, self.known = np.frombuffer(header["docs"], "<i8"), np.frombuffer(header["known"], np.uint8)
        # Python's integers, as the product may pass 64 bits where a whole corpus meets one very long text.
        lengths = np.frombuffer(header["counts"], "<i8")
        longest = int(lengths.max(initial=0))
        share = (25 * lengths * n_docs) // n_terms if 25 * longest * n_docs < 1 << 63 else np.array([25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        m = 75 + share
        self.places, self.adds, self.most = {}, {}, {}
        for r in lists:
            places, tf = np.frombuffer(r["docs"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(np.int64)
            adds = weights[r["number"]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[places]))
            if (top := int(adds.max())) > 0:
                self.places[r["number"]], self.adds[r["number"]], self.most[r["number"]] = places, adds, top

    def search(self, query: Query, best: Best) -> None:
        own = sorted((self.most[t] * q, t, q) for t, q in zip(query.terms, query.times, strict=True) if t in self.most)
        bounds = np.cumsum([0, *(b for b, _, _ in own)])  # the most that the weakest i lists add together
        floor = best.floor
        if bounds[-1] < floor:
            return
        split = int(np.searchsorted(bounds[1:], floor))  # lists before it stay below the floor even together
        total = np.zeros(len(self.ids), np.int64)
        for _, t, q in own[split:]:
            total[self.places[t]] += self.adds[t] * q
        found = np.flatnonzero((total > 0) & (total + bounds[split] >= floor))
        score = total[found]
        for i in range(split - 1, -1, -1):
            if not len(found):
                return
            _, t, q = own[i]
            places = self.places[t]
            at = np.minimum(np.searchsorted(places, found), len(places) - 1)
            score = score + np.where(places[at] == found, self.adds[t][at] * q, 0)
            able = score + bounds[i] >= floor
            found, score = found[able], score[able]
        if len(found) > best.k:
            able = score >= np.partition(score, -best.k)[-best.k]  # with all that are equal to the k-th best of the shard
            found, score = found[able], score[able]
            first = np.lexsort((self.ids[found], self.known[found] == 0, -score))[: best.k]
            found, score = found[first], score[first]
        if len(found):
            best.add(score, self.ids[found], self.known[found])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Header and lists of one shard after another, from rows in order of shards, headers first."""
    header, lists = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["number"] < 0:
                if header is not None:
                    yield header, lists
                header, lists = r, []
            else:
                lists.append(r)
    if header is not None:
        yield header, lists


def _block(index: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(item, score, known, doc_id): the best documents of every task for a block of items (place, text)."""
    spark = index.sparkSession
    numbers: dict[str, int] = {}
    queries = []
    for place, text in items:
        times = Counter(t.decode("utf-8", "replace") for t in terms_of((text or "").encode("utf-8", "replace")))
        queries.append((place, Query([numbers.setdefault(t, len(numbers)) for t in times], list(times.values()))))
    # No more terms than the block's bytes, so the broadcast is bounded by BLOCK_BYTES.
    wanted = spark.createDataFrame([("", -1), *numbers.items()], "term string, number int")
    hits = index.join(F.broadcast(wanted), "term").select("shard", "number", "n", "total", "docs", "counts", "known")
    counts = {r["number"]: (r["n"], r["total"]) for r in hits.groupBy("number").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toLocalIterator()}
    n_docs, n_terms = counts.pop(-1, (0, 0))
    weights = [weight(counts[i][0], n_docs) if i in counts else 0 for i in range(len(numbers))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for header, lists in _shards(batches):
            shard = Shard(header, lists, weights, n_docs, max(1, n_terms))
            for (_, query), own in zip(queries, best, strict=True):
                shard.search(query, own)
        rows = [(place, -negative, not unknown, doc_id) for (place, _), own in zip(queries, best, strict=True) for negative, unknown, doc_id in own.rows]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["place", "score", "known", "doc_id"])

    dealt = hits.repartition("shard").sortWithinPartitions("shard", "number")
    return dealt.mapInArrow(run, "place long, score long, known boolean, doc_id long")


def search(index: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    Ranks are from 1, the highest score first, then the smallest doc_id, a
    null one last. Items are taken in blocks of about ``block_bytes`` of text;
    each block reads its terms' rows of ``index``.
    """
    work = Workspace(items.sparkSession)
    named = items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text"))
    named = work.put(named.select("item_id", "text", F.monotonically_increasing_id().alias("place"), (F.octet_length(F.coalesce("text", F.lit(""))) + 64).cast("long").alias("size")))
    size, n = named.agg(F.sum("size"), F.count(F.lit(1))).first()
    blocks = max(1, min(n, math.ceil((size or 0) / block_bytes)))
    found = None
    for b in range(blocks):
        own = named.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b) if blocks > 1 else named
        part = _block(index, [(r["place"], r["text"]) for r in own.select("place", "text").toLocalIterator()], k)
        found = part if found is None else found.unionByName(part)
    first = Window.partitionBy("place").orderBy(F.desc("score"), F.desc("known"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.join(named.select("place", "item_id"), "place").select("item_id", "rank", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Indexes all documents and searches for all items; see ``search``.

    A row is a document of its own, repeated or not; null keys and extra
    columns are no matter. Null texts and texts without a term are no
    documents and are never found; items without one find nothing. Equal
    items find the same. An empty table gives no row.
    """
    work = Workspace(docs.sparkSession)
    return search(work.put(build_index(docs)), items, k)
