"""How filters interact: which of them removes what, in every order of application.

A document is nothing but the set of filters that it fails, so a part of the
corpus is a histogram over 32 such masks. What every step of every order
keeps, removes, finds already removed or alone removes is linear in that
histogram: fixed integer matrices of 32 masks by 600 (order, step) columns say
which masks count where, and one product with the stacked histograms (all,
good and toxic documents of each part) gives the whole audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import steps, text_or_empty

#: A filter's place is its bit in a mask.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
#: Characters of filter D.
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
FOLLOWING = bytes(range(0x80, 0xC0))


def own_mask(text: bytes) -> int:
    """The filters A to D that a text fails; E needs the whole table."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, FOLLOWING)))
    upper = len(text) - len(text.translate(None, UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * points) << 2 | (len(text) != len(text.translate(None, SYMBOLS))) << 3


def incidence() -> dict[str, np.ndarray]:
    """Integer matrices of masks by (order, step): which masks a step keeps, removes, finds removed before, or alone would remove."""
    out = {name: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for name in ("kept", "removed", "redundant", "unique_fails")}
    masks = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        before = 0
        for s, letter in enumerate(order):
            own, column = 1 << FILTERS.index(letter), o * len(FILTERS) + s
            fails, gone = masks & own != 0, masks & before != 0
            out["removed"][:, column] = fails & ~gone
            out["redundant"][:, column] = fails & gone
            out["unique_fails"][:, column] = masks == own
            before |= own
            out["kept"][:, column] = masks & before == 0
    return out


def shares() -> np.ndarray:
    """Masks by (order, step): in how many of all orders the step's filter removes a mask."""
    removed, own = incidence()["removed"], np.array([FILTERS.index(letter) for order in ORDERS for letter in order])
    by_filter = np.stack([removed[:, own == i].sum(axis=1) for i in range(len(FILTERS))], axis=1)
    return by_filter[:, own]


def failures(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(doc_id, part, sha, mask) of every row: the filters A to D that its whole text fails, and the text's digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("sha", pa.binary()), ("mask", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([own_mask(t) for t in texts], pa.int32())], schema=schema)

    narrow = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("p"), text_or_empty(text).cast("binary").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, part string, sha binary, mask int")


def histograms(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just these filters.

    A row's text is a copy if a row with a smaller doc_id, wherever it is, has
    the same text. Rows that repeat a text under one doc_id aren't copies of
    each other; a null doc_id is neither smaller nor larger than any. A
    document is good or toxic if any of its labels says so.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = failures(docs, text, key, part).groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # The rows of a text come down to one for each part and label, so no task gathers a text's copies.
    apart = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = rows.groupBy("sha", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), apart.alias("apart"))
    first = F.min("least").over(Window.partitionBy("sha"))
    texts = texts.withColumn("stay", F.col("apart") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    each = texts.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "good", "toxic", "m.mask", "m.n")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame) -> DataFrame:
    """The product of stacked histograms with the incidence matrices: 600 rows for each part of ``counts``."""
    columns = len(ORDERS) * len(FILTERS)
    own = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 32 masks at most

    def row(name: str) -> Column:
        return F.array(*[F.coalesce(F.col("at")[i][name], F.lit(0)).cast("long") for i in range(MASKS)]).alias(name)

    stacked = counts.groupBy("part").agg(own.alias("at")).select("part", row("n"), row("good"), row("toxic"))
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, share = incidence(), shares()
        orders = pa.array([order for order in ORDERS for _ in FILTERS])
        at = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for part, n, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.array([n, good, toxic], np.int64)
                found = {name: h @ m for name, m in by.items()}
                values = [*(found[name][0] for name in COUNTS[:4]), found["removed"][1], found["removed"][2], h[0] @ share]
                yield pa.RecordBatch.from_arrays([pa.array([part] * columns, pa.string()), orders, at, *map(pa.array, values)], schema=schema)

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row for each part, each of the 120 orders of the five filters, and each step.

    A: under 200 words; B: fewer than half of the words distinct; C: more than
    3 % of code points in A-Z; D: a character of ``#$%&*|``; E: a copy, see
    ``histograms``, which also says what repeated rows and null keys count
    as. Null and empty texts have no words and so fail A alone, and E where
    one came before. A null part is the empty string. Labels of unknown
    documents and other columns, whatever their names, are left aside. An
    empty table gives no row; empty labels give no losses.
    """
    return audit(histograms(docs, labels, text, key, part))
