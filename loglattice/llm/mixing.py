"""Mixes sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size is taken r times on
average: its whole part for certain, and a fraction that rounding decides.
Pairs of fractional documents move mass between each other, weighted by their
sizes so that the words taken stay the same, up or down with the odds that
keep every document's expectation, until one of the two is 0 or 1. A batch of
a source leaves at most one fractional document; these residuals meet in a
reduction tree until one is left in each source.
"""

from __future__ import annotations

import hashlib
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, text_or_empty

#: Fixed values of the target mix: weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents that are rounded together, and residuals that meet at each step of the tree.
BATCH_ROWS = 1024
FAN_IN = 256
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Targets share the total by weight and stop at ``most`` times a source's
    size; the excess is shared again by weight until none is above. In closed
    form: in ascending order of size over weight, sources are capped as long
    as the share that is left for their weight exceeds their cap. A weight
    follows from a source's place among all and a cap from all that are
    smaller, so sources meet in one task, one short row each, which it can
    spill; it is meant for up to some millions of sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = filled.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    shared = shared.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    shared = shared.withColumn("level", F.first(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(everything))
    return shared.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size) of every row; size is the number of words."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"))


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"))


def pivot(share: np.ndarray, size: np.ndarray, random: Random) -> np.ndarray:
    """Weighted pivotal rounding in order: all shares become 0 or 1 but for at most one, and sum(size * share) stays."""
    share = share.tolist()
    weight = size.tolist()
    held = None
    for i, p in enumerate(share):
        if not 0.0 < p < 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b = weight[held], weight[i]
        up = min((1.0 - share[held]) * a, p * b)  # mass that may move to the held one
        down = min(share[held] * a, (1.0 - p) * b)  # and from it
        if random.random() * (up + down) < down:
            moved, other_full = up, p * b
            gain = 1
        else:
            moved, other_full = down, (1.0 - p) * b
            gain = -1
        if moved == other_full:
            share[i] = 0.0 if gain > 0 else 1.0
            share[held] += gain * moved / a
        else:
            share[held] = 1.0 if gain > 0 else 0.0
            share[i] = p - gain * moved / b
            held = i
        if not 1e-12 < share[held] < 1.0 - 1e-12:
            share[held] = round(share[held])
            held = None
    return np.array(share)


def settle(share: np.ndarray, size: np.ndarray, random: Random) -> np.ndarray:
    """Rounds the last batch of a source, sizes descending, so that what can't be rounded exactly is short.

    Documents of one order of magnitude are rounded together; a fraction that
    is left is drawn, and the words gained or lost by the draw are spread over
    the shares of the shorter documents, which are rounded next. Shares stay
    within 0 and 1. Over all draws a share keeps its expectation but where it
    is cut off at 0 or 1: an error is at most the drawn document's size, and
    the shares of shorter ones move by that over their sizes' sum. Only the
    last batch of a source, one residual for each of at most ``FAN_IN``
    batches, or ``BATCH_ROWS`` documents of a small source, is touched.
    """
    share, orders = share.astype(float).copy(), np.array([int(s).bit_length() for s in size])
    for order in sorted(set(orders.tolist()), reverse=True):
        own = np.flatnonzero(orders == order)
        share[own] = pivot(share[own], size[own], random)
        for i in own[(share[own] > 0) & (share[own] < 1)]:
            drawn = float(random.random() < share[i])
            error, share[i] = (share[i] - drawn) * size[i], drawn
            rest = np.flatnonzero((orders < order) & (share > 0) & (share < 1))
            if len(rest):
                share[rest] = np.clip(share[rest] + error / size[rest].sum(), 0.0, 1.0)
    return share


ROWS = "doc_id long, source string, size long, source_size long, target double, whole long, share double, batch long"


def _round(level: int, last: bool):
    """Rounds one batch of one source; at the last level what is still fractional is drawn."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: they meet many shorter ones and become integral, so that what is left at the end is short.
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last", ignore_index=True)
        name = f"{SEED} {level} {rows['source'].iloc[0]!r} {rows['slot'].iloc[0]}"
        random = Random(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        share = (settle if last else pivot)(rows["share"].to_numpy(), rows["size"].to_numpy(), random)
        return rows.assign(share=share, batch=rows["slot"]).drop(columns=["slot"])

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES, text: str = "text", key: str = "doc_id", source: str = "source", batch_rows: int = BATCH_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies): how often each row is taken, and its words times that.

    Size is the number of words of the text (null: 0). A null source is a
    source of its own, the last. Rows without words are taken 0 times. Rows
    that repeat count each and are rounded each. Batches are hashes of key and
    size, so every source, however large, is rounded in many tasks. Results
    follow from keys and sizes alone, so reruns agree. Other columns are left
    aside; an empty table gives no row.
    """
    work = Workspace(docs.sparkSession)
    rows = work.put(sized(docs, text, key, source))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    goal = targets(source_sizes(rows), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumnRenamed("source", "of").join(goal, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("share", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rows = rows.withColumn("share", F.when(F.col("share") < 1e-9, 0.0).otherwise(F.col("share"))).drop("rate")
    batches = max(1, -(-(counts[0] or 0) // batch_rows))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "size"), F.lit(batches)))
    done, level = [], 0
    while True:
        last = batches == 1
        rows = rows.withColumn("slot", F.col("batch"))
        rounded = rows.groupBy("source", "slot").applyInPandas(_round(level, last), ROWS)
        if last:
            done.append(rounded)
            break
        rounded = work.put(rounded)
        open_rows = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(rounded.where(~open_rows))
        batches = -(-batches // fan_in)
        rows = rounded.where(open_rows).withColumn("batch", F.floor(F.col("batch") / fan_in).cast("long"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("share").cast("long")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))
