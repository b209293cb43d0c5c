"""Exact counts of distinct runs that merge: dense numbers of runs, and a bitmap of them for each day and key.

Counts of distinct runs don't add up over days or keys, bitmaps do: a stored
day answers for any coarser grouping, for weeks and together with days of
other ingests, and the events aren't read again. A bitmap is a word of 64 runs,
so its size is that of what it holds and sums of words need no sort. Numbers
follow the first day and key of a run, so the runs of a day and key lie in few
words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import round2
from .usage_cube import grouped_by_sets

RUN = ("tool", "session_id")
KEYS = ("date", "tool", "provider", "model", "project")
#: Parts of a day that are numbered by themselves: parts of its keys times parts of each key's runs.
KEY_PARTS, RUN_PARTS = 16, 4
#: Runs in one word.
WORD = 64


def numbered(base: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tool, session_id, run) of the runs of facts that ``known`` (same columns) doesn't have yet: numbers without gaps, from 1 or behind the known ones.

    A run is a tool and a session; where either is null there is none. The sums
    over parts of days are one task of 64 rows a day. Runs of one first key are
    neighbours in their part.
    """
    of_first = ("date", "provider", "model", "project")
    runs = base.where(F.col("tool").isNotNull() & F.col("session_id").isNotNull()).groupBy(*RUN).agg(F.min(F.struct(*of_first)).alias("f"))
    runs = runs.select(*RUN, F.col("f.date").alias("first"), *[F.col(f"f.{c}").alias(c) for c in of_first[1:]])
    before = base.sparkSession.range(1).select(F.lit(0).cast("long").alias("before"))
    if known is not None:
        runs = runs.join(known, list(RUN), "left_anti")
        before = known.agg(F.coalesce(F.max("run"), F.lit(0)).alias("before"))
    order = ("tool", *of_first[1:])
    runs = runs.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(KEY_PARTS)) * RUN_PARTS + F.pmod(F.xxhash64(*RUN), F.lit(RUN_PARTS)))
    counts = runs.groupBy("first", "part").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("first", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("start"))
    placed = runs.withColumn("place", F.row_number().over(Window.partitionBy("first", "part").orderBy(*order, "session_id")))
    # ``before`` is one row
    return placed.join(starts, ["first", "part"]).crossJoin(F.broadcast(before)).select(*RUN, (F.col("before") + F.col("start") + F.col("place")).cast("long").alias("run"))


def day_bitmaps(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(date, tool, provider, model, project, part, runs, tokens, cost, messages): a word of the runs of each day and key in each part of the numbers.

    A fact is counted in its run's part, so sums over parts are whole; facts
    without a run have part and word null. There are never more rows than
    days, keys and runs that go together.
    """
    named = base.join(ids, list(RUN), "left").withColumns({"part": F.floor(F.col("run") / WORD), "bit": F.expr(f"shiftleft(1L, cast(run % {WORD} as int))")})
    return named.groupBy(*KEYS, "part").agg(F.bit_or("bit").alias("runs"), *_sums())


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("tokens", "cost", "messages")]


def _merged() -> list[Column]:
    return [F.bit_or("runs").alias("runs"), *_sums()]


def _measures() -> list[Column]:
    return [F.sum("tokens").cast("long").alias("tokens"), round2(F.sum("cost")).alias("cost_usd"), F.coalesce(F.sum(F.bit_count("runs")), F.lit(0)).cast("long").alias("session_count"), F.sum("messages").cast("long").alias("messages")]


def grouped(stored: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, tokens, cost_usd, session_count, messages) of ``day_bitmaps`` rows, for any grouping of theirs; a run counts once a group."""
    parts = stored.groupBy(*keys, "part").agg(*_merged())
    return parts.groupBy(*[c for c in parts.columns if c not in ("part", "runs", "tokens", "cost", "messages")]).agg(*_measures())


def grouping_sets(stored: DataFrame) -> DataFrame:
    """What ``usage_cube.grouping_sets`` gives, from stored bitmaps."""
    parts = grouped_by_sets(stored, _merged(), ("part",))
    return parts.groupBy("slot", *KEYS).agg(*_measures())
