"""Forward fill with values carried over blocks, against a plain loop."""

from __future__ import annotations

import random

import pytest
from loglattice.operators.usage_events import forward_fill
from pyspark.sql import functions as F

SCHEMA = "file_path string, line_no long, x long, y string, block string"


def plain(rows):
    out, last = [], {}
    for f, n, x, y, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seen = last.setdefault(f, [None, None])
        seen[0] = x if x is not None else seen[0]
        seen[1] = (y, n) if y is not None else seen[1]
        out.append((f, n, x, y, b, seen[0], seen[1]))
    return sorted(out, key=str)


def table(seed=1):
    """A file with most of the lines, files that begin with nulls, a null path, gaps in line numbers, a column named like an inner one."""
    r = random.Random(seed)
    rows = []
    for f, n, rate in (("hot", 3000, 0.01), ("dense", 200, 0.7), ("never", 150, 0.0), ("one", 1, 1.0), (None, 90, 0.1)):
        at = 0
        for _ in range(n):
            at += r.choice([1, 1, 1, 40])
            rows.append((f, at, r.randrange(99) if r.random() < rate else None, f"y{r.randrange(9)}" if r.random() < rate else None, "own"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 7, 500, 1 << 16])
def test_fill_is_the_same_with_any_blocks(spark, block):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    named = F.when(F.col("y").isNotNull(), F.struct("y", "line_no"))
    got = forward_fill(frame, {"last_x": F.col("x"), "last_y": named}, block=block).collect()
    assert sorted(((*r[:6], tuple(r[6]) if r[6] else None) for r in got), key=str) == plain(rows)


def test_a_hot_file_is_filled_by_many_tasks(spark):
    rows = [("hot", i, i if i % 5000 == 0 else None, None, None) for i in range(20_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = forward_fill(spark.createDataFrame(rows, SCHEMA), {"last_x": F.col("x")}, block=500)
        shares = filled.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(r["count"] for r in shares) < 12_000
    assert filled.where("last_x <> floor(line_no / 5000) * 5000 or last_x is null").count() == 0


def test_an_empty_table(spark):
    assert forward_fill(spark.createDataFrame([], SCHEMA), {"last_x": F.col("x")}).count() == 0
