from __future__ import annotations

import json

from loglattice.operators import session_index
from loglattice.streaming import live
from pyspark.sql import functions as F

from .test_usage import EVENT, event


def batches(spark, root, checkpoint):
    """What one run of the stream hands over, and where it ends."""
    seen = []
    live.into(live.followed(spark, str(root), "claude"), lambda batch: seen.extend(batch.select("file_path", "line_no", F.to_json("v").alias("v")).collect()), str(checkpoint)).awaitTermination()
    return sorted((r.file_path.rsplit("/", 1)[1], r.line_no, json.loads(r.v)["n"]) for r in seen)


def test_files_that_appear_and_grow_are_followed(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    first, second = tmp_path / "in/a/s.jsonl", tmp_path / "in/a/t.jsonl"
    first.write_text('{"n": 1}\nnot json\n{"n": 2}\n{"n": 3')
    assert batches(spark, tmp_path / "in", tmp_path / "c") == [("s.jsonl", 0, 1), ("s.jsonl", 2, 2)]
    first.write_text(first.read_text() + '3}\n{"n": 4}\n')
    second.write_text('{"n": 9}\n')
    got = batches(spark, tmp_path / "in", tmp_path / "c")
    assert [(f, n) for f, _, n in got] == [("s.jsonl", 33), ("s.jsonl", 4), ("t.jsonl", 9)]
    assert got[1][1] > got[0][1] > 2
    assert batches(spark, tmp_path / "in", tmp_path / "c") == []
    second.write_text('{"n": 5}')  # shorter than before and without an end
    assert batches(spark, tmp_path / "in", tmp_path / "c") == []


def test_followed_lines_make_sessions(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/s.jsonl").write_text(json.dumps({"type": "user", "cwd": "/x", "message": {"content": "hi"}}) + "\n")
    seen = []
    live.into(live.followed(spark, str(tmp_path / "in"), "claude"), lambda batch: seen.extend(session_index.session_rows(batch).collect()), str(tmp_path / "c1")).awaitTermination()
    assert [(s.session_id, s.cwd) for s in seen] == [("s", "/x")]


def test_live_daily_counts(spark, tmp_path):
    tokens = (1000, 500, 10000, 200, 0)
    rows = [event(ts="2026-06-01T10:00:00", tokens=tokens, cost=0.5), event(ts="2026-06-01T11:00:00", tokens=tokens, cost=0.25), event(ts="2026-06-02T11:00:00", tool="pi", tokens=tokens, cost=1.0)]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    query = live.live_daily(stream, "UTC").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.date, r.tool): (r.tokens, r.cost_usd, r.messages) for r in spark.table("live").collect()}
    assert got == {("2026-06-01", "claude-code"): (3400, 0.75, 2), ("2026-06-02", "pi"): (1700, 1.0, 1)}
