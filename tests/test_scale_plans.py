"""What keeps the cost of a step in proportion: each line is parsed once, what moves is narrow."""

from __future__ import annotations

import json
from decimal import Decimal

from loglattice.operators import run_bitmaps, usage_events


def lines(spark, tool, *objects):
    rows = [(tool, f"/f{i % 3}", i, json.dumps(o)) for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, "tool string, file_path string, line_no int, line string").selectExpr("tool", "file_path", "line_no", "try_parse_json(line) AS v")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def said(i, **more):
    return {"type": "assistant", "sessionId": "s", "timestamp": "2026-06-01T14:30:00Z", "message": {"model": "m", "usage": {"input_tokens": 1}} | ({"id": i} if i is not None else {})} | more


def test_usage_lines_are_parsed_once(spark):
    found = usage_events.claude_events(lines(spark, "claude", said("a"), said("a"), said("a", requestId="r"), said(None), said(None), said(""), said(7), said("b", timestamp="never"), said("b"), said("c", type="user"), {"type": "assistant"}))
    assert sorted(r.line_no for r in found.collect()) == [0, 2, 3, 4, 5, 6]  # of b the first counts, whose time can't be read
    assert plan(found).count("parseJson") == 1


def test_token_lines_are_parsed_once_a_branch_and_move_once(spark):
    meta, context = {"type": "session_meta", "payload": {"id": "s", "cwd": "/w/p"}}, {"type": "turn_context", "payload": {"model": "g"}}
    count = {"type": "event_msg", "timestamp": "2026-06-01T14:30:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9, "cached_input_tokens": 4, "output_tokens": 2}}}}
    objects = [x for x in (count, meta, context, count, count | {"payload": {"type": "token_count", "info": None}}, {"type": "other"}, count) for _ in range(3)]
    found = usage_events.codex_events(lines(spark, "codex", *objects), block=2)
    assert sorted((r.line_no, r.session_id, r.model, r.project, r.input, r.output, r.cache_read) for r in found.collect()) == [(i, "s", "g", "p", 5, 2, 4) for i in (9, 10, 11, 18, 19, 20)]
    assert plan(found).count("parseJson") == 2 and "Join" not in plan(found)
    pi = [{"type": "session", "id": "s", "cwd": "/w/q"}, {"type": "message", "timestamp": "2026-06-01T14:30:00Z", "message": {"role": "assistant", "provider": "v", "model": "m", "usage": {"input": 3, "cost": {"total": 0.5}}}}, {"type": "message", "message": {"role": "user"}}]
    found = usage_events.pi_events(lines(spark, "pi", *[x for x in pi for _ in range(3)]), block=2)
    assert sorted((r.line_no, r.session_id, r.project, r.input, r.cost_usd) for r in found.collect()) == [(i, "s", "q", 3, 0.5) for i in (3, 4, 5)]
    assert plan(found).count("parseJson") == 2 and "Join" not in plan(found)


def test_bitmaps_are_as_large_as_what_they_hold_and_add_up_without_a_sort(spark):
    """Keys of one run each, as many neighbours of one key, and facts without a run."""
    rows = [("2026-01-01", 1, "a", "p", "m", f"x{i}", f"s{i}", 1, Decimal(1), 1) for i in range(300)]
    rows += [(day, 1, "b", "p", "m", "y", f"s{i}", 1, Decimal(1), 1) for i in range(640) for day in ("2026-01-01", "2026-01-02")] + [("2026-01-02", 1, "b", "p", "m", "z", None, 1, Decimal(1), 1)]
    base = spark.createDataFrame(rows, "date string, hour int, tool string, provider string, model string, project string, session_id string, tokens long, cost decimal(38,12), messages long")
    stored = run_bitmaps.day_bitmaps(base, run_bitmaps.numbered(base))
    kept = stored.collect()
    assert dict(stored.dtypes)["runs"] == "bigint" and len([r for r in kept if r.tool == "a"]) == 300
    assert len([r for r in kept if r.project == "y"]) <= 2 * (640 // 64 + 2 * run_bitmaps.RUN_PARTS) and [r.runs for r in kept if r.project == "z"] == [None]
    for found in (run_bitmaps.grouped(stored, "date", "tool"), run_bitmaps.grouping_sets(stored)):
        assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
    assert sorted((r.date, r.tool, r.session_count, r.tokens) for r in run_bitmaps.grouped(stored, "date", "tool").collect()) == [("2026-01-01", "a", 300, 300), ("2026-01-01", "b", 640, 640), ("2026-01-02", "b", 640, 641)]
    assert [(r.project, r.session_count) for r in run_bitmaps.grouped(stored, "project").where("project = 'z'").collect()] == [("z", 0)]
