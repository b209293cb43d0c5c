"""Runs, messages and usage events from log files, by examples."""

from __future__ import annotations

import json

import pytest
from loglattice.operators import session_index, usage_events
from loglattice.sources import logs


def write(root, path, lines):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


def said(*blocks, **more):
    return {"type": "assistant", "message": {"role": "assistant", "content": list(blocks)}, **more}


def use(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


CLAUDE = [
    {"type": "system", "cwd": "/x/app", "gitBranch": "old", "timestamp": "2026-06-01T10:00:00Z"},
    "not json",
    user("<system-reminder>hidden\nlines</system-reminder>  <b>Fix</b> the   parser", cwd="/x/other", timestamp="2026-06-01T10:01:00Z"),
    user("skill text", promptSource=None),
    user("Base directory for this skill: /y"),
    said({"type": "text", "text": "Looking"}, {"type": "thinking", "thinking": "hm"}, use("Edit", file_path="/a.py"), use("Write", file_path="/b.py"), use("Edit", file_path="/a.py"), use("NotebookEdit", notebook_path="/n.ipynb")),
    said(use("Read", file_path="/r.py"), use("Grep", pattern="needle", path="/src"), use("Glob", pattern="*.md"), use("Bash", command=" ls -l "), use("Bash", command="ls -l"), gitBranch="main"),
    {"type": "user", "message": {"content": [{"type": "tool_result", "is_error": True, "content": [{"text": "no such"}, {"text": "file"}]}, {"type": "tool_result", "is_error": False, "content": "fine"}]}},
    {"type": "assistant", "isApiErrorMessage": True, "message": {"content": ""}},
    {"type": "custom-title", "customTitle": "First"},
    {"type": "custom-title", "customTitle": "Second"},
    user([{"type": "text", "text": "And the"}, {"type": "input_text", "text": "tests"}], promptSource="typed", timestamp="2026-06-02T09:00:00Z"),
    said({"type": "text", "text": "★ Insight ─────\nDone\n─────────\n\n\n\nmerged /pull/7"}),
]
CODEX = [
    {"type": "session_meta", "timestamp": "2026-06-03T08:00:00Z", "payload": {"id": "c1", "cwd": "/x/app", "git": {"branch": "dev"}}},
    {"type": "turn_context", "payload": {"model": "gpt-5"}},
    {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Begin\n*** Add File: new.py\n+x\n*** Update File: old.py\n"}},
    {"type": "response_item", "payload": {"type": "function_call", "arguments": "ls"}},
    {"type": "event_msg", "payload": {"type": "exec_command_end", "command": ["bash", "-c", "ls"], "exit_code": 2, "stderr": "", "formatted_output": "bad"}},
    {"type": "event_msg", "timestamp": "2026-06-03T08:05:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 1000, "cached_input_tokens": 600, "output_tokens": 100, "reasoning_output_tokens": 30}}}},
    {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
]
PI = [
    {"type": "session", "id": "p1", "cwd": "/x/tool"},
    {"type": "message", "message": {"role": "user", "content": "hello"}},
    {"type": "message", "message": {"role": "bashExecution", "command": "make", "exitCode": 1}},
    {"type": "message", "timestamp": "2026-06-02T09:00:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}], "provider": "openai", "model": "m", "usage": {"input": 2000, "output": 1000, "cost": {"total": 0.12}}}},
    {"type": "message", "timestamp": "2026-06-02T09:10:00Z", "provider": "old", "model": "legacy", "usage": {"input": 5, "output": 6}, "message": {"role": "assistant", "content": "x"}},
]


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    write(top / "claude", "slug/s1.jsonl", CLAUDE)
    write(top / "claude", "slug/s1/subagents/a.jsonl", [user("from the helper"), said({"type": "text", "text": "not this"})])
    write(top / "claude", "slug/tree.jsonl", [user("x", cwd="/x/.claude/worktrees/y")])
    write(top / "claude", "slug/nowhere.jsonl", [user("no folder")])
    write(top / "codex", "2026/06/c1.jsonl", CODEX)
    write(top / "pi", "dir/p1.jsonl", PI)
    return {t: str(top / t) for t in ("claude", "codex", "pi")}


@pytest.fixture(scope="module")
def table(spark, roots):
    lines = logs.raw_lines(spark, roots)
    rows = session_index.session_rows(lines, logs.subagent_lines(spark, roots["claude"])).collect()
    return {r.session_id: r for r in rows}


def test_only_admissible_files(table):
    assert set(table) == {"s1", "c1", "p1"}


def test_claude_session(table):
    r = table["s1"]
    assert (r.cwd, r.branch, r.tool) == ("/x/app", "main", "claude")
    assert r.first_prompt == "Fix the parser"
    assert (r.custom_title, r.created_at, r.date) == ("Second", "2026-06-01", "2026-06-02")
    assert r.message_count == 9
    assert r.files_touched == ["/a.py", "/b.py", "/n.ipynb"]
    assert r.files_read == ["/r.py", "/src", "*.md"]
    assert r.commands == ["ls -l"]
    assert r.errored and r.error_count == 2
    assert r.text.context_text == "no such file\napi error"
    assert r.closing_user == "And the tests"
    assert r.closing_assistant == "Done\n\nmerged /pull/7"
    assert r.text.thinking == "hm"
    assert r.text.user_content.endswith("\nfrom the helper") and "not this" not in r.text.user_content
    assert r.first_hour == "10"


def test_codex_and_pi_files(table):
    c, p = table["c1"], table["p1"]
    assert (c.branch, c.files_touched, c.commands) == ("dev", ["new.py", "old.py"], ["bash -c ls"])
    assert (c.error_count, c.text.context_text, c.message_count) == (1, "bad", 0)
    assert (p.cwd, p.commands, p.error_count, p.text.context_text) == ("/x/tool", ["make"], 1, "exit 1")
    assert (p.message_count, p.first_prompt) == (3, "hello")


def test_messages_are_numbered_without_gaps(spark, roots):
    rows = session_index.messages(logs.raw_lines(spark, {"claude": roots["claude"]})).where("file_path like '%/s1.jsonl'").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert [r.role for r in rows][:3] == ["user", "user", "user"]
    page = session_index.message_page(session_index.messages(logs.raw_lines(spark, {"claude": roots["claude"]})), rows[0].file_path, 1, 2).collect()
    assert [r["index"] for r in page] == [1, 2]


def test_folders_are_pruned_by_their_start(spark, roots):
    found = [logs.raw_lines(spark, {"claude": roots["claude"]}, slugs={"claude": s}).select("file_path").distinct().count() for s in ("sl", "other")]
    assert found == [3, 0]


def test_missing_root_and_empty_session(spark, tmp_path):
    assert logs.raw_lines(spark, {"claude": str(tmp_path / "none")}).count() == 0
    assert session_index.session_rows(logs.raw_lines(spark, {"pi": str(tmp_path / "none")})).count() == 0


def test_usage_of_codex_and_pi(spark, roots):
    rows = usage_events.gather(logs.raw_lines(spark, roots, recursive=True), ("codex", "pi")).orderBy("tool", "line_no").collect()
    c, p, legacy = rows
    assert (c.input, c.output, c.cache_read, c.model, c.session_id, c.project) == (400, 100, 600, "gpt-5", "c1", "app")
    assert (p.input, p.output, p.cost_usd, p.provider) == (2000, 1000, 0.12, "openai")
    assert (legacy.provider, legacy.model, legacy.input, legacy.cost_usd) == ("old", "legacy", 5, None)


def usage(i, request=None, **tokens):
    line = {"type": "assistant", "sessionId": "s", "cwd": "/h/me/Developer/repo/sub", "timestamp": "2026-06-01T14:30:00Z", "message": {"model": "claude-opus-4", "usage": tokens or {"input_tokens": 1}}}
    if i:
        line["message"]["id"] = i
    if request:
        line["requestId"] = request
    return line


def test_usage_dedup(spark, tmp_path):
    write(tmp_path, "a/1.jsonl", [usage("m1", "r1"), usage("m2"), usage(None), usage(None)])
    write(tmp_path, "b/2.jsonl", [usage("m1", "r1"), usage("m1", "r2"), {"type": "assistant", "message": {"usage": {}}}])
    rows = usage_events.claude_events(logs.raw_lines(spark, {"claude": str(tmp_path)}, recursive=True)).collect()
    assert len(rows) == 5  # m1/r1, m1/r2, m2 and the two without an id
    assert {r.project for r in rows} == {"repo"}


def test_usage_cache_split_and_bad_time(spark, tmp_path):
    tokens = {"input_tokens": 3, "cache_creation_input_tokens": 1000, "cache_creation": {"ephemeral_5m_input_tokens": 300, "ephemeral_1h_input_tokens": 700}}
    bad = usage("z") | {"timestamp": "yesterday"}
    write(tmp_path, "a/1.jsonl", [usage("m", **tokens), bad])
    (r,) = usage_events.claude_events(logs.raw_lines(spark, {"claude": str(tmp_path)}, recursive=True)).collect()
    assert (r.cache_write, r.cache_write_1h) == (1000, 700)
