"""Search against SQLite's own full-text index, and the store that it runs on."""

from __future__ import annotations

import json
import os
import random
import sqlite3
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from loglattice.operators import search
from loglattice.plans import api, page
from loglattice.sources.store import Store

COLUMNS = list(search.WEIGHTS)
WORDS = "refactor refactoring parser cache.ts don't CAFÉ naïve running runs tests failing v1.2 naming 3.14 index indices errors error path/to/file snake_case the a of GOOD goods studies study".split()  # noqa: SIM905


def sqlite_scores(rows, query):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(file_path unindexed, {', '.join(COLUMNS)}, tokenize='porter unicode61')")
    con.executemany(f"insert into t values ({', '.join('?' * (len(COLUMNS) + 1))})", rows)
    words = [w for w in query.replace('"', "").replace("'", "").split()]
    weights = ", ".join(map(str, [0, *search.WEIGHTS.values()]))
    return dict(con.execute(f"select file_path, bm25(t, {weights}) from t where t match ?", (" OR ".join(f'"{w}"' for w in words),)).fetchall())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    return [(f"d{i}", *(" ".join(r.choice(WORDS) for _ in range(r.choice([0, 3, 8, 20]))) for _ in COLUMNS)) for i in range(60)]


@pytest.mark.parametrize("query", ["refactor", "cache.ts naïve", "running tests 3.14", "snake_case don't", "the", "studies index.error", "nowhere", "!!! good"])
def test_scores_match_sqlite(spark, rows, query):
    docs = spark.createDataFrame(rows, "file_path string, " + ", ".join(f"{c} string" for c in COLUMNS))
    phrases = search.query_phrases(query)
    index = search.postings(docs, "file_path")
    got = {r.key: r.score for r in search.bm25(index, phrases, documents=docs.select("file_path")).collect()}
    want = sqlite_scores(rows, query)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_snippet():
    words = [f"w{i}" for i in range(100)]
    words[50] = "needles"
    found = search.snippet({"a": "nothing", "b": " ".join(words)}, [["needl"]])
    assert found.startswith("…w3") and found.endswith("…") and "needles" in found and len(found.split()) == 32
    assert search.snippet({"a": "x"}, [["y"]]) is None


@pytest.mark.parametrize("seed", range(4))
def test_snippets_match_sqlite(spark, seed):
    """Sentences, several columns, phrases of several words, ties."""
    r = random.Random(seed)

    def text():
        return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ". ", ": ", ".\n", ".", ", ", "  "]) for _ in range(r.choice([0, 5, 40, 120])))

    docs = [(f"d{i}", *(text() for _ in COLUMNS)) for i in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(file_path unindexed, {', '.join(COLUMNS)}, tokenize='porter unicode61')")
    con.executemany(f"insert into t values ({', '.join('?' * (len(COLUMNS) + 1))})", docs)
    frame = spark.createDataFrame(docs, "file_path string, " + ", ".join(f"{c} string" for c in COLUMNS))
    for query in ("refactor", "running cache.ts", "errors tests", "path/to/file café the"):
        match = " OR ".join(f'"{w}"' for w in query.split())
        want = dict(con.execute("select file_path, snippet(t, -1, '', '', '…', 32) from t where t match ?", (match,)).fetchall())
        got = {x.file_path: x.s for x in frame.select("file_path", search.snippets(COLUMNS, search.query_phrases(query)).alias("s")).where("s is not null").collect()}
        assert got == want


def test_postings_hold_lists_of_places(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a a", None), (2, "", "b"), (3, None, None), (None, "a", "A b")], "id long, x string, y string")
    index = search.postings(docs, "id", ["x", "y"], stem=False)
    assert sorted((r.key or 0, r.term, r.col, r.n, r.gaps, r.length) for r in index.collect()) == [(0, "a", "x", 1, [0], 3), (0, "a", "y", 1, [0], 3), (0, "b", "y", 1, [1], 3), (1, "a", "x", 3, [0, 2, 1], 4), (1, "b", "x", 1, [1], 4), (2, "b", "y", 1, [0], 1)]
    assert search.postings(docs.limit(0), "id", ["x"]).count() == 0
    many = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 900}" for j in range(300))) for i in range(300)], "id long, x string")
    search.postings(many.coalesce(1), "id", ["x"], stem=False).write.option("parquet.page.row.count.limit", 200).parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    hits = search.phrase_hits(stored, [["t7"], ["t7", "t14"]])
    assert "[In(term, [t14,t7])]" in hits._jdf.queryExecution().toString()
    assert {(r.key, r.phrase, r.n) for r in hits.collect()} == {(i, k, n) for i in range(300) for k in (0, 1) if (n := sum((i * j) % 900 == 7 and (k == 0 or j < 299 and (i * j + i) % 900 == 14) for j in range(300)))}


def worker(spark, monkeypatch, columns, stem):
    """What a Python worker runs to make postings, called here."""
    docs, got = spark.createDataFrame([], "id long, " + ", ".join(f"{c} string" for c in columns)), []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, f, schema: got.append(f) or self)
        search.postings(docs, "id", columns, stem)
    return got[0]


def test_a_worker_holds_one_step_of_texts_and_the_tokens_that_repeat(spark, monkeypatch):
    """A batch of long wide texts, and as many batches of new tokens as would fill any table of them."""
    text = "\U0001f600 " + " ".join(f"é{i:05}{'x' * 34}" for i in range(2500))
    wide = [pa.RecordBatch.from_pydict({"id": list(range(100)), "x": [text] * 100})]
    new = (pa.RecordBatch.from_pydict({"id": [k], "x": [" ".join(f"t{k}n{i:06}" for i in range(40000)) + " the the"]}) for k in range(8))
    for batches, rows, words, most in ((wide, 250000, 250000, 25), (new, 8 * 40001, 8 * 40002, 64)):
        run = worker(spark, monkeypatch, ["x"], False)
        tracemalloc.start()
        try:
            found = [(b.num_rows, sum(b.column("n").to_pylist())) for b in run(iter(batches))]
            peak = tracemalloc.get_traced_memory()[1] / (1 << 20)
        finally:
            tracemalloc.stop()
        assert (sum(n for n, _ in found), sum(n for _, n in found)) == (rows, words)
        assert peak < most


def test_postings_are_whole_when_tokens_are_forgotten(spark, monkeypatch):
    """Steps of a few words and a table of three tokens, with stems in two columns."""
    for name, value in (("STEP_BYTES", 40), ("REMEMBERED", 3), ("BATCH_ROWS", 2)):
        monkeypatch.setattr(search, name, value)
    r = random.Random(4)
    x, y = ([" ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 9]))) for _ in range(60)] for _ in "xy")
    run = worker(spark, monkeypatch, ["x", "y"], True)
    rows = [q for b in run(iter([pa.RecordBatch.from_pydict({"id": list(range(60)), "x": x, "y": y})])) for q in b.to_pylist()]
    found = {(q["key"], q["col"], place): q["term"] for q in rows for place in (sum(q["gaps"][: i + 1]) for i in range(q["n"]))}
    assert found == {(i, c, k): search.term_of(t, True) for c, texts in (("x", x), ("y", y)) for i, text in enumerate(texts) for k, t in enumerate(search.tokens_of(text))}


def test_a_worker_keeps_nothing_between_batches_and_few_tokens_within(spark, monkeypatch):
    """Documents of new tokens only: what a worker holds follows neither the batches it has seen nor all tokens of 4 MB of text."""
    held = []

    def batches():
        for k in range(3):
            held.append(tracemalloc.get_traced_memory()[0] / (1 << 20))
            yield pa.RecordBatch.from_pydict({"id": list(range(10)), "x": [" ".join(f"{k}{d}n{i}s" for i in range(40000)) for d in range(10)]})
        held.append(tracemalloc.get_traced_memory()[0] / (1 << 20))

    run = worker(spark, monkeypatch, ["x"], True)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(batches())) == 3 * 10 * 40000
        peak = tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()
    assert max(held) < 4 and peak < 80


def test_terms_of_many_tokens_are_those_of_each():
    """Final sigma, marks alone and upper case whose lower case has a mark, beside one another."""
    tokens = ["ΟΔΟΣ", "Σ", "ΣΑΣ", "\u0301", "\u0307\u0301", "İ", "CAFÉ", "naïve", "running", "SYZYGIES", "yyed", "가각", "x", "ﬁ", "1990s", "Å", "\ue000"]
    for some in (tokens, tokens[::-1], tokens[3:4], tokens[8:10]):
        for stem in (True, False):
            assert search.terms_of(some, stem).to_pylist() == [search.term_of(t, stem) for t in some]


def session(name, text, cwd="/x/app", day="2026-06-01", extra=()):
    lines = [{"type": "user", "cwd": cwd, "timestamp": f"{day}T10:00:00Z", "message": {"content": text}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "ok"}]}}, *extra]
    return name, "\n".join(map(json.dumps, lines))


def put(root, items):
    (root / "slug").mkdir(parents=True, exist_ok=True)
    for name, body in items:
        (root / "slug" / f"{name}.jsonl").write_text(body)


def written(store):
    """bucket -> names of its files, of all tables."""
    return {str(d.relative_to(store.folder)): sorted(f.name for f in d.glob("*.parquet")) for d in Path(store.folder).glob("*/bucket=*")}


def test_a_refresh_writes_only_the_buckets_of_changed_files(spark, tmp_path):
    put(tmp_path / "logs", [session(f"s{i:02}", f"topic{i} parser") for i in range(30)])
    store, roots = Store(spark, str(tmp_path / "index"), buckets=16), {"claude": str(tmp_path / "logs")}
    assert store.refresh(roots).runs.count() == 30
    before = written(store)
    assert len(before) == 3 * 16
    put(tmp_path / "logs", [session("s07", "topic7 lexer and more"), session("s30", "topic30 parser")])
    os.remove(tmp_path / "logs/slug/s11.jsonl")
    index, after = store.refresh(roots), written(store)
    changed = {k.split("=")[1] for k in before if after[k] != before[k]}
    assert before.keys() == after.keys() and 1 <= len(changed) <= 3
    assert all((after[k] != before[k]) == (k.split("=")[1] in changed) for k in before)
    assert {r.session_id for r in index.runs.collect()} == {f"s{i:02}" for i in range(31)} - {"s11"}
    assert [r["sessionId"] for r in api.search_results(index, "lexer")] == ["s07"]
    assert api.search_results(index, "topic11") == [] and len(api.search_results(index, "parser", limit=99)) == 29
    for i in range(31):
        (tmp_path / f"logs/slug/s{i:02}.jsonl").unlink(missing_ok=True)
    assert store.refresh(roots).runs.count() == 0 and store.current().postings.count() == 0


def test_store_follows_files(spark, tmp_path):
    logs = tmp_path / "logs"
    thinking = {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "migrate the schema"}]}}
    command = {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "migrate --all"}}]}}
    put(logs, [session("one", "Refactoring the parser"), session("two", "hello", extra=[thinking]), session("three", "hello", cwd="/x/app-v2/a", day="2026-06-03", extra=[command])])
    store, roots = Store(spark, str(tmp_path / "index")), {"claude": str(logs)}
    index = store.refresh(roots)
    assert index.runs.count() == 3
    assert [r["sessionId"] for r in api.search_results(index, "refactor")] == ["one"]
    assert [r["sessionId"] for r in api.search_results(index, "migrate")] == ["three", "two"]  # commands weigh more than thoughts
    assert [r["sessionId"] for r in api.search_results(index, project="/x/app")] == ["one", "two"]
    assert api.search_results(index, "zebra") == [] and api.search_results(index, "!!!") == []
    assert api.search_results(index, limit=1)[0]["sessionId"] == "three"
    assert api.get_activity_digest(index, "2020-01-01", "2020-02-01") == api.NONE_IN_RANGE
    d = api.get_activity_digest(index, "2026-06-01", "2026-06-30", detail="full")
    assert d["sessionCount"] == 3 and [x["date"] for x in d["days"]] == ["2026-06-01", "2026-06-03"]
    assert d["days"][0]["projects"][0]["topics"] == ["Refactoring the parser", "hello"]
    m = api.get_session_metrics(index, "2026-06-01", "2026-06-30")
    assert m["sessionCount"] == 3 and m["activeHours"] == {"10": 3}
    one = next(r["filePath"] for r in api.search_results(index) if r["sessionId"] == "one")
    assert api.get_session_messages(index, one, 1, 5)["messages"] == [{"index": 1, "role": "assistant", "text": "ok"}]
    p = api.get_context_primer(index, api.Repo("/x/app", branches={"/x/app": "main"}), "2026-06-04T00:00:00", limit=1)
    assert len(p["recent"]) == 1 and len(p["headlines"]) == 1 and p["recent"][0]["branch"] == "main"
    assert "## Earlier" in page.primer_markdown(p["repo"], p["recent"], p["headlines"])

    put(logs, [session("one", "Now about zebras", extra=[command]), ("two", '{"type":"user","message":{"content":"no folder any more"}}'), session("four", "new")])
    os.remove(logs / "slug/three.jsonl")
    index = store.refresh(roots)
    assert {r.session_id for r in index.runs.collect()} == {"one", "two", "four"}
    assert [r["sessionId"] for r in api.search_results(index, "zebra")] == ["one"]
    before = written(store)
    assert store.refresh(roots).runs.count() == 3 and written(store) == before  # nothing changed

    for f in (tmp_path / "index").rglob("*.parquet"):
        f.write_bytes(b"damaged")
    assert store.refresh(roots).runs.count() == 2  # built again; the file without a folder is no session
    store.clear()
    assert store.current() is None


def test_trivial_ones_only_without_others(spark, tmp_path):
    put(tmp_path / "logs", [session(f"s{i:02}", "hi", day=f"2026-06-{i + 1:02}") for i in range(12)])
    index = Store(spark, str(tmp_path / "index")).refresh({"claude": str(tmp_path / "logs")})
    p = api.get_context_primer(index, api.Repo("/x/app"), "2026-06-20T00:00:00")
    assert len(p["recent"]) == 10 and [h["session_id"] for h in p["headlines"]] == ["s01", "s00"]
