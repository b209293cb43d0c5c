"""Earlier reports' days, distinct runs by bitmaps, and events without a price as a table, against plain Python."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from loglattice.operators import prior_days, run_bitmaps, usage_cube
from loglattice.plans import cli, report
from loglattice.sources import snapshot

from .test_usage import EVENT, NOW, THREE, event, plain_totals

FACT = "date string, hour int, tool string, provider string, model string, project string, session_id string, tokens long, cost decimal(38,12), messages long"


def read(spark, folder, *documents):
    for i, d in enumerate(documents):
        (folder / f"{i}.json").write_text(json.dumps(d, indent=2))
    return prior_days.read_reports(spark, str(folder))


def built(spark, rows, **more):
    settings = more.pop("settings", report.Settings(tz="UTC"))
    return report.build_report(spark.createDataFrame(rows, EVENT), snapshot.embedded(spark), settings, NOW, **more)


@pytest.fixture(scope="module")
def old(spark):
    return built(spark, THREE)


def test_report_from_its_own_json(spark, tmp_path, old):
    """A report of no events but an earlier report's days has all totals of that one."""
    prior, told = read(spark, tmp_path, old | {"weeklyHighlights": [{"weekEnding": "2026-03-08", "summary": "so far"}, {"weekEnding": "2026-03-01", "summary": ""}, {"weekEnding": "2026-02-22"}]})
    again = built(spark, THREE[:0], prior=prior)
    assert again == old
    assert [tuple(t) for t in told.collect()] == [("2026-03-08", "so far")]


def test_fresh_days_win_and_periods_hold_for_both(spark, tmp_path, old):
    prior, _ = read(spark, tmp_path, old)
    more = [event(ts="2026-03-05T01:00:00", tokens=(1, 2, 3, 4, 0), cost=7.0), event(ts="2026-02-27T01:00:00", session="e", cost=1.0)]
    r = built(spark, more, prior=prior)
    assert [(d["date"], d["costUSD"]) for d in r["daily"]] == [("2026-02-27", 1.0), ("2026-03-03", 1.75), ("2026-03-05", 7.0)]
    assert (r["summary"]["totalTokens"], r["summary"]["totalCostUSD"]) == (plain_totals(more)[0] + plain_totals(THREE[:2])[0], 9.75)
    assert [p["label"] for p in r["byProject"]] == ["app", "lib"] and [w["weekEnding"] for w in r["insights"]["weekly"]] == ["2026-03-01", "2026-03-08"]
    late = built(spark, more, prior=prior, settings=report.Settings(tz="UTC", start="2026-03-01", end="2026-03-04"))
    assert [d["date"] for d in late["daily"]] == ["2026-03-03"]
    with pytest.raises(ValueError, match="split"):
        built(spark, more, prior=prior, settings=report.Settings(tz="UTC", tool="pi"))


def test_dropped_projects_leave_days_but_not_other_breakdowns(spark, tmp_path, old):
    prior, _ = read(spark, tmp_path, old)
    r = built(spark, THREE[:0], prior=prior, settings=report.Settings(tz="UTC", exclude=("lib",)))
    first, second = r["daily"]
    assert (first["tokens"], first["costUSD"], first["sessionCount"], first["messages"]) == (347, 1.25, 1, 2) and sorted(first["byProject"]) == ["app"]
    assert (second["tokens"], second["costUSD"], second["sessionCount"]) == (0, 0.0, 0) and second["byProject"] == {}
    assert r["byTool"] == old["byTool"] and r["summary"]["totalTokens"] == 347


def test_days_of_several_reports_and_days_that_lack_fields(spark, tmp_path):
    a = {"generatedAt": "2026-01-02T00:00:00.000Z", "daily": [{"date": "2026-01-01", "tokens": 1}, {"date": "2026-01-02", "tokens": 2}]}
    b = {"generatedAt": "2026-01-03T00:00:00.000Z", "daily": [{"date": "2026-01-02", "tokens": 5, "byTool": {"pi": {"tokens": 5}}}], "unknown": {"x": [1]}}
    prior, told = read(spark, tmp_path, a, b, {"daily": []}, {})
    got = {d.date: d for d in prior.collect()}
    assert {k: (d.tokens, d.costUSD, d.messages, len(d.hourCounts), d.byProject) for k, d in got.items()} == {"2026-01-01": (1, 0.0, 0, 24, {}), "2026-01-02": (5, 0.0, 0, 24, {})}
    r = built(spark, [], prior=prior)
    assert told.count() == 0 and r["summary"]["activeDays"] == 2 and [(t["id"], t["tokens"], t["costUSD"]) for t in r["byTool"]] == [("pi", 5, 0.0)]


def test_unpriced_events_as_a_table(spark, tmp_path):
    rows = [event(model="mystery"), event(model="mystery"), event(model="odd", tokens=(5, 0, 0, 0, 0)), event(model="mystery", cost=0.0)]
    at = str(tmp_path / "unpriced")
    assert built(spark, rows, unpriced_at=at)["warnings"] == [{"model": "mystery", "events": 2, "tokens": 20300}, {"model": "odd", "events": 1, "tokens": 5}]
    assert sorted(tuple(r) for r in spark.read.parquet(at).collect()) == [("mystery", 10150), ("mystery", 10150), ("odd", 5)]
    none = tmp_path / "none"
    assert built(spark, THREE, unpriced_at=str(none))["warnings"] == [] and not none.exists()


def test_command_line_takes_prior_days_and_pull_requests(spark, tmp_path, monkeypatch, old):
    monkeypatch.setattr(cli, "roots", lambda _=True: {"claude": str(tmp_path / "no logs")})
    (tmp_path / "old.json").write_text(json.dumps(old | {"weeklyHighlights": [{"weekEnding": "2026-03-08", "summary": "told"}]}))
    (tmp_path / "prs.json").write_text(json.dumps({"url": "u", "title": "t", "state": "merged", "created_at": "2026-03-02T00:00:00Z", "merged_at": "2026-03-04T00:00:00Z", "additions": 3, "deletions": 1}) + "\n")
    out = tmp_path / "r.json"
    args = ["--index", str(tmp_path / "i"), "report", "--format", "json", "--out", str(out), "--offline", "--tz", "UTC", "--prior", str(tmp_path / "old.json"), "--pull-requests", str(tmp_path / "prs.json")]
    assert cli.main(args) == 0
    r = json.loads(out.read_text())
    assert r["summary"]["totalTokens"] == plain_totals(THREE)[0] and r["insights"]["weekly"][0]["prsMerged"] == 1
    assert r["weeklyHighlights"][0]["summary"] == "told" and r["weeklyHighlights"][0]["pullRequests"][0]["url"] == "u"


def facts(r, n, first, last):
    day = datetime(2026, 1, 1)
    return [((day + timedelta(days=r.randrange(first, last))).strftime("%Y-%m-%d"), 3, r.choice("ab"), r.choice("pq"), r.choice("mn"), r.choice("xyz"), r.choice([None, *map(str, range(300))]), r.randrange(99), Decimal(1), 1) for _ in range(n)]


def test_runs_by_bitmaps(spark):
    """Two ingests that share days and runs; distinct runs of days, of weeks' tools and of all, against sets."""
    r = random.Random(4)
    old, new = facts(r, 900, 0, 12), facts(r, 900, 9, 20)
    frames = [spark.createDataFrame(rows, FACT) for rows in (old, new)]
    known = run_bitmaps.numbered(frames[0]).cache()
    more = run_bitmaps.numbered(frames[1], known).cache()
    ids = known.unionByName(more)
    numbers = sorted(x.run for x in ids.collect())
    assert numbers == list(range(1, len(numbers) + 1)) and known.count() == max(x.run for x in known.collect())
    assert ids.count() == len({(x[2], x[6]) for x in old + new if x[6] is not None})
    stored = usage_cube.merge_daily(run_bitmaps.day_bitmaps(frames[0], known), run_bitmaps.day_bitmaps(frames[1], ids)).cache()
    days = {x[0] for x in new}
    rows = [x for x in old if x[0] not in days] + new
    for keys in ((), (0,), (2,), (0, 2, 3, 4), (5,)):
        want = defaultdict(lambda: [0, set(), 0])
        for x in rows:
            w = want[tuple(x[k] for k in keys)]
            w[0], w[2] = w[0] + x[7], w[2] + x[9]
            if x[6] is not None:
                w[1].add((x[2], x[6]))
        names = [["date", "hour", "tool", "provider", "model", "project"][k] for k in keys]
        got = {tuple(g[k] for k in names): (g.tokens, g.session_count, g.messages) for g in run_bitmaps.grouped(stored, *names).collect()}
        assert got == {k: (a, len(b), c) for k, (a, b, c) in want.items()}
    both = spark.createDataFrame(rows, FACT)
    order = ["slot", *run_bitmaps.KEYS, *usage_cube.ALL]
    assert sorted(map(repr, run_bitmaps.grouping_sets(stored).select(order).collect())) == sorted(map(repr, usage_cube.grouping_sets(both).select(order).collect()))
    assert run_bitmaps.numbered(both.limit(0)).count() == 0 and run_bitmaps.numbered(both, ids).count() == 0
