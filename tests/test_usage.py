"""Values, prices and the usage cube, by examples and against plain Python."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from loglattice.functions import text, values
from loglattice.operators import pricing, usage_cube
from loglattice.plans import page, report
from loglattice.sources import price_cache, snapshot
from pyspark.sql import functions as F

EVENT = "tool string, provider string, model string, ts timestamp, session_id string, project string, input long, output long, cache_read long, cache_write long, cache_write_1h long, cost_usd double"


def event(tool="claude-code", model="claude-opus-4-5", ts="2026-03-01T08:15:00", session="s1", project="app", tokens=(700, 300, 9000, 150, 0), cost=None, provider="anthropic"):
    return (tool, provider, model, datetime.fromisoformat(ts) if ts else None, session, project, *tokens, cost)


THREE = [
    event(session="run-a", ts="2026-03-03T22:10:00", tokens=(300, 40, 0, 7, 0), cost=1.25),
    event(session="run-b", ts="2026-03-03T22:50:00", model="claude-sonnet-4-5", tokens=(50, 5, 600, 0, 0), cost=0.5, project="lib"),
    event("codex", "gpt-5", "2026-03-05T07:00:00", "run-c", project="lib", tokens=(80, 9, 0, 0, 0), cost=2.0, provider="openai"),
]
NOW = datetime(2026, 3, 6, 12, tzinfo=timezone.utc)


def built(spark, rows, **settings):
    return report.build_report(spark.createDataFrame(rows, EVENT), snapshot.embedded(spark), report.Settings(tz="UTC", **settings), NOW)


def plain_totals(rows, keep=lambda r: True):
    """Tokens (cache reads don't count), cost, and distinct runs of rows, in plain Python."""
    rows = [r for r in rows if keep(r)]
    return sum(r[6] + r[7] + r[9] for r in rows), round(sum(r[11] for r in rows), 2), len({(r[0], r[4]) for r in rows})


def test_report_totals(spark):
    r = built(spark, THREE)
    s = r["summary"]
    assert (s["totalTokens"], s["totalCostUSD"], s["sessionCount"]) == plain_totals(THREE)
    assert (s["messages"], s["activeDays"], s["longestStreakDays"], s["currentStreakDays"], s["peakHourLocal"]) == (3, 2, 1, 0, 22)
    assert [d["date"] for d in r["daily"]] == ["2026-03-03", "2026-03-05"]
    assert r["daily"][0]["hourCounts"][22] == 2 and len(r["insights"]["hourCounts"]) == 24
    for tool in r["byTool"]:
        assert (tool["tokens"], tool["costUSD"], tool["sessionCount"]) == plain_totals(THREE, lambda x, tool=tool: x[0] == tool["id"])
    assert [t["id"] for t in r["byTool"]] == ["codex", "claude-code"]
    assert r["period"] == {"from": "2026-03-03", "to": "2026-03-06"}
    assert "weeklyHighlights" not in json.dumps(r)
    html = page.usage_page(r)
    assert html.startswith("<!doctype html>") and "http" not in html


def test_report_without_events_and_filters(spark):
    empty = built(spark, THREE, start="2025-01-01", end="2025-01-31")
    assert empty["summary"]["totalTokens"] == 0 and empty["daily"] == [] and empty["summary"]["favoriteModel"]["label"] == "Unknown"
    for here in ("app", "lib", None):
        assert built(spark, THREE, here=here)["summary"]["totalTokens"] == plain_totals(THREE, lambda r, here=here: here in (None, r[5]))[0]


def test_events_without_time_are_left_out(spark):
    assert built(spark, [event(), event(ts=None)])["summary"]["messages"] == 1


def test_warnings_are_per_event(spark):
    r = built(spark, [event(model="mystery"), event(model="mystery"), event(model="mystery", tokens=(0, 0, 0, 0, 0)), event(model="mystery", cost=0.0)])
    assert r["warnings"] == [{"model": "mystery", "tokens": 10150}] * 2


def test_report_files(spark, tmp_path, capsys):
    r = built(spark, THREE)
    both = report.write_report(r, report.Settings(format="both", out=str(tmp_path / "d")))
    assert [p.rsplit("/", 1)[1] for p in both] == ["usage-report.json", "report.html"]
    assert json.loads((tmp_path / "d/usage-report.json").read_text())["version"] == 1
    report.write_report(r, report.Settings(format="json", stdout=True))
    assert json.loads(capsys.readouterr().out)["generator"] == "loglattice"


@pytest.mark.parametrize(
    ("model", "keys", "found"),
    [
        ("claude-opus-4-5", ["claude-opus-4", "claude-opus-4-5"], "claude-opus-4-5"),
        ("claude-opus-4-8", ["claude-opus-4"], None),
        ("claude-opus-4-20251101", ["claude-opus-4"], "claude-opus-4"),
        ("claude-opus-4-20251101x", ["claude-opus-4"], None),
        ("anthropic/claude-sonnet-4.5", ["claude-sonnet-4-5"], "claude-sonnet-4-5"),
        ("sonnet", ["claude-sonnet-x", "my-sonnet-x"], "claude-sonnet-x"),
        ("GPT-5", ["gpt-5"], "gpt-5"),
        ("gpt-5x", ["gpt-5"], None),
    ],
)
def test_model_names(model, keys, found):
    assert pricing.best_key(model, keys) == found


def test_cost_vector_and_tiers(spark):
    rate = 1e-6
    prices = spark.createDataFrame([("a", 5 * rate, 25 * rate, 6.25 * rate, 0.5 * rate, None, None, None, None), ("t", rate, rate, None, None, 2 * rate, None, None, None)], pricing.SCHEMA)
    rows = [event(model="a", tokens=(1000, 2000, 4000, 800, 0)), event(model="t", tokens=(200_000, 0, 0, 0, 0)), event(model="t", tokens=(201_000, 0, 0, 0, 0)), event(model="t", tokens=(0, 0, 100, 1000, 700)), event(model="none", tokens=(5, 0, 0, 0, 0))]
    got = [r.cost_usd for r in pricing.with_cost(spark.createDataFrame(rows, EVENT).coalesce(1), prices).collect()]
    want = [1000 * 5e-6 + 2000 * 25e-6 + 4000 * 0.5e-6 + 800 * 6.25e-6, 0.2, 0.202, (100 * 0.1 + 300 * 1.25 + 700 * 2) * rate, 0.0]
    assert sorted(got) == pytest.approx(sorted(want))


def test_price_list(spark):
    entries = {"a": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "litellm_provider": "openai"}, "no output": {"input_cost_per_token": 1e-6}, "text": {"input_cost_per_token": "x", "output_cost_per_token": 1}, "spec": 3}
    assert [r.key for r in pricing.parse_prices(spark, json.dumps(entries)).collect()] == ["a"]
    assert pricing.parse_prices(spark, json.dumps(entries), ("anthropic",)).count() == 0
    assert pricing.parse_prices(spark, "not json").count() == 0
    base = snapshot.embedded(spark)
    top = pricing.layered(base, base.where("key = 'gpt-5'").withColumn("input_rate", F.lit(9.0)))
    assert {r.key: r.input_rate for r in top.collect()}["gpt-5"] == 9.0 and top.count() == base.count()


def test_price_cache(tmp_path):
    file, good = tmp_path / "prices.json", json.dumps({"m": {"input_cost_per_token": 1, "output_cost_per_token": 2}})
    calls = []

    def fetch(text=good):
        calls.append(1)
        if text is None:
            raise OSError("no network")
        return text

    assert price_cache.load(str(file), lambda: fetch(None)) == (None, None)
    assert price_cache.load(str(file), fetch)[0].keys() == {"m"} and file.exists()
    before = len(calls)
    assert price_cache.load(str(file), fetch)[0].keys() == {"m"} and len(calls) == before
    late = file.stat().st_mtime + price_cache.TTL + 1
    stale, warning = price_cache.load(str(file), lambda: fetch(None), now=late)
    assert stale.keys() == {"m"} and "no network" in warning
    assert price_cache.load(str(file), lambda: fetch("[]"), force=True)[1]
    file.write_text("broken")
    assert price_cache.load(str(file), fetch)[0].keys() == {"m"}


def test_periods():
    day = date(2026, 1, 15)
    assert values.period("last-month", day) == ("2025-12-01", "2025-12-31")
    assert values.period("this-week", day) == ("2026-01-12", "2026-01-15")
    assert values.period("2024-02", day) == ("2024-02-01", "2024-02-29")
    for bad in ("2024-13", "24-01", "soon", "2024-1"):
        with pytest.raises(ValueError):
            values.period(bad, day)
    assert values.chosen_period(day, None, 7, "a", "b") == ("2026-01-09", "2026-01-15")


def test_round2_and_weeks_against_python(spark):
    r = random.Random(5)
    rows = [(r.choice([r.uniform(-5, 5), r.randrange(1000) / 1000, 1.005]), (date(2024, 1, 1) + timedelta(days=r.randrange(2000))).isoformat()) for _ in range(500)]
    import math

    got = spark.createDataFrame(rows, "x double, d string").select("x", "d", values.round2(F.col("x")).alias("r"), values.week_ending(F.col("d")).alias("w")).collect()
    for g in got:
        d = date.fromisoformat(g.d)
        assert g.r == math.floor(g.x * 100 + 0.5) / 100
        assert g.w == d + timedelta(days=(6 - d.weekday()) % 7)


def test_streaks_against_python(spark):
    r = random.Random(6)
    for _ in range(4):
        days = sorted(r.sample(range(60), r.randrange(0, 40)))
        dates = [date(2026, 1, 1) + timedelta(days=d) for d in days]
        today = date(2026, 1, 1) + timedelta(days=r.randrange(60))
        longest = run = 0
        for i, d in enumerate(dates):
            run = run + 1 if i and dates[i - 1] == d - timedelta(days=1) else 1
            longest = max(longest, run)
        current, d = 0, today
        while d in dates:
            current, d = current + 1, d - timedelta(days=1)
        got = usage_cube.streaks(spark.createDataFrame([(d.isoformat(),) for d in dates], "date string"), today.isoformat()).first()
        assert (got.current_streak, got.longest_streak) == (current, longest)


def test_pull_requests_and_highlights(spark):
    prs = spark.createDataFrame([("u1", "a", "merged", 5, 1, datetime(2026, 6, 1), datetime(2026, 6, 2)), ("u2", "b", "open", 50, 1, datetime(2026, 6, 3), None), ("u3", "c", "merged", 7, 2, datetime(2026, 6, 4), datetime(2026, 6, 20))], "url string, title string, state string, additions int, deletions int, created_at timestamp, merged_at timestamp")
    weeks = spark.createDataFrame([("2026-06-07", 1), ("2026-06-14", 0)], "week_ending string, tokens long")
    got = {r.week_ending: (r.prs_merged, r.additions) for r in usage_cube.weekly_pull_requests(weeks, prs, "UTC").collect()}
    assert got == {"2026-06-07": (1, 5), "2026-06-14": (0, 0)}
    prior = spark.createDataFrame([("2026-06-07", "kept")], "week_ending string, summary string")
    high = usage_cube.weekly_highlights(prs, prior, "UTC", "2026-06-01").collect()
    assert [(h.week_ending, h.summary, [p.url for p in h.pull_requests]) for h in high] == [("2026-06-21", None, ["u3"]), ("2026-06-07", "kept", ["u2", "u1"])]


def test_report_with_pull_requests(spark):
    day = datetime.fromisoformat
    rows = [
        ("a", "small", "merged", day("2026-03-01T09:00:00"), day("2026-03-04T09:00:00"), 5, 1),
        ("b", "large", "merged", day("2026-03-04T09:00:00"), day("2026-03-05T09:00:00"), 50, 10),
        ("c", "open", "open", day("2026-03-05T09:00:00"), None, 7, 7),
        ("d", "early", "merged", day("2026-01-01T09:00:00"), day("2026-01-02T09:00:00"), 1, 1),
    ]
    events, prices, settings = spark.createDataFrame(THREE, EVENT), snapshot.embedded(spark), report.Settings(tz="UTC")
    prs = spark.createDataFrame(rows, report.PULL_REQUESTS)
    r = report.build_report(events, prices, settings, NOW, prs, spark.createDataFrame([("2026-03-08", "a good week")], report.TOLD))
    (week,) = r["insights"]["weekly"]
    (high,) = r["weeklyHighlights"]
    assert (week["prsMerged"], week["additions"], week["deletions"]) == (2, 55, 11)
    assert high["weekEnding"] == week["weekEnding"] == "2026-03-08" and high["summary"] == "a good week"
    assert [p["url"] for p in high["pullRequests"]] == ["b", "c", "a"]
    none = report.build_report(events.limit(0), prices, settings, NOW, prs.limit(0))
    assert none["weeklyHighlights"] == [] and none["insights"]["weekly"] == []


def test_text_helpers(spark):
    df = spark.createDataFrame([("a" * 50 + "\nNeedle here" + "b" * 90, "/h/me/Developer/repo/x"), ("none", ""), (None, "/a/b/")], "t string, p string")
    got = df.select(text.match_context(F.col("t"), "needle").alias("c"), values.resolve_project(F.col("p")).alias("p")).collect()
    assert got[0].c.startswith("…a") and "Needle here" in got[0].c and got[0].c.endswith("b…") and "\n" not in got[0].c
    assert [g.p for g in got] == ["repo", "unknown", "b"] and got[1].c is None and got[2].c is None
    assert page.tokens(1_500_000) == "1.5M" and page.tokens(2_000_000_000) == "2.00B" and page.hour_label(0) == "12 AM"


def test_price_layers(spark):
    listed = spark.createDataFrame([("gpt-5", 9.0, 9.0, *(None,) * 6), ("gpt-5.5", 9.0, 9.0, *(None,) * 6), ("new-model", 1.0, 2.0, *(None,) * 6)], pricing.SCHEMA)
    got = {r.key: r.input_rate for r in snapshot.embedded(spark, listed).collect()}
    assert (got["gpt-5"], got["gpt-5.5"], got["new-model"], got["o3"]) == (9.0, 5e-6, 1.0, 2e-6)
    r = built(spark, [event(model="claude-opus-4-8")])
    assert r["warnings"] == [] and r["summary"]["totalCostUSD"] > 0


def test_models_are_resolved_as_by_trying_every_name(spark):
    """Names of awkward pieces, in both directions, against a loop over all names."""
    r = random.Random(12)
    bits = ["gpt", "GPT", "5", "4.1", "mini", "-", "-", ".", "@", "/", "openai", "x", "20240101", "2024", "é", "İ", "K", "--", " "]
    names = sorted({"".join(r.choice(bits) for _ in range(r.randrange(1, 7))) for _ in range(500)})
    models, keys = names[::2] + [None, ""], names[1::2] + names[:40]
    got = {x.model: x.key for x in pricing.resolve_models(spark.createDataFrame([(m,) for m in models], "model string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    every = {k: pricing.normalized(k) for k in keys}
    assert got == {m: pricing.best_key(m, every) if m else None for m in models}
    assert sum(k is not None for k in got.values()) > 100


def test_a_long_price_list_is_not_tried_name_by_name(spark):
    keys = spark.range(60_000).selectExpr("concat('vendor', id % 50, '/model-', id, '-v', id % 7) AS key")
    models = spark.range(200_000).selectExpr("CASE WHEN id % 3 = 0 THEN concat('eu.vendor', id % 50, '/model-', id, '-v', id % 7, '-20240101') ELSE concat('other-', id) END AS model")
    found = pricing.resolve_models(models, keys).where("key is not null")
    assert found.count() == 20_000 and found.where("model <> concat('eu.', key, '-20240101')").count() == 0
