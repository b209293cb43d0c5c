"""The usage report: from logs or usage events to one document, as a dict, JSON or a page.

All aggregation is done by Spark; what reaches the driver has one row for each
day and key at most.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime, timezone
from pathlib import Path
from tempfile import gettempdir
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import allowed, chosen_period
from ..operators import pricing, prior_days, usage_cube
from ..sources import shared
from .page import usage_page

TOOLS = {"claude": "claude-code", "codex": "codex", "pi": "pi"}


@dataclass
class Settings:
    """What a report can be asked for; see ``plans.cli`` for the flags."""

    format: str = "html"
    out: str | None = None
    start: str | None = None
    end: str | None = None
    days: int | None = None
    preset: str | None = None
    tz: str = "America/Chicago"
    tool: str | None = None
    here: str | None = None
    stdout: bool = False
    include: tuple[str, ...] = ()
    include_prefixes: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_prefixes: tuple[str, ...] = ()


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _measures(row: dict, *names: str) -> dict:
    public = {"cost_usd": "costUSD", "session_count": "sessionCount", "prs_merged": "prsMerged"}
    return {public.get(n, n): row[n] for n in names}


#: Columns of pull requests that a report reads.
PULL_REQUESTS = "url string, title string, state string, created_at timestamp, merged_at timestamp, additions long, deletions long"
TOLD = "week_ending string, summary string"


def build_report(
    events: DataFrame, prices: DataFrame, settings: Settings, now: datetime, prs: DataFrame | None = None, told: DataFrame | None = None, prior: DataFrame | None = None, unpriced_at: str | None = None
) -> dict:
    """The report of ``events``; ``now`` is a time in UTC.

    Events outside of the period, of other tools or of projects that aren't
    wanted are left out first. The document is empty but whole without events.
    If ``prs`` (``PULL_REQUESTS``) are given, they are counted in the weeks of
    the report and listed week by week, with the summaries of ``told`` (``TOLD``).

    ``prior`` has days of earlier reports (``prior_days.read_reports``): those
    of the period are added, without projects that aren't wanted; where events
    tell of a day too, they count. A day of a report can't be split by tool or
    folder, so ``prior`` with ``tool`` or ``here`` is a ValueError.

    Events without a price are listed one by one in the document. With
    ``unpriced_at`` they are written there as a table instead, and the document
    has a row a model: its events and tokens.
    """
    if prior is not None and (settings.tool or settings.here):
        raise ValueError("days of earlier reports can't be split by tool or folder")
    today = now.astimezone(ZoneInfo(settings.tz)).date()
    start, end = chosen_period(today, settings.preset, settings.days, settings.start, settings.end)
    if settings.tool:
        events = events.where(F.col("tool") == TOOLS[settings.tool])
    if settings.here:
        events = events.where(F.col("project") == settings.here)

    def kept(project: Column) -> Column:
        return allowed(project, settings.include, settings.include_prefixes, settings.exclude, settings.exclude_prefixes)

    costed = pricing.with_cost(usage_cube.within(events.where(kept(F.col("project"))), settings.tz, start, end), prices)
    # facts count events without a price, so these are looked for again only if there are any
    base = usage_cube.facts(costed, settings.tz, F.count_if(pricing.unpriced()).alias("unpriced")).cache()
    days = prior_days.fresh_days(base)
    if prior is not None:
        days = usage_cube.merge_daily(prior_days.without_projects(_of_period(prior, start, end), kept), days)
    try:
        # written, so that what is made of the days starts from a table and not from the events' plan
        at = shared.folder(events.sparkSession, "days")
        days.write.parquet(at)
        days = events.sparkSession.read.schema(days.schema).parquet(at)
        warned = _unpriced(costed, unpriced_at) if base.agg(F.sum("unpriced")).first()[0] else []
    finally:
        base.unpersist()
    document = _document(days, warned, start, end, today, now)
    return document if prs is None else _with_requests(document, days, prs, told, settings.tz, today)


def _of_period(days: DataFrame, start: str | None, end: str | None) -> DataFrame:
    days = days.where(F.col("date") >= start) if start else days
    return days.where(F.col("date") <= end) if end else days


def _unpriced(costed: DataFrame, at: str | None) -> list[dict]:
    found = pricing.warnings(costed)
    if at is None:
        return _rows(found)
    found.write.mode("overwrite").parquet(at)
    by_model = costed.sparkSession.read.parquet(at).groupBy("model").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens").cast("long").alias("tokens"))
    return _rows(by_model.orderBy(F.desc("tokens"), "model"))


def _document(days: DataFrame, warned: list[dict], start: str | None, end: str | None, today: date, now: datetime) -> dict:
    flat = prior_days.totals(days)
    slots = {s: prior_days.unfolded(days, s) for s in usage_cube.SLOTS}
    totals = {s: usage_cube.breakdown(df, s).orderBy(F.desc("cost_usd"), *usage_cube.SLOTS[s][0]) for s, df in slots.items()}
    daily = [r.asDict(recursive=True) for r in days.orderBy("date").collect()]
    weeks = [{"weekEnding": r["week_ending"]} | _measures(r, *usage_cube.ALL) | {"byTool": {}} for r in _rows(usage_cube.weekly(flat).orderBy("week_ending"))]
    by_week = {w["weekEnding"]: w for w in weeks}
    for r in _rows(usage_cube.weekly_by_tool(slots["tool"]).orderBy("tool")):
        by_week[r["week_ending"]]["byTool"][r["tool"]] = _measures(r, "tokens", "cost_usd")
    hours = prior_days.hours(days)
    s = usage_cube.summary_of(flat, slots["model"], hours, today.isoformat()).first()
    return {
        "generator": "loglattice",
        "version": 1,
        "generatedAt": now.astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        "period": {"from": start or (daily[0]["date"] if daily else today.isoformat()), "to": end or today.isoformat()},
        "summary": {
            "totalCostUSD": s.total_cost_usd,
            "totalTokens": s.total_tokens,
            "sessionCount": s.session_count,
            "messages": s.messages,
            "activeDays": s.active_days,
            "currentStreakDays": s.current_streak,
            "longestStreakDays": s.longest_streak,
            "peakHourLocal": s.peak_hour,
            "favoriteModel": {"tool": s.favourite_tool, "provider": s.favourite_provider, "id": s.favourite_model, "label": s.favourite_model if daily else "Unknown"},
        },
        "byTool": [{"id": r["tool"], "label": r["label"]} | _measures(r, *usage_cube.ALL) for r in _rows(totals["tool"])],
        "byProvider": [{"id": r["provider"], "label": r["label"]} | _measures(r, "tokens", "cost_usd") for r in _rows(totals["provider"])],
        "byModel": [{"tool": r["tool"], "provider": r["provider"], "id": r["model"], "label": r["model"]} | _measures(r, *usage_cube.ALL) for r in _rows(totals["model"])],
        "byProject": [{"label": r["project"]} | _measures(r, "tokens", "cost_usd", "session_count") for r in _rows(totals["project"])],
        "daily": daily,
        "insights": {
            "weekly": weeks,
            "hourCounts": [r["messages"] for r in _rows(usage_cube.hour_histogram(hours).orderBy("hour"))],
            "weekdayCounts": [r["messages"] for r in _rows(usage_cube.weekday_histogram(flat).orderBy("weekday"))],
        },
        "warnings": warned,
    }


def _with_requests(document: dict, days: DataFrame, prs: DataFrame, told: DataFrame | None, tz: str, today: date) -> dict:
    """Adds pull requests: counts to the weeks that are there, and the list of every week from the first active day."""
    told = days.sparkSession.createDataFrame([], TOLD) if told is None else told
    counts = {r["week_ending"]: _measures(r, "prs_merged", "additions", "deletions") for r in _rows(usage_cube.weekly_pull_requests(usage_cube.weekly(prior_days.totals(days)), prs, tz))}
    for week in document["insights"]["weekly"]:
        week |= counts[week["weekEnding"]]
    first = document["daily"][0]["date"] if document["daily"] else today.isoformat()
    names = ("url", "title", "state", "additions", "deletions")
    rows = _rows(usage_cube.weekly_highlights(prs, told, tz, first))
    return document | {"weeklyHighlights": [{"weekEnding": r["week_ending"], "pullRequests": [{n: p[n] for n in names} for p in r["pull_requests"]], "summary": r["summary"]} for r in rows]}


def write_report(report: dict, settings: Settings) -> list[str]:
    """Writes the files that format and ``out`` ask for and returns their paths; with ``stdout`` the JSON is printed instead of written."""
    out, written = settings.out, []
    text = json.dumps(report, indent=2, ensure_ascii=False)
    folder = Path(out) if settings.format == "both" and out else Path(gettempdir())
    if settings.format in ("json", "both"):
        if settings.stdout:
            print(text)
        else:
            path = Path(out) if settings.format == "json" and out else folder / "usage-report.json"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text + "\n")
            written.append(str(path))
    elif settings.stdout:
        print(text)
    if settings.format in ("html", "both"):
        path = Path(out) if settings.format == "html" and out else folder / "report.html"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(usage_page(report))
        written.append(str(path))
    return written
