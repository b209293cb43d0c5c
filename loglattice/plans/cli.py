"""Command line: ``search``, ``report``, ``context``, ``clear``."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.values import resolve_project
from ..operators import pricing, prior_days, usage_events
from ..sources import logs, price_cache, snapshot
from ..sources.store import Store
from . import api, page, report

#: Where the tools keep their logs, and what overrides that.
ROOTS = {"claude": ("LOGLATTICE_CLAUDE_DIR", "~/.claude/projects"), "codex": ("LOGLATTICE_CODEX_DIR", "~/.codex"), "pi": ("LOGLATTICE_PI_DIR", "~/.pi/agent")}
PERIODS = ("today", "this-week", "this-month", "last-month", "this-year")


def roots(overrides: bool = True) -> dict[str, str]:
    """Reports always read the default places; the index honours the overrides."""
    return {t: os.path.expanduser(os.environ.get(v, d) if overrides else d) for t, (v, d) in ROOTS.items()}


def positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"not a positive number: {text}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loglattice")
    top.add_argument("--index", default=os.path.expanduser("~/.cache/loglattice"), help="folder of the index")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query", nargs="*")
    s.add_argument("--tool", choices=ROOTS)
    s.add_argument("--errored", action="store_true")
    s.add_argument("--here", action="store_true")
    s.add_argument("--limit", type=positive, default=1000)
    s.add_argument("--json", action="store_true")
    r = sub.add_parser("report")
    r.add_argument("--format", choices=("json", "html", "both"), default="html")
    r.add_argument("--out")
    r.add_argument("--from", dest="start")
    r.add_argument("--to", dest="end")
    r.add_argument("--days", type=positive)
    r.add_argument("--tz", default=os.environ.get("TIMEZONE", "America/Chicago"))
    r.add_argument("--stdout", action="store_true")
    r.add_argument("--here", action="store_true")
    r.add_argument("--prices", help="a price list in JSON, in place of the fetched one")
    r.add_argument("--offline", action="store_true", help="fetch no prices")
    r.add_argument("--refresh-pricing", action="store_true", help="fetch prices even if those of today are at hand")
    r.add_argument("--prior", help="an earlier report in JSON, or a folder of such: its days and summaries are kept")
    r.add_argument("--pull-requests", help="pull requests, a JSON object a line: url, title, state, created_at, merged_at, additions, deletions")
    r.add_argument("--unpriced", help="a folder for the table of events without a price, in place of their list in the report")
    r.add_argument("--tool", choices=ROOTS)
    for p in PERIODS:
        r.add_argument(f"--{p}", dest="preset", action="store_const", const=p)
    r.add_argument("--month", dest="preset", metavar="YYYY-MM")
    c = sub.add_parser("context")
    c.add_argument("--limit", type=positive, default=10)
    c.add_argument("--days", type=positive)
    c.add_argument("--tool", choices=ROOTS)
    c.add_argument("--worktree", action="store_true")
    c.add_argument("--full", action="store_true")
    c.add_argument("--json", action="store_true")
    sub.add_parser("clear")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loglattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, now = Store(spark, args.index), datetime.now(timezone.utc)
    if args.command == "clear":
        store.clear()
        return 0
    if args.command == "report":
        return _report(spark, args, now)
    repo = api.resolve_repo(os.getcwd())
    index = store.refresh(roots())
    if args.command == "context":
        if repo is None:
            print("Not in a git repository.")
            return 1
        found = api.get_context_primer(index, repo, now.isoformat(), args.limit, args.days, args.tool, args.worktree)
        print(json.dumps(found, default=str) if args.json else page.primer_markdown(found["repo"], found["recent"], found["headlines"], args.full, args.tool or ""))
        return 0
    found = api.search_results(index, " ".join(args.query), tool=args.tool, errored=args.errored, limit=args.limit, project=repo.container if args.here and repo else None)
    if args.json:
        print(json.dumps(found))
    elif not found:
        print(api.NOTHING)
    width = shutil.get_terminal_size().columns
    for r in [] if args.json else found:
        row = {"display_text": r["displayText"], "cwd": r["cwd"], "tool": r["tool"], "session_id": r["sessionId"], "message_count": r["messageCount"], "errored": r["errored"]}
        print(page.session_line(row, width, os.path.exists(r["cwd"]), r["date"]))
    return 0


def _report(spark: SparkSession, args: argparse.Namespace, now: datetime) -> int:
    if args.prices:
        found, warning = price_cache.load(args.prices, lambda: "", offline=True)
    else:
        found, warning = price_cache.load(os.path.join(args.index, "prices.json"), price_cache.fetched, args.refresh_pricing, args.offline)
    if warning:
        print(warning, file=sys.stderr)
    prices = snapshot.embedded(spark, *([pricing.parse_prices(spark, json.dumps(found))] if found else []))
    chosen = {t: r for t, r in roots(False).items() if args.tool in (None, t)}
    events = usage_events.gather(logs.raw_lines(spark, chosen, recursive=True), tuple(chosen))
    here = None
    if args.here:
        here = spark.createDataFrame([(os.getcwd(),)], "cwd string").select(resolve_project(F.col("cwd")).alias("p")).first().p
    settings = report.Settings(format=args.format, out=args.out, start=args.start, end=args.end, days=args.days, preset=args.preset, tz=args.tz, tool=args.tool, here=here, stdout=args.stdout)
    prior, told = prior_days.read_reports(spark, args.prior) if args.prior else (None, None)
    prs = spark.read.schema(report.PULL_REQUESTS).json(args.pull_requests) if args.pull_requests else None
    built = report.build_report(events, prices, settings, now, prs, told, prior, args.unpriced)
    for path in report.write_report(built, settings):
        print(Path(path).resolve())
    if built["warnings"]:
        print(f"{len({w['model'] for w in built['warnings']})} model(s) without a price", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
