"""Reports as a self-contained page, primers as Markdown, runs as lines. Pure functions on the driver over few rows."""

from __future__ import annotations

from datetime import date
from html import escape

TOP_MODELS, TOP_PROJECTS, SHOWN_FILES = 6, 8, 5
STYLE = "body{font:15px system-ui;margin:2rem auto;max-width:60rem;color:#222}h2{margin-top:2rem}td,th{padding:.2rem .8rem;text-align:right}td:first-child,th:first-child{text-align:left}.cards{display:flex;flex-wrap:wrap;gap:1rem}.card{background:#f3f3f6;border-radius:.5rem;padding:.7rem 1rem}.card b{display:block;font-size:1.3rem}.warn{background:#fff3d6;padding:.6rem 1rem}rect{fill:#5566cc}text{font-size:10px;fill:#555}"


def usd(x: float) -> str:
    return f"${x:,.2f}"


def whole(n: int) -> str:
    return f"{n:,}"


def tokens(n: int) -> str:
    for size, unit, digits in ((1_000_000_000, "B", 2), (1_000_000, "M", 1), (1_000, "K", 1)):
        if n >= size:
            return f"{n / size:.{digits}f}{unit}"
    return str(n)


def hour_label(hour: int) -> str:
    return f"{hour % 12 or 12} {'AM' if hour < 12 else 'PM'}"


def day_label(day: str) -> str:
    d = date.fromisoformat(day)
    return f"{d:%b} {d.day}, {d.year}"


def period_label(start: str, end: str) -> str:
    return day_label(start) if start == end else f"{day_label(start)} – {day_label(end)}"


def bars(values: list[float], labels: list[str], height: int = 90, width: int = 720) -> str:
    """A bar chart as SVG; bars share the width, the highest takes the height."""
    if not values:
        return ""
    top, step = max(*values, 1e-9, 0), width / len(values)
    parts = []
    for i, (v, label) in enumerate(zip(values, labels, strict=True)):
        h = height * v / top
        parts.append(f'<rect x="{i * step:.1f}" y="{height - h:.1f}" width="{max(1, step - 2):.1f}" height="{h:.1f}"><title>{escape(label)}: {v:g}</title></rect>')
        if len(values) <= 31:
            parts.append(f'<text x="{i * step:.1f}" y="{height + 12}">{escape(label)}</text>')
    return f'<svg viewBox="0 0 {width} {height + 16}" width="100%">{"".join(parts)}</svg>'


def rows(items: list[dict], columns: list[tuple[str, str]], names: list[str]) -> str:
    head = "<tr><th></th>" + "".join(f"<th>{escape(t)}</th>" for _, t in columns) + "</tr>"
    shown = {"costUSD": usd, "tokens": tokens, "sessionCount": whole, "messages": whole}
    body = "".join(f"<tr><td>{escape(n)}</td>" + "".join(f"<td>{shown[c](x[c])}</td>" for c, _ in columns) + "</tr>" for x, n in zip(items, names, strict=True))
    return f"<table>{head}{body}</table>"


def usage_page(report: dict) -> str:
    s, full = report["summary"], [("costUSD", "Cost"), ("tokens", "Tokens"), ("sessionCount", "Runs"), ("messages", "Messages")]
    cards = {
        "Cost": usd(s["totalCostUSD"]), "Tokens": tokens(s["totalTokens"]), "Runs": whole(s["sessionCount"]), "Messages": whole(s["messages"]), "Active days": whole(s["activeDays"]),
        "Streak": f"{s['currentStreakDays']} / {s['longestStreakDays']}", "Peak hour": hour_label(s["peakHourLocal"]), "Favourite": s["favoriteModel"]["label"],
    }
    models, projects, daily = report["byModel"][:TOP_MODELS], report["byProject"][:TOP_PROJECTS], report["daily"]
    warned = "".join(f"<li>{escape(w['model'])}: {tokens(w['tokens'])} tokens without a price</li>" for w in report["warnings"])
    period = period_label(report["period"]["from"], report["period"]["to"])
    return "".join(
        (
            f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Usage {escape(period)}</title><style>{STYLE}</style></head><body>',
            f"<h1>Usage</h1><p>{escape(period)}</p>",
            f'<ul class="warn">{warned}</ul>' if warned else "",
            '<div class="cards">' + "".join(f'<div class="card">{escape(k)}<b>{escape(v)}</b></div>' for k, v in cards.items()) + "</div>",
            "<h2>Days</h2>" + bars([d["costUSD"] for d in daily], [d["date"][5:] for d in daily]),
            "<h2>Weeks</h2>" + bars([w["tokens"] for w in report["insights"]["weekly"]], [w["weekEnding"][5:] for w in report["insights"]["weekly"]]),
            "<h2>Hours</h2>" + bars(report["insights"]["hourCounts"], [str(h) for h in range(24)]),
            "<h2>Weekdays</h2>" + bars(report["insights"]["weekdayCounts"], ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]),
            "<h2>Tools</h2>" + rows(report["byTool"], full, [x["label"] for x in report["byTool"]]),
            "<h2>Models</h2>" + rows(models, full, [x["label"] for x in models]),
            "<h2>Projects</h2>" + rows(projects, full[:3], [x["label"] for x in projects]),
            "</body></html>",
        )
    )


def primer_markdown(repo: str, recent: list[dict], headlines: list[dict], full: bool = False, tool: str = "") -> str:
    """Two tiers: runs in detail, then one line each; five files unless ``full``."""
    if not recent and not headlines:
        return f"No {tool + ' ' if tool else ''}runs found for {repo}."
    out = [f"# Recent runs: {repo}", ""]
    for r in recent:
        out.append(f"## {r['date']} · {r['tool']} · {r['branch']} · {r['message_count']} messages")
        out.append(f"**{r['custom_title'] or r['first_prompt']}**")
        files = r["files_touched"]
        shown = files if full else files[:SHOWN_FILES]
        if shown:
            more = f" (+{len(files) - len(shown)} more)" if len(files) > len(shown) else ""
            out.append("Files: " + ", ".join(f"`{f}`" for f in shown) + more)
        for who, text in (("User", r["closing_user"]), ("Assistant", r["closing_assistant"])):
            if text:
                out.append(f"{who}: {text}")
        out.append("")
    if headlines:
        out.append("## Earlier")
        out += [f"- {h['date']} [{h['tool']}] {h['branch']}: {h['custom_title'] or h['first_prompt']}" for h in headlines]
    return "\n".join(out).rstrip() + "\n"


def session_line(row: dict, columns: int, exists: bool, age: str) -> str:
    """Folder, tool, id, state, prompt and display, parted by tabs; the prompt is cut to the width."""
    prompt = row.get("display_text") or "(no prompt)"
    most = max(20, columns - 50)
    cut = prompt if len(prompt) <= most else prompt[: most - 1] + "…"
    folder = row["cwd"].rstrip("/").rsplit("/", 1)[-1] or "(root)"
    count = f"{row['message_count']}msg  " if row["message_count"] > 0 else ""
    display = f"{'●' if exists else '○'} {folder}  {row['tool']}  {age}  {count}{'⚠ ' if row.get('errored') else ''}{cut}"
    return "\t".join((row["cwd"], row["tool"], row["session_id"], "exists" if exists else "deleted", prompt, display))
