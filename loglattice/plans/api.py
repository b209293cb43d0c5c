"""The five questions of the tool interface, over a store: DataFrames or few rows, and a fixed sentence where there is nothing."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import resume_command
from ..operators import rollups, search
from ..operators.session_index import message_page
from ..sources.store import Index

NOTHING = "No session found."
NONE_IN_RANGE = "No session found in that date range."
#: Words whose text columns are looked at for a snippet.
TEXTS = list(search.WEIGHTS)


@dataclass
class Repo:
    """Where a code base lies: its container, the work tree one stands in, and the branch of each tree."""

    container: str
    worktree: str = ""
    branches: dict[str, str] = field(default_factory=dict)


def resolve_repo(cwd: str) -> Repo | None:
    """Asks git; a bare repository's container is the folder above ``.bare``. None outside of a repository."""
    import subprocess

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", cwd, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    common, top = git("rev-parse", "--path-format=absolute", "--git-common-dir"), git("rev-parse", "--show-toplevel")
    if not common:
        return None
    path = Path(common)
    container = str(path.parent) if path.name in (".git", ".bare") else (top or str(path))
    branches, tree = {}, ""
    for line in (git("worktree", "list", "--porcelain") or "").split("\n"):
        if line.startswith("worktree "):
            tree = line[9:]
        elif line.startswith("branch "):
            branches[tree] = line[7:].removeprefix("refs/heads/")
    return Repo(container, top or cwd, branches)


def search_runs(index: Index, query: str = "", tool: str | None = None, project: str | None = None, errored: bool = False, limit: int = 20) -> DataFrame:
    """Runs by relevance, or the newest ones for an empty query, with score, resume command and, of those that are shown, the snippet."""
    shown = rollups.scoped(index.runs, tool, project, errored)
    phrases = search.query_phrases(query)
    if not query.strip():
        found = rollups.recent(shown, limit).withColumn("score", F.lit(None).cast("double"))
    elif not phrases:
        found = shown.where("false").withColumn("score", F.lit(None).cast("double"))
    else:
        postings = index.postings.withColumnRenamed("file_path", "key")
        scores = search.bm25(postings, phrases, documents=index.runs.select("file_path"))
        found = search.ranked(scores, shown, limit)
    shown = search.snippets([f"text.{c}" for c in TEXTS], phrases) if phrases else F.lit(None).cast("string")
    return found.withColumn("resume_command", resume_command(F.col("tool"), F.col("cwd"), F.col("session_id"))).withColumn("snippet", shown)


def search_results(index: Index, query: str = "", **options) -> list[dict]:
    """The same as rows for display, with a snippet of what was found; at most ``limit`` rows reach the driver."""
    out = []
    for r in search_runs(index, query, **options).drop("text").collect():
        title = r.custom_title or None
        out.append(
            {
                "sessionId": r.session_id,
                "tool": r.tool,
                "cwd": r.cwd,
                "date": r.date,
                "title": title,
                "firstPrompt": r.first_prompt,
                "messageCount": r.message_count,
                "files": list(dict.fromkeys([*r.files_touched, *r.files_read])),
                "errored": r.errored,
                "filePath": r.file_path,
                "displayText": r.snippet or title or r.first_prompt,
                "score": r.score,
                "resumeCommand": r.resume_command,
            }
        )
    return out


def get_session_messages(index: Index, file_path: str, offset: int = 0, limit: int = 20) -> dict:
    own = index.messages.where(F.col("file_path") == file_path)
    page = [{"index": r["index"], "role": r.role, "text": r.text} for r in message_page(own, file_path, offset, limit).collect()]
    return {"total": own.count(), "offset": offset, "returned": len(page), "messages": page}


def get_activity_digest(index: Index, start: str, end: str, tool: str | None = None, project: str | None = None, detail: str = "compact") -> dict | str:
    chosen = rollups.scoped(rollups.in_range(index.runs, start, end), tool, project)
    totals = rollups.digest_totals(chosen).first()
    if not totals.session_count:
        return NONE_IN_RANGE
    days: dict[str, dict] = {}
    for r in rollups.digest(chosen).orderBy("created_at", "cwd").collect():
        entry = {"project": r.cwd, "sessionCount": r.session_count, "totalMessages": r.messages, "tools": r.tools, "topics": r.topics, "filePaths": r.file_paths}
        days.setdefault(r.created_at, {})[r.cwd] = entry
    if rollups.DETAIL[detail]:
        for r in rollups.digest_details(chosen, index.messages, detail).orderBy("created_at", "cwd", "rank").collect():
            told = {"sessionId": r.session_id, "messageCount": r.message_count, "userMessages": r.user_messages}
            days[r.created_at][r.cwd].setdefault("sessionDetails", []).append(told)
    tools = {r.tool: r.session_count for r in rollups.metrics(chosen, "tool").orderBy("tool").collect()}
    return {"startDate": start, "endDate": end, "sessionCount": totals.session_count, "totalMessages": totals.messages, "projects": totals.projects, "tools": tools, "days": [{"date": d, "projects": list(p.values())} for d, p in days.items()]}


def get_session_metrics(index: Index, start: str, end: str, tool: str | None = None, project: str | None = None) -> dict | str:
    chosen = rollups.scoped(rollups.in_range(index.runs, start, end), tool, project)
    totals = rollups.metrics(chosen).first()
    if not totals.session_count:
        return NONE_IN_RANGE
    return {
        "sessionCount": totals.session_count,
        "totalMessages": totals.messages,
        "toolBreakdown": {r.tool: r.session_count for r in rollups.metrics(chosen, "tool").orderBy("tool").collect()},
        "projectBreakdown": [{"project": r.cwd, "sessionCount": r.session_count, "messages": r.messages} for r in rollups.metrics(chosen, "cwd").orderBy(F.desc("session_count"), "cwd").collect()],
        "dailyActivity": [{"date": r.created_at, "sessionCount": r.session_count, "messages": r.messages} for r in rollups.metrics(chosen, "created_at").orderBy("created_at").collect()],
        "activeHours": {r.hour: r.session_count for r in rollups.active_hours(chosen).orderBy("hour").collect()},
    }


def get_context_primer(index: Index, repo: Repo, now: str, limit: int = 10, days: int | None = None, tool: str | None = None, worktree: bool = False) -> dict:
    root = repo.worktree if worktree and repo.worktree else repo.container
    recent, headlines = rollups.primer(index.runs, now, root, days, limit, tool)

    def shaped(df: DataFrame) -> list[dict]:
        branch = F.when(F.col("branch") != "", F.col("branch")).otherwise(rollups.branch_label(F.col("cwd"), repo.branches))
        return [r.asDict() for r in df.withColumn("branch", branch).drop("text").collect()]

    found = {"repo": Path(repo.container).name, "recent": shaped(recent), "headlines": shaped(headlines)}
    return found | {"isEmpty": not found["recent"] and not found["headlines"]}
