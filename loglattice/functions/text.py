"""Text expressions for prompts, messages and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks that hosts put into user messages.
INJECTED = ("system-reminder", "local-command-caveat", "local-command-stdout", "command-name", "command-message", "command-args")


def clean(text: Column, limit: int = 100) -> Column:
    """Without tags, white space collapsed, trimmed, its first ``limit`` characters."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\s+", " ")
    return F.substring(F.trim(bare), 1, limit)


def strip_injected(text: Column) -> Column:
    for tag in INJECTED:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    return text


def js_trim(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s ﻿]+", ""), r"[\s ﻿]+$", "")


def strip_insight_fences(text: Column) -> Column:
    """Without fence lines of insight boxes; runs of empty lines shortened."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*★\s*Insight\s*─*\s*$") & ~x.rlike(r"^\s*─{5,}\s*$"))
    return js_trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def match_context(text: Column, query: str, before: int = 30, after: int = 70) -> Column:
    """What stands around the first match, on one line, with an ellipsis where it is cut; null without a match."""
    at = F.instr(F.lower(text), query.lower()) - 1
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(text), at + len(query) + after)
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), "\n", " "))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at >= 0, cut)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)


def resume_command(tool: Column, cwd: Column, session_id: Column) -> Column:
    go = F.concat(F.lit('cd "'), cwd, F.lit('"'))
    return F.when(tool == "claude", F.concat(go, F.lit(" && claude --resume "), session_id)).otherwise(go)
