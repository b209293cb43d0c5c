"""Usage events from log lines of each tool."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import resolve_project
from .session_index import _string

EVENT = ("tool", "provider", "model", "ts", "session_id", "project", "input", "output", "cache_read", "cache_write", "cache_write_1h", "cost_usd", "file_path", "line_no")
COUNTS = ("input", "output", "cache_read", "cache_write")


def _count(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "bigint"), F.lit(0).cast("long"))


def _shaped(df: DataFrame, **columns: Column) -> DataFrame:
    named = {
        "cache_write_1h": F.lit(0).cast("long"),
        "cost_usd": F.lit(None).cast("double"),
        "file_path": F.col("file_path"),
        "line_no": F.col("line_no"),
    } | columns
    out = df.select(*[named[c].alias(c) for c in EVENT])
    # a time that can't be read has no day to count for: such events are left out
    return out.where("ts is not null")


def _nonempty(*columns: Column) -> Column:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.coalesce(c != "", F.lit(False))
    return keep


def _read(lines: DataFrame, fields: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(file_path, line_no, fields) of lines: what ``fields`` takes from each line's JSON.

    The fields come out of a generator, so the JSON of a line is parsed once,
    however many fields and filters refer to it, and doesn't move on: what
    follows sorts and shuffles narrow rows.
    """
    taken = F.array(F.struct(*[c.alias(name) for name, c in fields(F.col("v")).items()]))
    return lines.select("file_path", "line_no", F.inline(taken))


def _given(v: Column, path: str) -> Column:
    """Whether there is anything but null at ``path``."""
    x = F.try_variant_get(v, path, "variant")
    return x.isNotNull() & ~F.is_variant_null(x)


def claude_events(lines: DataFrame) -> DataFrame:
    """One event for each message and request, wherever it is logged first (by file and line); messages without an id are never merged."""
    usage = "$.message.usage"

    def fields(v: Column) -> dict[str, Column]:
        return {
            "kind": _string(v, "$.type"), "used": _given(v, usage), "model": _string(v, "$.message.model"), "session_id": _string(v, "$.sessionId"), "stamp": _string(v, "$.timestamp"),
            "cwd": F.coalesce(_string(v, "$.cwd"), F.lit("")), "id": _string(v, "$.message.id"), "request": F.coalesce(_string(v, "$.requestId"), F.lit("")),
            "input": _count(v, f"{usage}.input_tokens"), "output": _count(v, f"{usage}.output_tokens"), "cache_read": _count(v, f"{usage}.cache_read_input_tokens"),
            "cache_write": _count(v, f"{usage}.cache_creation_input_tokens"), "cache_write_1h": _count(v, f"{usage}.cache_creation.ephemeral_1h_input_tokens"),
        }

    rows = _read(lines.where("tool = 'claude'"), fields).where((F.col("kind") == "assistant") & F.col("used") & _nonempty(*map(F.col, ("model", "session_id", "stamp"))))
    rows = rows.select("file_path", "line_no", "id", "request", "model", "session_id", F.try_to_timestamp("stamp").alias("ts"), resolve_project(F.col("cwd")).alias("project"), *COUNTS, "cache_write_1h")
    named = F.coalesce(F.col("id") != "", F.lit(False))
    # a message without an id is dealt by its own place
    own = [F.when(~named, F.col(c)) for c in ("file_path", "line_no")]
    first = Window.partitionBy(F.when(named, F.col("id")), F.when(named, F.col("request")), *own).orderBy("file_path", "line_no")
    once = rows.withColumn("n", F.row_number().over(first)).where((F.col("n") == 1) | ~named)
    return _shaped(once, tool=F.lit("claude-code"), provider=F.lit("anthropic"), **{c: F.col(c) for c in ("model", "ts", "session_id", "project", *COUNTS, "cache_write_1h")})


#: Lines of a file that are filled in one task.
BLOCK_LINES = 1 << 16


def forward_fill(rows: DataFrame, values: dict[str, Column], key: str = "file_path", order: str = "line_no", block: int = BLOCK_LINES) -> DataFrame:
    """Adds columns that hold the latest value that isn't null at or before each row of its key, null before the first.

    Rows are filled within blocks of ``order``; what each block ends with is
    carried over the blocks behind it by a window that has one row a block. So
    a file of any length is filled by many tasks, and rows move and are sorted
    once: a carried value is a row of its own before its block's first. Null
    keys are one key; rows of equal order are filled in any order among
    themselves.
    """
    taken = {c.lower() for c in rows.columns} | {c.lower() for c in values}
    at, carried = (next(n for n in (base + "_" * i for i in range(len(taken) + 1)) if n not in taken) for base in ("block", "carried"))
    blocks = rows.withColumns({**values, at: F.floor(F.col(order) / block), carried: F.lit(False)})
    ends = blocks.groupBy(key, at).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values])
    before = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(key, at, F.lit(True).alias(carried), *[F.last(c, ignorenulls=True).over(before).alias(c) for c in values])
    heads = heads.where(reduce(or_, [F.col(c).isNotNull() for c in values]))
    both = blocks.unionByName(heads, allowMissingColumns=True)
    so_far = Window.partitionBy(key, at).orderBy(F.desc(carried), order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select(*rows.columns, carried, *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in values]).where(~F.col(carried)).drop(carried)


def codex_events(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """Token counts with the latest session and model before them in the file; counts before either are left out.

    The session is filled as a whole, so a later one without a folder doesn't
    take over an earlier one's. One whose id is no string is none.
    """
    usage = "$.payload.info.last_token_usage"

    def fields(v: Column) -> dict[str, Column]:
        return {
            "kind": _string(v, "$.type"), "counted": _string(v, "$.payload.type") == "token_count", "used": _given(v, usage), "id": _string(v, "$.payload.id"), "cwd": F.coalesce(_string(v, "$.payload.cwd"), F.lit("")),
            "named_model": _string(v, "$.payload.model"), "stamp": _string(v, "$.timestamp"), "cached": _count(v, f"{usage}.cached_input_tokens"), "all_input": _count(v, f"{usage}.input_tokens"), "output": _count(v, f"{usage}.output_tokens"),
        }

    kind = F.col("kind")
    counted = (kind == "event_msg") & F.col("counted")
    rows = _read(lines.where("tool = 'codex'"), fields).where(kind.isin("session_meta", "turn_context") | counted)
    meta = F.when((kind == "session_meta") & F.col("id").isNotNull(), F.struct("id", "cwd"))
    model = F.when(kind == "turn_context", F.col("named_model"))
    told = rows.select("file_path", "line_no", (counted & F.col("used")).alias("event"), F.try_to_timestamp(F.when(counted, F.col("stamp"))).alias("ts"), "cached", "all_input", "output", meta.alias("meta"), model.alias("own_model"))
    filled = forward_fill(told, {"session": F.col("meta"), "of_model": F.col("own_model")}, block=block)
    found = filled.where(F.col("event") & F.col("session").isNotNull() & _nonempty(F.col("of_model")))
    zero = F.lit(0).cast("long")
    return _shaped(
        found, tool=F.lit("codex"), provider=F.lit("openai"), model=F.col("of_model"), ts=F.col("ts"), session_id=F.col("session.id"), project=resolve_project(F.col("session.cwd")),
        input=F.greatest(zero, F.col("all_input") - F.col("cached")), output=F.col("output"), cache_read=F.col("cached"), cache_write=zero,
    )


def pi_events(lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """Assistant messages with usage, in the message or, as older logs have it, beside it; the latest session before them."""

    def fields(v: Column) -> dict[str, Column]:
        def either(path: str, kind_of: str) -> Column:
            return F.coalesce(F.try_variant_get(v, f"$.message.{path}", kind_of), F.try_variant_get(v, f"$.{path}", kind_of))

        u = either("usage", "variant")
        return {
            "kind": _string(v, "$.type"), "role": _string(v, "$.message.role"), "used": u.isNotNull(), "provider": either("provider", "string"), "model": either("model", "string"), "id": F.coalesce(_string(v, "$.id"), F.lit("")), "cwd": F.coalesce(_string(v, "$.cwd"), F.lit("")),
            "stamp": F.coalesce(_string(v, "$.timestamp"), _string(v, "$.message.timestamp")), "input": _count(u, "$.input"), "output": _count(u, "$.output"), "cache_read": _count(u, "$.cacheRead"), "cache_write": _count(u, "$.cacheWrite"), "cost_usd": F.try_variant_get(u, "$.cost.total", "double"),
        }

    kind = F.col("kind")
    rows = _read(lines.where("tool = 'pi'"), fields).where(kind.isin("session", "message"))
    event = (kind == "message") & (F.col("role") == "assistant") & F.col("used") & _nonempty(F.col("provider"), F.col("model"))
    told = rows.select("file_path", "line_no", event.alias("event"), F.try_to_timestamp(F.when(event, F.col("stamp"))).alias("ts"), "provider", "model", *COUNTS, "cost_usd", F.when(kind == "session", F.struct("id", "cwd")).alias("meta"))
    found = forward_fill(told, {"session": F.col("meta")}, block=block).where(F.col("event") & F.col("session").isNotNull())
    own = ("provider", "model", "ts", *COUNTS, "cost_usd")
    return _shaped(found, tool=F.lit("pi"), session_id=F.col("session.id"), project=resolve_project(F.col("session.cwd")), **{c: F.col(c) for c in own})


SOURCES = {"claude": claude_events, "codex": codex_events, "pi": pi_events}
#: The name of each log source in usage events.
TOOL_IDS = {"claude": "claude-code", "codex": "codex", "pi": "pi"}


def gather(lines: DataFrame, tools: tuple[str, ...] = tuple(SOURCES)) -> DataFrame:
    """Events of the wanted tools; other branches are not built."""
    out = None
    for tool in tools:
        part = SOURCES[tool](lines)
        out = part if out is None else out.unionByName(part)
    return out
