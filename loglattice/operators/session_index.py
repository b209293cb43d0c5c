"""One row a session, its messages and its searchable text, from log lines.

Each line is reduced once to what the folds need (``line_facts``); folds over a
session are aggregates ordered by line number, so a session's lines meet in one
shuffle and texts that nothing needs are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, js_trim, strip_injected, strip_insight_fences

MAX_FILES, MAX_COMMANDS, MAX_ERRORS, MAX_ERROR_CHARS, MAX_THINKING, MAX_CLOSING = 50, 100, 20, 300, 20_000, 500
#: Lines from the end among which the last timestamp is looked for.
TAIL_LINES = 200
EDIT_TOOLS = ("Edit", "Write", "MultiEdit")
READ_TOOLS = ("Read", "Grep", "Glob")
NO_DATE = "?"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _string(v: Column, path: str) -> Column:
    """The value at ``path`` if it is a string, else null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(_is(x, "STRING"), F.try_variant_get(v, path, "string"))


def _items(v: Column, path: str) -> Column:
    """The elements at ``path`` if it is an array, else none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _true(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return _is(x, "BOOLEAN") & F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def _truthy(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    text = F.try_variant_get(v, path, "string")
    return x.isNotNull() & ~F.is_variant_null(x) & ~F.coalesce(text.isin("", "false", "0"), F.lit(False))


def _texts(v: Column, path: str, kinds: tuple[str, ...], glue: str = " ", field: str = "$.text") -> Column:
    found = F.filter(_items(v, path), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string").isin(*kinds) & _string(b, field).isNotNull(), F.lit(False)))
    return F.array_join(F.transform(found, lambda b: _string(b, field)), glue)


def _text_of(v: Column, path: str) -> Column:
    """A string as it is, or the texts of an array's elements joined by blanks and trimmed; anything else is empty."""
    items = F.try_variant_get(v, path, "array<variant>")
    joined = js_trim(F.array_join(F.transform(items, lambda b: F.coalesce(_string(b, "$.text"), F.lit(""))), " "))
    return F.coalesce(_string(v, path), joined, F.lit(""))


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: F.coalesce(x != "", F.lit(False)))


def _or(text: Column, other: Column | str) -> Column:
    return F.when(text != "", text).otherwise(F.lit(other) if isinstance(other, str) else other)


def line_facts(lines: DataFrame) -> DataFrame:
    """What each line contributes to its session."""
    v, tool = F.col("v"), F.col("tool")
    kind, role = _string(v, "$.type"), _string(v, "$.message.role")
    message = F.try_variant_get(v, "$.message", "variant")
    content = F.try_variant_get(v, "$.message.content", "variant")
    payload_kind = _string(v, "$.payload.type")
    claude, codex, pi = tool == "claude", tool == "codex", tool == "pi"
    no = F.array().cast("array<string>")

    user = F.coalesce((kind == "user") | ((kind == "message") & (role == "user")), F.lit(False))
    assistant = F.coalesce((kind == "assistant") | ((kind == "message") & (role == "assistant")), F.lit(False))
    user_text = strip_injected(F.when(_is(content, "ARRAY"), _texts(v, "$.message.content", ("text", "input_text"))).otherwise(F.coalesce(_string(v, "$.message.content"), F.lit(""))))
    said = F.when(_is(message, "STRING"), _string(v, "$.message")).when(_is(content, "ARRAY"), _texts(v, "$.message.content", ("text",))).otherwise(F.coalesce(_string(v, "$.message.content"), F.lit("")))
    source = F.try_variant_get(v, "$.promptSource", "variant")
    genuine = F.when(source.isNotNull(), F.coalesce(_string(v, "$.promptSource").isin("typed", "queued"), F.lit(False))).otherwise(~F.startswith(user_text, F.lit("Base directory for this skill:")))

    cwd = F.when(claude, _string(v, "$.cwd")).when(pi & (kind == "session"), _string(v, "$.cwd")).when(codex & (kind == "session_meta"), _string(v, "$.payload.cwd"))
    branch = F.when(claude, _string(v, "$.gitBranch")).when(codex & (kind == "session_meta"), _string(v, "$.payload.git.branch"))
    stamp = _string(v, "$.timestamp")

    blocks = _items(v, "$.message.content")
    uses = F.filter(F.when(F.coalesce(kind == "assistant", F.lit(False)), blocks).otherwise(F.array().cast("array<variant>")), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False)))

    def used(names: tuple[str, ...], of) -> Column:
        return F.transform(F.filter(uses, lambda b: F.coalesce(F.try_variant_get(b, "$.name", "string").isin(*names), F.lit(False))), of)

    edited = used((*EDIT_TOOLS, "NotebookEdit"), lambda b: F.when(F.try_variant_get(b, "$.name", "string") == "NotebookEdit", _string(b, "$.input.notebook_path")).otherwise(_string(b, "$.input.file_path")))
    read = used(READ_TOOLS, lambda b: F.coalesce(_string(b, "$.input.file_path"), _string(b, "$.input.path"), _string(b, "$.input.pattern")))
    patch = F.when((payload_kind == "custom_tool_call") & (_string(v, "$.payload.name") == "apply_patch"), _string(v, "$.payload.input"))
    patched = F.transform(F.split(patch, "\n"), lambda x: js_trim(F.regexp_extract(js_trim(x), r"^\*\*\* (?:Add|Update|Delete) File: (.+)$", 1)))

    ran_list = F.transform(F.filter(_items(v, "$.payload.command"), lambda x: _is(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string"))
    ran = F.when(payload_kind == "exec_command_end", F.array(js_trim(F.coalesce(_string(v, "$.payload.command"), F.array_join(ran_list, " ")))))
    calls = F.transform(F.filter(blocks, lambda b: F.coalesce((F.try_variant_get(b, "$.type", "string") == "toolCall") & (F.try_variant_get(b, "$.name", "string") == "bash"), F.lit(False))), lambda b: js_trim(_string(b, "$.arguments.command")))
    bash = F.coalesce(role == "bashExecution", F.lit(False))
    is_message = F.coalesce(kind == "message", F.lit(False))
    commands = (
        F.when(claude, used(("Bash",), lambda b: js_trim(_string(b, "$.input.command"))))
        .when(codex, ran)
        .when(pi & is_message, F.when(bash, F.array(js_trim(_string(v, "$.message.command")))).otherwise(calls))
    )

    api_error = _truthy(v, "$.isApiErrorMessage")
    results = F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False)) & _true(b, "$.is_error"))
    code = F.when(F.schema_of_variant(F.try_variant_get(v, "$.payload.exit_code", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.payload.exit_code", "double"))
    pi_code = F.when(F.schema_of_variant(F.try_variant_get(v, "$.message.exitCode", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.message.exitCode", "double"))

    def exit_text(path: str) -> Column:
        return F.concat(F.lit("exit "), F.try_variant_get(v, path, "string"))

    errors = (
        F.when(claude & api_error, F.array(_or(_text_of(v, "$.message.content"), "api error")))
        .when(claude & (kind == "user"), F.transform(results, lambda b: _or(_text_of(b, "$.content"), "tool error")))
        .when(codex & (payload_kind == "exec_command_end") & (code != 0), F.array(_or(_text_of(v, "$.payload.stderr"), _or(_text_of(v, "$.payload.formatted_output"), exit_text("$.payload.exit_code")))))
        .when(codex & (payload_kind == "error"), F.array(_or(_text_of(v, "$.payload.message"), "error")))
        .when(pi & is_message & (role == "toolResult") & _true(v, "$.message.isError"), F.array(_or(_text_of(v, "$.message.content"), "tool error")))
        .when(pi & is_message & (role == "assistant") & (F.coalesce(_string(v, "$.message.errorMessage"), F.lit("")) != ""), F.array(_string(v, "$.message.errorMessage")))
        .when(pi & is_message & bash & (pi_code != 0), F.array(_or(_text_of(v, "$.message.output"), exit_text("$.message.exitCode"))))
    )
    thinking = F.when(~codex & F.coalesce(kind.isin("assistant", "message"), F.lit(False)), F.transform(F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "thinking", F.lit(False)) & _string(b, "$.thinking").isNotNull()), lambda b: _string(b, "$.thinking")))

    def given(x: Column) -> Column:
        return F.when(x != "", x)

    return lines.select(
        "tool", "file_path", "file_size", "mtime", "n_lines", "line_no", user.alias("is_user"), assistant.alias("is_assistant"),
        F.when(user, user_text).alias("user_text"), F.when(assistant, said).alias("assistant_text"), (user & genuine & (js_trim(user_text) != "")).alias("genuine"),
        given(cwd).alias("cwd"), given(branch).alias("branch"), F.when(kind == "custom-title", F.coalesce(_string(v, "$.customTitle"), F.lit(""))).alias("title"),
        F.when(stamp.startswith("2"), F.substring(stamp, 1, 10)).alias("day"), F.when(F.col("line_no") == 0, F.when(F.contains(stamp, F.lit("T")), F.substring(stamp, 12, 2))).alias("first_hour"),
        _present(F.coalesce(F.when(claude, edited).when(codex, patched), no)).alias("files"), _present(F.coalesce(F.when(claude, read), no)).alias("read"),
        _present(F.coalesce(commands, no)).alias("commands"), F.coalesce(errors, no).alias("errors"), F.coalesce(thinking, no).alias("thinking"),
    )


def _ordered(column: str) -> Column:
    """All values of a list column in line order."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(column) > 0, F.struct("line_no", F.col(column).alias("x"))))), lambda s: s["x"]))


def _first(value: Column, when: Column | None = None) -> Column:
    return F.min_by(value, F.when(value.isNotNull() if when is None else when, F.col("line_no")))


def _last(value: Column, when: Column | None = None) -> Column:
    return F.max_by(value, F.when(value.isNotNull() if when is None else when, F.col("line_no")))


def session_rows(lines: DataFrame, subagents: DataFrame | None = None) -> DataFrame:
    """The session table: one row for each file that names a working folder outside of worktrees and bare repositories.

    ``subagents`` adds its user texts to the searchable text of the parent.
    """
    facts = line_facts(lines)
    col = F.col
    genuine = col("genuine")
    tail = F.when(col("line_no") >= col("n_lines") - TAIL_LINES, col("day"))
    spoken = F.when(col("is_assistant") & (js_trim(F.coalesce("assistant_text", F.lit(""))) != ""), col("assistant_text"))
    folded = facts.groupBy("tool", "file_path", "file_size", "mtime").agg(
        _first(col("cwd")).alias("cwd"), F.when(F.first("tool") == "claude", _last(col("branch"))).otherwise(_first(col("branch"))).alias("branch"),
        _first(col("user_text"), F.when(genuine, True)).alias("prompt"), _last(col("title")).alias("title"), _first(col("day")).alias("created_at"),
        F.coalesce(_last(tail), _first(col("day"))).alias("date"), F.count_if(col("is_user") | col("is_assistant")).cast("int").alias("message_count"),
        _last(col("user_text"), F.when(genuine, True)).alias("closing_user"), _last(spoken).alias("closing_assistant"), F.max("first_hour").alias("first_hour"), F.max("n_lines").alias("n_lines"),
        _ordered("files").alias("files"), _ordered("read").alias("read"), _ordered("commands").alias("commands"), _ordered("errors").alias("errors"), _ordered("thinking").alias("thinking"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(genuine, F.struct("line_no", "user_text")))), lambda s: s["user_text"]), "\n").alias("user_content"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(spoken.isNotNull(), F.struct("line_no", spoken.alias("x"))))), lambda s: s["x"]), "\n").alias("assistant_content"),
    )
    kept = folded.where(col("cwd").isNotNull() & ~F.contains("cwd", F.lit(".claude/worktrees")) & ~F.contains("cwd", F.lit("/.bare")))
    if subagents is not None:
        extra = line_facts(subagents.drop("sidecar")).where("is_user and trim(user_text) <> ''").groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "user_text"))), lambda s: s["user_text"]), "\n").alias("extra"))
        kept = kept.join(extra, "file_path", "left").withColumn("user_content", F.concat_ws("\n", F.when(col("user_content") != "", col("user_content")), "extra"))

    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    files = F.slice(F.array_distinct("files"), 1, MAX_FILES)
    read = F.slice(F.array_distinct("read"), 1, MAX_FILES)
    commands = F.slice(F.array_distinct("commands"), 1, MAX_COMMANDS)
    errors = F.transform(F.slice("errors", 1, MAX_ERRORS), lambda e: F.substring(e, 1, MAX_ERROR_CHARS))
    closing = F.substring(js_trim(strip_injected(strip_insight_fences(empty(col("closing_assistant"))))), 1, MAX_CLOSING)
    prompt, title = clean(empty(col("prompt"))), empty(col("title"))
    return kept.select(
        "file_path", "mtime", col("file_size").alias("size"), "cwd", "tool", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).alias("session_id"),
        F.coalesce("date", F.lit(NO_DATE)).alias("date"), F.coalesce("created_at", F.lit(NO_DATE)).alias("created_at"), prompt.alias("first_prompt"), title.alias("custom_title"), "message_count",
        files.alias("files_touched"), read.alias("files_read"), commands.alias("commands"), (F.size("errors") > 0).alias("errored"), F.size("errors").alias("error_count"),
        F.substring(js_trim(empty(col("closing_user"))), 1, MAX_CLOSING).alias("closing_user"), closing.alias("closing_assistant"), empty(col("branch")).alias("branch"),
        F.when(col("n_lines") > 1, col("first_hour")).alias("first_hour"),
        F.struct(
            F.concat_ws("\n", prompt, title).alias("headline"), "user_content", "assistant_content", F.array_join(commands, "\n").alias("commands"),
            F.array_join(F.concat(files, read), "\n").alias("paths"), F.array_join(errors, "\n").alias("context_text"), F.substring(F.array_join("thinking", "\n"), 1, MAX_THINKING).alias("thinking"),
        ).alias("text"),
    )


def messages(lines: DataFrame) -> DataFrame:
    """(file_path, index, role, text): user and assistant lines with visible text, numbered without gaps."""
    facts = line_facts(lines).where("is_user or is_assistant").select("file_path", "line_no", F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"), F.coalesce("user_text", "assistant_text").alias("text"))
    shown = facts.where(js_trim(F.coalesce("text", F.lit(""))) != "")
    return shown.select("file_path", (F.row_number().over(Window.partitionBy("file_path").orderBy("line_no")) - 1).alias("index"), "role", "text")


def message_page(all_messages: DataFrame, file_path: str | None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of one file's messages in order, or of every file's."""
    of = F.lit(True) if file_path is None else F.col("file_path") == file_path
    return all_messages.where(of & (F.col("index") >= offset) & (F.col("index") < offset + limit)).orderBy("index")
