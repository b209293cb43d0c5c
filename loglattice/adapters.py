"""Canonical frames made from the tables of the test data, and fixed settings of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sources import log_source, shared

TZ = "America/Chicago"
TODAY = "2024-01-30"
NOW = "1998-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as usage: the kind is the tool, users give runs, providers, models and projects, props the tokens."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")

    def named(prefix: str, n: int):
        return F.concat(F.lit(prefix), (user % n).cast("string"))

    zero = F.lit(0).cast("long")
    return e.select(
        F.col("event_type").alias("tool"), named("p", 3).alias("provider"), named("m", 7).alias("model"), "ts", user.cast("string").alias("session_id"), named("proj", 10).alias("project"),
        F.get_json_object("props", "$.k").cast("long").alias("input"), zero.alias("output"), zero.alias("cache_read"), zero.alias("cache_write"), zero.alias("cache_write_1h"), F.col("value").alias("cost_usd"), "event_id",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as log lines' messages; system turns are none."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_path"), F.col("turn").alias("line_no"), "role", "text")


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as runs: a customer's region and nation are the folder, the priority the tool, lines the messages."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").join(customer, orders["o_custkey"] == customer["c_custkey"])
    joined = joined.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    count = F.coalesce("n", F.lit(0))
    return joined.select(
        F.format_string("%012d", "o_orderkey").alias("file_path"), day.alias("date"), day.alias("created_at"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("cwd"), F.col("o_orderpriority").alias("tool"),
        count.alias("message_count"), F.array_repeat(F.lit("f"), (count % 4).cast("int")).alias("files_touched"), F.col("c_name").alias("first_prompt"), F.lit("").alias("custom_title"),
        (F.col("o_orderstatus") == "F").alias("errored"), F.lit("").alias("closing_user"), F.when(F.col("o_orderkey") % 5 == 0, "merged in /pull/12").otherwise("").alias("closing_assistant"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a price list: a model for each part; every third has a higher rate beyond the threshold, some no rates for the cache."""
    rate = F.col("p_retailprice") / 1e6
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("key"), rate.alias("input_rate"), (rate * 5).alias("output_rate"), F.when(F.col("p_size") % 2 == 0, rate * 1.5).alias("cache_write_rate"), F.when(F.col("p_size") % 5 == 0, rate / 4).alias("cache_read_rate"),
        F.when(F.col("p_partkey") % 3 == 0, rate * 2).alias("input_rate_above"), F.lit(None).cast("double").alias("output_rate_above"), F.lit(None).cast("double").alias("cache_write_rate_above"), F.lit(None).cast("double").alias("cache_read_rate_above"),
    )


def line_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as usage of parts' models; some events are recorded with a cost."""
    quantity = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("model"), (quantity * 8000).alias("input"), (quantity * 10).alias("output"), (quantity * 100).alias("cache_read"), (quantity * 20).alias("cache_write"),
        (quantity * 5).alias("cache_write_1h"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("cost_usd"),
    )


def _lines(rows: DataFrame, tool: str, file_path, line_no, line) -> DataFrame:
    """Rows as log lines: what ``sources.logs`` makes of files."""
    zero = F.lit(0)
    return rows.select(
        F.lit(tool).alias("tool"), file_path.alias("file_path"), zero.cast("long").alias("file_size"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"), F.lit(200).alias("n_lines"),
        line_no.cast("int").alias("line_no"), F.try_parse_json(F.to_json(line)).alias("v"),
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as log lines; assistants run a command each third turn, which fails each ninth."""
    c = table(spark, sf_dir, "conversations")
    day = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), F.col("conv_id").cast("int") % 40 + F.col("turn").cast("int")), "yyyy-MM-dd")
    text = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input"))
    ran = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run "), (F.col("turn") % 2).cast("string")).alias("command")).alias("input"))
    content = F.when(F.col("turn") % 3 == 0, F.array(text, ran)).otherwise(F.array(text))
    line = F.struct(
        F.col("role").alias("type"), F.struct("role", content.alias("content")).alias("message"), F.concat(day, F.lit("T08:00:00Z")).alias("timestamp"), F.concat(F.lit("/w/"), (F.col("conv_id") % 5).cast("string")).alias("cwd"),
        (F.col("turn") % 9 == 4).alias("isApiErrorMessage"),
    )
    return _lines(c, "claude", F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")), F.col("turn"), line)


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as usage lines; four neighbours share a message, two of them a request."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.struct(k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * 3).alias("cache_read_input_tokens"), (k + 7).alias("cache_creation_input_tokens"))
    message = F.struct(F.when(n % 5 != 0, F.concat(F.lit("m"), F.floor(n / 4).cast("string"))).alias("id"), F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"), usage.alias("usage"))
    line = F.struct(
        F.lit("assistant").alias("type"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sessionId"), F.concat(F.lit("/h/me/Developer/repo"), (F.col("user_id") % 4).cast("string"), F.lit("/x")).alias("cwd"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"), F.concat(F.lit("r"), F.floor(n / 2).cast("string")).alias("requestId"), message.alias("message"),
    )
    return _lines(e, "claude", F.lit("/logs/usage.jsonl"), n, line)


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` of a user as one file: sign-ups begin a session, views name a model, all others count tokens."""
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", "session_meta").when(F.col("event_type") == "view", "turn_context").otherwise("event_msg")
    used = F.struct((k + 10).alias("input_tokens"), k.alias("cached_input_tokens"), k.alias("output_tokens"))
    payload = F.struct(
        F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("id"),
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), F.lit("/w/even")).alias("cwd"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string"))).alias("model"),
        F.when(kind == "event_msg", F.lit("token_count")).alias("type"),
        F.when(kind == "event_msg", F.struct(used.alias("last_token_usage"))).alias("info"),
    )
    line = F.struct(kind.alias("type"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"), payload.alias("payload"))
    rows = e.withColumn("n", order)
    return _lines(rows, "codex", F.concat(F.lit("/logs/"), F.col("user_id").cast("string"), F.lit(".jsonl")), F.col("n"), line)


def _object(*fields: tuple[str, object]) -> Column:
    """A JSON object; fields whose value is null are left out."""
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(name) for name, x in fields])


def _json(*fields: tuple[str, object]) -> Column:
    return F.to_json(_object(*fields))


def conversation_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """``conversations`` as log files of three tools, written and named by tool: a file a conversation, a line a turn.

    Files of the second and third tool begin with a line that names the run.
    Behind every fifth turn stands a line that is no JSON. Users' turns of
    every other conversation of the first tool also stand in a helper's file.
    """
    c = table(spark, sf_dir, "conversations")
    n, turn, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    user, assistant = role == "user", role == "assistant"
    odd = (turn % 2).cast("string")
    stamp = F.concat(F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), n.cast("int") % 40 + turn.cast("int")), "yyyy-MM-dd"), F.lit("T08:00:00Z"))

    def named(prefix: str, of) -> Column:
        return F.concat(F.lit(prefix), of.cast("string"))

    def given(file_path=None, path=None) -> Column:
        return F.struct(*[(F.lit(x).cast("string") if x is None else x).alias(k) for k, x in (("file_path", file_path), ("path", path))])

    def block(kind: str, text=None, thinking=None, name=None, given=None) -> Column:
        return F.struct(*[(F.lit(x).cast("string") if x is None or isinstance(x, str) else x).alias(k) for k, x in (("type", kind), ("text", text), ("thinking", thinking), ("name", name))], (F.lit(None).cast("struct<file_path:string,path:string>") if given is None else given).alias("input"))

    worked = F.array(block("text", text=text), block("thinking", thinking=named("t", turn)), block("tool_use", name="Edit", given=given(file_path=named("/f", turn % 3))), block("tool_use", name="Grep", given=given(path=named("/r", turn))))
    folder = F.when(n % 7 == 0, F.lit("/w/.claude/worktrees/x")).otherwise(named("/w/p", n % 5))
    claude = F.when(user, _json(("type", "user"), ("cwd", folder), ("gitBranch", named("b", turn % 2)), ("promptSource", F.when(turn % 4 == 2, "system").when(turn % 4 == 1, "typed")), ("timestamp", stamp), ("message", _object(("role", "user"), ("content", text)))))
    claude = claude.when(assistant, _json(("type", "assistant"), ("timestamp", stamp), ("message", _object(("role", "assistant"), ("content", worked))))).otherwise(_json(("type", "custom-title"), ("customTitle", named("title ", turn))))
    codex = F.when(user, _json(("type", "message"), ("timestamp", stamp), ("message", _object(("role", "user"), ("content", F.array(_object(("type", "input_text"), ("text", text))))))))
    codex = codex.when(assistant, _json(("type", "event_msg"), ("timestamp", stamp), ("payload", _object(("type", "exec_command_end"), ("command", F.array(F.lit("run"), odd)), ("exit_code", turn % 3), ("stderr", named("bad ", turn))))))
    codex = codex.otherwise(_json(("type", "response_item"), ("payload", _object(("type", "custom_tool_call"), ("name", "apply_patch"), ("input", F.concat(F.lit("*** Begin\n*** Add File: n"), odd, F.lit(".py\n")))))))
    said = F.array(_object(("type", "text"), ("text", text), ("name", F.lit(None).cast("string")), ("arguments", F.lit(None).cast("struct<command:string>"))), _object(("type", "toolCall"), ("text", F.lit(None).cast("string")), ("name", "bash"), ("arguments", _object(("command", F.concat(F.lit(" make "), odd, F.lit(" ")))))))
    pi = F.when(user, _json(("type", "message"), ("timestamp", stamp), ("message", _object(("role", "user"), ("content", text)))))
    pi = pi.when(assistant, _json(("type", "message"), ("timestamp", stamp), ("message", _object(("role", "assistant"), ("content", said), ("errorMessage", F.when(turn % 5 == 1, named("failed ", turn)))))))
    pi = pi.otherwise(_json(("type", "message"), ("message", _object(("role", "bashExecution"), ("command", "ls"), ("exitCode", turn % 2), ("output", "out")))))

    tool = F.element_at(F.array(F.lit("claude"), F.lit("codex"), F.lit("pi")), (n % 3 + 1).cast("int"))
    path = F.when(n % 3 == 0, F.concat(named("claude/p", n % 5), named("/", n))).when(n % 3 == 1, F.concat(F.lit("codex/2024/03/"), n.cast("string"))).otherwise(F.concat(named("pi/d", n % 4), named("/", n)))
    line = F.when(n % 3 == 0, claude).when(n % 3 == 1, codex).otherwise(pi)
    turns = c.select(tool.alias("tool"), path.alias("path"), (turn * 4).alias("line_no"), line.alias("line"))
    junk = c.where(turn % 5 == 4).select(tool.alias("tool"), path.alias("path"), (turn * 4 + 1).alias("line_no"), F.lit("{ not json").alias("line"))
    meta = F.when(n % 3 == 1, _json(("type", "session_meta"), ("timestamp", "2024-02-01T05:00:00Z"), ("payload", _object(("id", named("c", n)), ("cwd", "/w/c"), ("git", _object(("branch", named("cb", n % 4))))))))
    meta = meta.otherwise(_json(("type", "session"), ("id", named("p", n)), ("cwd", "/w/pi")))
    heads = c.where(n % 3 > 0).select("conv_id").distinct().select(tool.alias("tool"), path.alias("path"), F.lit(-1).cast("long").alias("line_no"), meta.alias("line"))
    helpers = c.where((n % 6 == 0) & user).select(tool.alias("tool"), F.concat(path, F.lit("/subagents/h")).alias("path"), turn.alias("line_no"), claude.alias("line"))
    rows = turns.unionByName(junk).unionByName(heads).unionByName(helpers)
    root = shared.folder(spark, "logs")
    log_source.write_logs(rows.select(F.concat("path", F.lit(".jsonl")).alias("file_path"), "line_no", "line"), root)
    return {t: f"{root}/{t}" for t in ("claude", "codex", "pi")}


def event_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """``events`` as usage in log files of two tools, a file a user: sign-ups begin a session, views name a model, all others are usage."""
    e = table(spark, sf_dir, "events")
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))

    def named(prefix: str, of) -> Column:
        return F.concat(F.lit(prefix), of.cast("string"))

    cwd = F.when(n % 2 == 0, "/w/even")
    codex = F.when(kind == "signup", _json(("type", "session_meta"), ("payload", _object(("id", named("s", n)), ("cwd", cwd)))))
    codex = codex.when(kind == "view", _json(("type", "turn_context"), ("payload", _object(("model", named("g", n % 3))))))
    codex = codex.otherwise(_json(("type", "event_msg"), ("timestamp", stamp), ("payload", _object(("type", "token_count"), ("info", _object(("last_token_usage", _object(("input_tokens", k + 10), ("cached_input_tokens", k), ("output_tokens", k)))))))))
    used = _object(("input", k), ("output", k * 2), ("cacheRead", F.when(n % 3 == 0, k)), ("cost", _object(("total", F.when(n % 5 == 0, n % 100)))))
    names = (("provider", named("v", user % 3)), ("model", named("m", n % 4)), ("usage", used))
    pi = F.when(kind == "signup", _json(("type", "session"), ("id", named("s", n)), ("cwd", cwd)))
    pi = pi.when(kind == "view", _json(("type", "message"), ("timestamp", stamp), ("message", _object(("role", "user"), ("content", "hi")))))
    pi = pi.when(n % 2 == 0, _json(("type", "message"), ("timestamp", stamp), ("message", _object(("role", "assistant"), *names)))).otherwise(_json(("type", "message"), ("timestamp", stamp), ("message", _object(("role", "assistant"), ("content", "x"))), *names))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    path = F.concat(F.when(user % 2 == 0, "codex/u").otherwise("pi/u"), user.cast("string"), F.lit(".jsonl"))
    root = shared.folder(spark, "usage")
    log_source.write_logs(e.select(path.alias("file_path"), order.alias("line_no"), F.when(user % 2 == 0, codex).otherwise(pi).alias("line")), root)
    return {t: f"{root}/{t}" for t in ("codex", "pi")}
