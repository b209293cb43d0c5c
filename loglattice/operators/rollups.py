"""Roll-ups over the session table: lists, digests, metrics, the context primer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, shortened
from ..functions.values import artifact, blended, significance, trivia, under
from . import session_index

TOPICS, RECENT_FILES, DETAILS = 10, 5, 10
HEADLINES = 40
#: What each level of detail takes: (more messages than, user texts, characters); None takes no details.
DETAIL = {"compact": None, "highlights": (3, 2, 300), "full": (0, 20, 500)}


def scoped(runs: DataFrame, tool: str | None = None, project: str | None = None, errored: bool = False) -> DataFrame:
    if tool:
        runs = runs.where(F.col("tool") == tool)
    if project:
        runs = runs.where(under(F.col("cwd"), project))
    return runs.where("errored") if errored else runs


def recent(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("date"), "file_path").limit(limit)


def in_range(runs: DataFrame, start: str, end: str) -> DataFrame:
    """Dates are compared as text, so a session without one is never in range."""
    return runs.where((F.col("created_at") >= start) & (F.col("created_at") <= end))


def _ranked_list(rows: DataFrame, value: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` values of each day and project in ``order``; the limit is applied before the shuffle."""
    window = Window.partitionBy("created_at", "cwd").orderBy(*order)
    top = rows.withColumn("n", F.row_number().over(window)).where(F.col("n") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("x"))))
    return top.groupBy("created_at", "cwd").agg(F.transform(listed, lambda s: s["x"]).alias(value))


def digest(runs: DataFrame) -> DataFrame:
    """(created_at, cwd, runs, messages, tools, topics, file_paths): one row for each day and project.

    Tools and the first ten distinct topics are in order of their first
    session, file_paths are those of the last five. However many runs a
    day and project have, only these few are ever listed.
    """
    key = ["created_at", "cwd"]
    place = F.struct("date", "file_path")
    grouped = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("session_count"), F.sum("message_count").cast("long").alias("messages"))
    topic = F.when(F.col("custom_title") != "", F.col("custom_title")).otherwise(F.col("first_prompt"))
    topics = runs.withColumn("topics", topic).where("topics <> ''").groupBy(*key, "topics").agg(F.min(place).alias("o"))
    tools = runs.groupBy(*key, F.col("tool").alias("tools")).agg(F.min(place).alias("o"))
    last = runs.select(*key, F.col("file_path").alias("file_paths"), "date")
    last = _ranked_list(last, "file_paths", [F.desc("date"), F.desc("file_paths")], RECENT_FILES)
    empty = F.array().cast("array<string>")
    out = grouped.join(_ranked_list(tools, "tools", [F.asc("o")], TOPICS), key, "left").join(_ranked_list(topics, "topics", [F.asc("o")], TOPICS), key, "left").join(last, key, "left")
    return out.select(*key, "session_count", "messages", "tools", F.coalesce("topics", empty).alias("topics"), F.reverse("file_paths").alias("file_paths"))


def digest_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("session_count"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("messages"), F.count_distinct("cwd").alias("projects"))


def busiest(runs: DataFrame, more_than: int, limit: int = DETAILS) -> DataFrame:
    """The runs of each day and project with most messages, with their rank."""
    order = Window.partitionBy("created_at", "cwd").orderBy(F.desc("message_count"), "created_at", "date", "file_path")
    return runs.where(F.col("message_count") > more_than).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def digest_details(runs: DataFrame, messages: DataFrame, detail: str) -> DataFrame:
    """Top runs with their user messages: the first and the last one, or the first twenty, shortened."""
    more_than, texts, limit = DETAIL[detail]
    top = busiest(runs, more_than)
    said = messages.join(top.select("file_path"), "file_path", "left_semi").where("role = 'user'")
    entries = F.array_sort(F.collect_list(F.struct("index", "text")))
    grouped = said.groupBy("file_path").agg(entries.alias("said"))
    if detail == "highlights":
        picked = F.when(F.size("said") > 1, F.array(F.element_at("said", 1), F.element_at("said", -1))).otherwise(F.col("said"))
    else:
        picked = F.slice("said", 1, texts)
    told = grouped.select("file_path", F.transform(picked, lambda m: shortened(m["text"], limit)).alias("user_messages"))
    return top.join(told, "file_path", "left").withColumn("user_messages", F.coalesce("user_messages", F.array().cast("array<string>")))


def metrics(runs: DataFrame, *keys: Column | str) -> DataFrame:
    """(keys, runs, messages); without keys the totals."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("session_count"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("messages"))


def active_hours(runs: DataFrame) -> DataFrame:
    """(hour, runs) by the hour of a file's first line; files of one line have none."""
    return runs.where("first_hour is not null").groupBy(F.col("first_hour").alias("hour")).agg(F.count(F.lit(1)).alias("session_count"))


def scored(runs: DataFrame, now: str) -> DataFrame:
    """Adds score and trivial. A session without a start is as old as its last date."""
    files = F.size("files_touched")
    proof = artifact(F.concat_ws(" ", "closing_user", "closing_assistant"))
    day = F.when(F.col("created_at") == "?", F.col("date")).otherwise(F.col("created_at"))
    score = blended(significance(F.col("message_count"), files, proof), day, now)
    return runs.withColumns({"score": score, "trivial": trivia(F.col("message_count"), files, proof)})


def primer(runs: DataFrame, now: str, root: str | None = None, days: int | None = None, limit: int = 10, tool: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(recent, headlines): the most significant runs of a project in detail, and the newest of the rest by one line.

    Trivial runs are only detailed if there are no others. A session
    without a start passes the cutoff, as ``?`` sorts after digits. Only the
    top is ranked: ``limit`` rows and forty headlines, whatever the number of
    runs.
    """
    rows = scoped(runs, tool, root)
    if days:
        rows = rows.where(F.col("created_at") >= F.date_format(F.date_sub(F.lit(now).cast("timestamp").cast("date"), days), "yyyy-MM-dd"))
    rows = scored(rows, now)
    newest = [F.desc("created_at"), F.desc("date"), F.asc("file_path")]
    # the best of each kind; the trivial ones only serve where no other is found
    detailed = rows.orderBy("trivial", F.desc("score"), *newest).limit(limit)
    best = detailed.agg(F.bool_and("trivial").alias("only_trivial"))
    detailed = detailed.crossJoin(F.broadcast(best)).where("only_trivial or not trivial").drop("only_trivial")
    rest = rows.join(F.broadcast(detailed.select("file_path")), "file_path", "left_anti")
    return detailed.orderBy(F.desc("score"), *newest), rest.orderBy(*newest).limit(HEADLINES)


def removed(indexed: DataFrame, found: DataFrame) -> DataFrame:
    return indexed.join(found.select("file_path"), "file_path", "left_anti")


def changed(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differs."""
    return found.join(indexed.select("file_path", "mtime", "size"), ["file_path", "mtime", "size"], "left_anti")


def branch_label(cwd: Column, branches: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in branches.items() for x in pair]) if branches else None
    return F.coalesce(F.try_element_at(known, cwd), basename(cwd)) if known is not None else basename(cwd)


def scan(lines: DataFrame, query: str = "") -> DataFrame:
    """Runs straight from log lines, for when there is no index: those in which a genuine user text has the query, whatever its case; newest first."""
    found = session_index.session_rows(lines)
    if query:
        found = found.where(F.contains(F.lower("text.user_content"), F.lit(query.lower())))
    return found.orderBy(F.desc("date"), "file_path")
