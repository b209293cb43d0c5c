"""Registered queries: one for each operator that the test tables can show."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as a
from .functions import text, values
from .operators import pricing, prior_days, rollups, run_bitmaps, search, session_index, usage_cube, usage_events
from .sources import logs, shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_cube.facts(a.usage_events(spark, sf_dir), a.TZ)


@query
def usage_daily(spark, sf_dir):
    return usage_cube.daily(_facts(spark, sf_dir))


def _slot_queries(slot: str) -> None:
    def by_day(spark, sf_dir):
        return usage_cube.daily_by(_facts(spark, sf_dir), slot)

    def totals(spark, sf_dir):
        return usage_cube.breakdown(usage_cube.daily_by(_facts(spark, sf_dir), slot), slot)

    QUERIES[f"usage_daily_by_{slot}"] = by_day
    QUERIES[f"usage_by_{slot}"] = totals


for _slot in usage_cube.SLOTS:
    _slot_queries(_slot)


@query
def usage_grouping_sets(spark, sf_dir):
    return usage_cube.grouping_sets(_facts(spark, sf_dir))


@query
def usage_summary(spark, sf_dir):
    return usage_cube.summary(_facts(spark, sf_dir), a.TODAY)


@query
def usage_hour_hist(spark, sf_dir):
    return usage_cube.hour_histogram(_facts(spark, sf_dir))


@query
def usage_daily_hours(spark, sf_dir):
    """The 24 bins of each day as one row each."""
    return usage_cube.daily_hours(_facts(spark, sf_dir)).select("date", F.posexplode("hour_counts").alias("hour", "messages"))


@query
def usage_weekday_hist(spark, sf_dir):
    return usage_cube.weekday_histogram(usage_cube.daily(_facts(spark, sf_dir)))


@query
def usage_weekly_dense(spark, sf_dir):
    """Without the week of 14 January, to show that it is filled."""
    events = a.usage_events(spark, sf_dir).where(values.week_ending(values.local_time(F.col("ts"), a.TZ)) != F.lit("2024-01-14").cast("date"))
    return usage_cube.weekly(usage_cube.daily(usage_cube.facts(events, a.TZ)))


@query
def usage_weekly_by_tool(spark, sf_dir):
    return usage_cube.weekly_by_tool(usage_cube.daily_by(_facts(spark, sf_dir), "tool"))


@query
def usage_streaks(spark, sf_dir):
    """Without Wednesdays and the tenth of the month."""
    days = usage_cube.daily(_facts(spark, sf_dir)).where((F.dayofweek(F.col("date").cast("date")) != 4) & (F.col("date") != "2024-01-10"))
    return usage_cube.streaks(days, "2024-01-30")


@query
def usage_period_filter(spark, sf_dir):
    start, end = values.chosen_period(date(2024, 1, 20), preset="this-week")
    events = usage_cube.within(a.usage_events(spark, sf_dir), "Asia/Tokyo", start, end)
    return usage_cube.daily(usage_cube.facts(events, "Asia/Tokyo"))


@query
def usage_allow_deny(spark, sf_dir):
    events = a.usage_events(spark, sf_dir).where(values.allowed(F.col("project"), ("proj1", "proj2"), ("proj3", "proj4"), ("proj2",), ("proj4",)))
    return usage_cube.breakdown(usage_cube.daily_by(usage_cube.facts(events, a.TZ), "project"), "project")


@query
def usage_prior_merge(spark, sf_dir):
    """Days up to the 20th come from the JSON of an earlier report, without project proj0; days from the 15th on are fresh."""
    base, at = _facts(spark, sf_dir), shared.folder(spark, "reports")
    days = prior_days.fresh_days(base.where(F.col("date") <= "2024-01-20"))
    days.agg(F.collect_list(F.struct(*days.columns)).alias("daily")).write.json(at)
    prior = prior_days.without_projects(prior_days.read_reports(spark, at)[0], lambda p: ~p.isin("proj0"))
    fresh = prior_days.fresh_days(base.where(F.col("date") >= "2024-01-15"))
    merged = usage_cube.merge_daily(prior.withColumn("src", F.lit("prior")), fresh.withColumn("src", F.lit("fresh")))
    return prior_days.totals(merged).join(merged.select("date", "src"), "date")


@query
def usage_prior_slots(spark, sf_dir):
    """Totals of every breakdown over days that went through a report's JSON and lost project proj0, whose tokens stay in the breakdowns by tool, provider and model."""
    base, at = _facts(spark, sf_dir), shared.folder(spark, "reports")
    days = prior_days.fresh_days(base)
    days.agg(F.collect_list(F.struct(*days.columns)).alias("daily")).write.json(at)
    kept = prior_days.without_projects(prior_days.read_reports(spark, at)[0], lambda p: ~p.isin("proj0"))
    out = None
    for slot, (keys, _) in usage_cube.SLOTS.items():
        rows = usage_cube.breakdown(prior_days.unfolded(kept, slot), slot).select(F.lit(slot).alias("slot"), F.concat_ws("|", *keys).alias("key"), "tokens", "cost_usd")
        out = rows if out is None else out.unionByName(rows)
    return out


def _stored_runs(spark, sf_dir):
    """Bitmaps of runs by two ingests: days up to the 20th, then days from the 15th on with the runs that are new; of days of both the later ingest counts."""
    base = _facts(spark, sf_dir)

    def stored(df: DataFrame, name: str) -> DataFrame:
        at = shared.folder(spark, name)
        df.write.parquet(at)
        return spark.read.parquet(at)

    old, new = base.where(F.col("date") <= "2024-01-20"), base.where(F.col("date") >= "2024-01-15")
    known = stored(run_bitmaps.numbered(old), "runs")
    more = stored(run_bitmaps.numbered(new, known), "runs")
    prior = stored(run_bitmaps.day_bitmaps(old, known), "days")
    fresh = stored(run_bitmaps.day_bitmaps(new, known.unionByName(more)), "days")
    return usage_cube.merge_daily(prior, fresh)


@query
def usage_bitmap_sets(spark, sf_dir):
    """All daily groupings from stored bitmaps of two ingests."""
    return run_bitmaps.grouping_sets(_stored_runs(spark, sf_dir))


@query
def usage_weekly_runs(spark, sf_dir):
    """Weeks by tool with the runs that are distinct in the whole week, from stored bitmaps of two ingests."""
    week = F.date_format(values.week_ending(F.col("date")), "yyyy-MM-dd").alias("week_ending")
    return run_bitmaps.grouped(_stored_runs(spark, sf_dir), week, "tool")


@query
def pricing_tiered_cost(spark, sf_dir):
    """Every line's cost: the recorded one, else by its part's price."""
    costed = pricing.with_cost(a.line_usage(spark, sf_dir), a.prices(spark, sf_dir))
    return costed.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.round("cost_usd", 9).alias("cost"))


@query
def pricing_fuzzy_match(spark, sf_dir):
    """Part types as logged model names against brands as price names."""
    parts = a.table(spark, sf_dir, "part")
    models = parts.select(F.concat(F.lit("eu/"), F.lower("p_brand"), F.lit("-2024"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit("01")).alias("model")).distinct()
    prices = parts.select(F.lower("p_brand").alias("key")).distinct()
    return pricing.resolve_models(models, prices)


@query
def pricing_name_index(spark, sf_dir):
    """Names of parts as logged models against longer, shorter and differently written price names: either may contain the other."""
    parts = a.table(spark, sf_dir, "part")
    brand, kind, name = F.lower("p_brand"), F.lower("p_type"), F.col("p_name")
    size, step = F.col("p_size").cast("string"), (F.col("p_size") % 9).cast("string")
    models = (F.concat("p_brand", F.lit("."), step), F.concat(F.lit("EU/"), F.translate(name, " ", "."), F.lit("@2024010"), step), F.concat_ws("/", kind, brand, size), F.split(name, " ")[0])
    keys = (F.translate(name, " ", "-"), F.concat(F.lit("x/"), brand, F.lit("@"), step), F.concat_ws("-", kind, F.split(brand, "#")[1]), F.concat("p_brand", F.lit("/"), size))

    def every(names: tuple, column: str) -> DataFrame:
        return parts.select(F.explode(F.array(*names)).alias(column)).distinct()

    return pricing.resolve_models(every(models, "model"), every(keys, "key"))


@query
def pricing_warnings(spark, sf_dir):
    """Unpriced events, where the largest parts have no price."""
    small = a.table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("key"))
    costed = pricing.with_cost(a.line_usage(spark, sf_dir), a.prices(spark, sf_dir).join(small, "key", "left_semi"))
    return pricing.warnings(costed).groupBy("model").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens").cast("long").alias("tokens"))


@query
def asof_forward_fill(spark, sf_dir):
    """The latest sign-up at or before each event of a user."""
    e = a.table(spark, sf_dir, "events")
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = e.withColumn("s", F.last(F.when(F.col("event_type") == "signup", F.struct("event_id", "value")), ignorenulls=True).over(so_far))
    return filled.where("s is not null").select("event_id", F.col("s.event_id").alias("signup_id"), F.col("s.value").alias("signup_value"))


@query
def dedup_first_seen(spark, sf_dir):
    """The first document of each text; those that combine before the shuffle are few."""
    docs = a.table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query
def usage_dedup_messages(spark, sf_dir):
    """Events of a user and kind within an hour share an id; those of odd users have none and all stay."""
    e = a.table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    named = e.where("user_id % 2 = 0")
    first = Window.partitionBy("user_id", "event_type", "hour").orderBy("ts", "event_id")
    once = named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return once.unionByName(e.where("user_id % 2 <> 0")).select("event_id")


def _conv_id():
    return F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).cast("long").alias("conv_id")


@query
def msgs_indexed(spark, sf_dir):
    return session_index.messages(a.conversation_lines(spark, sf_dir)).select(_conv_id(), "index", "role", "text")


@query
def msgs_page(spark, sf_dir):
    """The second and third message of every conversation."""
    shown = session_index.messages(a.conversation_lines(spark, sf_dir))
    return session_index.message_page(shown, None, 1, 2).select(_conv_id(), "index", "role")


def _folded(spark, sf_dir):
    return session_index.session_rows(a.conversation_lines(spark, sf_dir))


@query
def session_counts(spark, sf_dir):
    return _folded(spark, sf_dir).select(_conv_id(), "message_count")


@query
def session_first_prompt(spark, sf_dir):
    return _folded(spark, sf_dir).where("first_prompt <> ''").select(_conv_id(), F.col("first_prompt").alias("text"))


@query
def session_closing(spark, sf_dir):
    return _folded(spark, sf_dir).select(_conv_id(), "closing_user", "closing_assistant")


@query
def clean_text(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", text.clean(F.col("html")).alias("text"))


@query
def match_context(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", text.match_context(F.col("text"), "license").alias("snippet")).where("snippet is not null")


@query
def content_match(spark, sf_dir):
    """Conversations in which a user says a word, whatever its case."""
    hit = F.bool_or(F.contains(F.lower("text"), F.lit("the")) & (F.col("role") == "user"))
    return a.messages(spark, sf_dir).groupBy(F.col("file_path").alias("conv_id")).agg(hit.alias("hit")).where("hit").select("conv_id")


@query
def session_display(spark, sf_dir):
    s = a.session_rows(spark, sf_dir)
    shown = F.coalesce(F.nullif(F.col("custom_title"), F.lit("")), "first_prompt")
    return s.select("file_path", shown.alias("display_text"), text.basename(F.col("cwd")).alias("folder"), values.relative_day(F.col("date"), "1998-08-02").alias("age"), text.resume_command(F.when(F.col("tool") == "1-URGENT", "claude").otherwise("pi"), F.col("cwd"), F.col("file_path")).alias("resume"))


@query
def session_recent(spark, sf_dir):
    return rollups.recent(a.session_rows(spark, sf_dir)).select("file_path", "date", "cwd", "tool")


@query
def session_scoped(spark, sf_dir):
    found = rollups.scoped(a.session_rows(spark, sf_dir), tool="1-URGENT", project="/EUROPE", errored=True)
    return found.select("file_path", "created_at", "cwd", "tool")


@query
def session_range(spark, sf_dir):
    return rollups.in_range(a.session_rows(spark, sf_dir), "1995-01-01", "1995-01-31").select("file_path", "created_at", "cwd", "tool")


def _ranged(spark, sf_dir):
    return rollups.in_range(a.session_rows(spark, sf_dir), "1995-01-01", "1995-06-30")


@query
def digest_compact(spark, sf_dir):
    found = rollups.digest(_ranged(spark, sf_dir))
    return found.select("created_at", "cwd", "session_count", "messages", *[F.array_join(c, "|").alias(c) for c in ("tools", "topics", "file_paths")])


@query
def digest_details(spark, sf_dir):
    return rollups.busiest(_ranged(spark, sf_dir), 3).select("created_at", "cwd", "file_path", "message_count", "rank")


@query
def digest_totals(spark, sf_dir):
    return rollups.digest_totals(_ranged(spark, sf_dir))


@query
def metrics_totals(spark, sf_dir):
    return rollups.metrics(_ranged(spark, sf_dir))


@query
def metrics_tool(spark, sf_dir):
    return rollups.metrics(_ranged(spark, sf_dir), "tool")


@query
def metrics_project(spark, sf_dir):
    return rollups.metrics(_ranged(spark, sf_dir), "cwd")


@query
def metrics_daily(spark, sf_dir):
    return rollups.metrics(_ranged(spark, sf_dir), "created_at")


@query
def metrics_hours(spark, sf_dir):
    """The hour of each user's first event."""
    first = a.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("ts", F.struct("ts", "event_id")).alias("ts"))
    return rollups.active_hours(first.select(F.date_format("ts", "HH").alias("first_hour")))


def _primer(spark, sf_dir):
    return rollups.primer(a.session_rows(spark, sf_dir), a.NOW, root="/ASIA", days=900)


@query
def primer_recent(spark, sf_dir):
    return _primer(spark, sf_dir)[0].select("file_path", F.round("score", 6).alias("score"))


@query
def primer_headlines(spark, sf_dir):
    return _primer(spark, sf_dir)[1].select("file_path", "created_at")


@query
def session_scores(spark, sf_dir):
    scored = rollups.scored(a.session_rows(spark, sf_dir), a.NOW)
    return scored.select("file_path", F.round("score", 6).alias("score"), "trivial")


def _documents(spark, sf_dir):
    """Documents with their first line as headline and the source as path."""
    d = a.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("user_content"), F.col("source").alias("paths"))


TEXTS = ["headline", "user_content", "paths"]


def _hits(spark, sf_dir, words, stem):
    """Scores of documents by stored postings."""
    docs, at = _documents(spark, sf_dir), shared.folder(spark, "postings")
    search.postings(docs, "doc_id", TEXTS, stem).write.parquet(at)
    return search.bm25(spark.read.parquet(at), search.query_phrases(words, stem), documents=docs.select("doc_id"))


@query
def search_bm25(spark, sf_dir):
    """All documents that match; without stems, which SQL doesn't have."""
    found = _hits(spark, sf_dir, "licensed apache src3", False)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def search_stemmed_top(spark, sf_dir):
    """The best twenty, with stems and a phrase of two words."""
    found = _hits(spark, sf_dir, "licensing version-2 public", True)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(20)


@query
def search_snippets(spark, sf_dir):
    """The best twenty for a word with the piece of their text that shows it, made by executors."""
    words = search.query_phrases("licensed", False)
    best = _hits(spark, sf_dir, "licensed", False).select("key", F.round("score", 6).alias("score")).orderBy("score", "key").limit(20)
    docs = _documents(spark, sf_dir)
    shown = docs.join(F.broadcast(best), docs["doc_id"] == best["key"])
    return shown.select("doc_id", search.snippets(["user_content"], words, stem=False).alias("snippet"))


@query
def search_terms(spark, sf_dir):
    """Every word of plain letters in the documents, folded, with its stem and the documents that hold it."""
    docs = _documents(spark, sf_dir)
    words = search.postings(docs, "doc_id", ["user_content"], False).where("term rlike '^[a-z]+$'").groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    return words.select("term", search.stemmed("term").alias("stem"), "documents")


@query
def files_union(spark, sf_dir):
    """Words of a document's even lines, then of its odd ones, in order of first sight, as files touched and read are joined."""
    d = a.table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    even, odd = (F.flatten(F.transform(F.filter(lines, lambda x, i: i % 2 == k), lambda x: F.split(x, " "))) for k in (0, 1))
    return d.select("doc_id", F.array_join(F.array_distinct(F.concat(even, odd)), " ").alias("files"))


@query
def anti_removed(spark, sf_dir):
    docs, labels = a.table(spark, sf_dir, "documents"), a.table(spark, sf_dir, "labels")
    gone = rollups.removed(docs.select(F.col("doc_id").alias("file_path")), labels.select(F.col("doc_id").alias("file_path")))
    return gone.select(F.col("file_path").alias("doc_id"))


@query
def change_gate(spark, sf_dir):
    """Documents against an earlier index in which every seventh has another size."""
    found = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.col("lang").alias("mtime"), F.col("n_chars").alias("size"))
    indexed = found.withColumn("size", F.when(F.col("file_path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return rollups.changed(found, indexed).select(F.col("file_path").alias("doc_id"))


@query
def lines_to_session(spark, sf_dir):
    """Conversations written as log lines and read back through the session index."""
    found = session_index.session_rows(a.conversation_lines(spark, sf_dir))
    return found.select("session_id", "cwd", "created_at", "date", "first_prompt", "message_count", "closing_user", "error_count", F.array_join("commands", "|").alias("commands"))


@query
def lines_to_messages(spark, sf_dir):
    found = session_index.messages(a.conversation_lines(spark, sf_dir))
    return found.select(F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "index", "role", "text")


@query
def lines_to_usage(spark, sf_dir):
    """Events written as usage lines and read back: one for each message and request."""
    found = usage_events.claude_events(a.usage_lines(spark, sf_dir))
    return found.select("session_id", "model", "project", "input", "output", "cache_read", "cache_write", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def lines_asof_model(spark, sf_dir):
    """Events as token counts that take the latest session and model before them in their file."""
    found = usage_events.codex_events(a.token_lines(spark, sf_dir), block=16)
    return found.groupBy("session_id", "model", "project").agg(F.count(F.lit(1)).alias("events"), F.sum("input").cast("long").alias("input"), F.sum("cache_read").cast("long").alias("cache_read"))


@query
def lines_scan(spark, sf_dir):
    """Runs without an index in which a user says a word, newest first."""
    found = rollups.scan(a.conversation_lines(spark, sf_dir), "the")
    return found.select("session_id", "date", "message_count")


@query
def logs_sessions(spark, sf_dir):
    """Conversations as log files of three tools, read through the log source into the session index."""
    roots = a.conversation_files(spark, sf_dir)
    found = session_index.session_rows(logs.raw_lines(spark, roots), logs.subagent_lines(spark, roots["claude"]))
    lists = [F.array_join(c, "|").alias(c) for c in ("files_touched", "files_read", "commands")]
    return found.select("tool", "session_id", "cwd", "branch", "first_prompt", "custom_title", "created_at", "date", "message_count", *lists, "errored", "error_count", "closing_user", "text.thinking", "text.context_text", F.md5(F.col("text.user_content")).alias("said"))


@query
def logs_lines(spark, sf_dir):
    """The number of every line of those files that is JSON, and its kind; files are read in small ranges."""
    found = logs.raw_lines(spark, a.conversation_files(spark, sf_dir), split_bytes=1 << 14)
    return found.select("tool", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "line_no", "n_lines", F.try_variant_get("v", "$.type", "string").alias("kind"))


@query
def logs_usage(spark, sf_dir):
    """Events as usage in log files of two tools, read through the log source; sessions and models are carried over blocks of 16 lines."""
    lines = logs.raw_lines(spark, a.event_files(spark, sf_dir), recursive=True)
    found = usage_events.codex_events(lines, block=16).unionByName(usage_events.pi_events(lines, block=16))
    sums = [F.sum(c).cast("long").alias(c) for c in ("input", "output", "cache_read")]
    return found.groupBy("tool", "provider", "model", "session_id", "project").agg(F.count(F.lit(1)).alias("events"), *sums, F.sum("cost_usd").alias("cost_usd"))


@query
def asof_blocks(spark, sf_dir):
    """The latest error of a kind of event before each of its events, filled in blocks: few keys, each with a large share of the rows."""
    e = a.table(spark, sf_dir, "events").withColumns({"place": F.col("event_id"), "known": F.when(F.col("value") > 90, F.col("event_id"))})
    filled = usage_events.forward_fill(e.select("event_type", "event_id", "place", "known"), {"latest": F.col("known")}, "event_type", "place", block=256)
    return filled.select("event_id", "event_type", "latest")
