"""Usage cube: from priced events to days, breakdowns, streaks and weeks.

Usage events have tool, provider, model, ts, session_id, project, input,
output, cache_read, cache_write, cache_write_1h (longs) and cost_usd. One
shuffle brings them to facts, one row for each session, day, hour and key;
everything else works on facts or on days, which are few. Costs add up as
decimals, so sums don't depend on their order, and are rounded once a day and
again in totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import MONEY, local_date, local_hour, round2, total_tokens, week_ending

#: Names that reports show.
TOOL_LABELS = {"claude-code": "Claude Code", "pi": "Pi", "codex": "Codex"}
PROVIDER_LABELS = {"anthropic": "Anthropic", "openai": "OpenAI", "baseten": "Baseten"}
MODEL_KEY = ("tool", "provider", "model")


def facts(events: DataFrame, tz: str, *more: Column) -> DataFrame:
    """(date, hour, tool, provider, model, project, session_id, tokens, cost, messages) and ``more`` aggregates; events without a time are left out."""
    local = events.where(F.col("ts").isNotNull()).withColumns({"date": local_date(F.col("ts"), tz), "hour": local_hour(F.col("ts"), tz), "tokens": total_tokens()})
    return local.groupBy("date", "hour", "tool", "provider", "model", "project", "session_id").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.coalesce("cost_usd", F.lit(0)).cast(MONEY)).alias("cost"), F.count(F.lit(1)).alias("messages"), *more
    )


def _measures(*names: str) -> list[Column]:
    every = {
        "tokens": F.sum("tokens").cast("long").alias("tokens"),
        "cost_usd": round2(F.sum("cost")).alias("cost_usd"),
        "session_count": F.count_distinct("tool", "session_id").alias("session_count"),
        "messages": F.sum("messages").cast("long").alias("messages"),
    }
    return [every[n] for n in names]


ALL = ("tokens", "cost_usd", "session_count", "messages")
#: Keys of each breakdown and what it measures.
SLOTS = {
    "tool": (("tool",), ALL),
    "provider": (("provider",), ("tokens", "cost_usd")),
    "model": (MODEL_KEY, ALL),
    "project": (("project",), ("tokens", "cost_usd", "session_count")),
}


def daily(base: DataFrame) -> DataFrame:
    """(date, tokens, cost_usd, session_count, messages)."""
    return base.groupBy("date").agg(*_measures(*ALL))


def daily_by(base: DataFrame, slot: str) -> DataFrame:
    keys, measures = SLOTS[slot]
    return base.groupBy("date", *keys).agg(*_measures(*measures))


def daily_hours(base: DataFrame) -> DataFrame:
    """(date, hour_counts): 24 message counts of each day."""
    counts = base.groupBy("date").agg(*[F.sum(F.when(F.col("hour") == h, F.col("messages")).otherwise(0)).cast("long").alias(f"h{h}") for h in range(24)])
    return counts.select("date", F.array(*[f"h{h}" for h in range(24)]).alias("hour_counts"))


def grouped_by_sets(rows: DataFrame, measures: list[Column], more: tuple[str, ...] = ()) -> DataFrame:
    """(slot, date, tool, provider, model, project, more, measures): ``rows`` by day and by day and each slot's keys; ``more`` columns are in every set."""
    sets = [["date"], ["date", "tool"], ["date", "provider"], ["date", "tool", "provider", "model"], ["date", "project"]]
    keys = ["date", "tool", "provider", "model", "project"]
    grouped = rows.groupingSets([[F.col(c) for c in (*more, *s)] for s in sets], *map(F.col, (*more, *keys))).agg(F.grouping_id().alias("gid"), *measures)
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): name for s, name in zip(sets, ("day", "tool", "provider", "model", "project"), strict=True)}
    slot = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return grouped.withColumn("slot", F.element_at(slot, F.col("gid").cast("int"))).drop("gid")


def grouping_sets(base: DataFrame) -> DataFrame:
    """All daily groupings in one pass over the facts: (slot, date, tool, provider, model, project, measures)."""
    return grouped_by_sets(base, _measures(*ALL))


def breakdown(days: DataFrame, slot: str) -> DataFrame:
    """Totals over ``daily_by`` rows: costs add up as rounded a day and are rounded again, runs count once a day."""
    keys, measures = SLOTS[slot]
    sums = {"tokens": F.sum("tokens").cast("long"), "cost_usd": round2(F.sum(F.col("cost_usd").cast(MONEY))), "session_count": F.sum("session_count").cast("long"), "messages": F.sum("messages").cast("long")}
    out = days.groupBy(*keys).agg(*[sums[m].alias(m) for m in measures])
    if slot in ("tool", "provider"):
        labels = TOOL_LABELS if slot == "tool" else PROVIDER_LABELS
        known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        out = out.withColumn("label", F.coalesce(F.try_element_at(known, F.col(slot)), F.col(slot)))
    return out


def hour_histogram(base: DataFrame) -> DataFrame:
    """24 rows (hour, messages) of facts or other rows with both."""
    bins = base.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return bins.join(F.broadcast(base.groupBy("hour").agg(F.sum("messages").alias("n"))), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("messages"))


def weekday_histogram(days: DataFrame) -> DataFrame:
    """Seven rows (weekday, messages), 0 for Sunday."""
    bins = days.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    counts = days.groupBy((F.dayofweek(F.col("date").cast("date")) - 1).alias("weekday")).agg(F.sum("messages").alias("n"))
    return bins.join(F.broadcast(counts), "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).cast("long").alias("messages"))


def weekly(days: DataFrame) -> DataFrame:
    """(week_ending, tokens, cost_usd, session_count, messages) of every week from the first active one to the last, empty ones too."""
    weeks = days.groupBy(week_ending(F.col("date")).alias("week")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("cost_usd").cast(MONEY)).alias("cost"), F.sum("session_count").alias("session_count"), F.sum("messages").alias("messages"))
    span = weeks.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a is not null")
    dense = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    joined = dense.join(weeks, "week", "left")
    zero = F.lit(0)
    return joined.select(
        F.date_format("week", "yyyy-MM-dd").alias("week_ending"), F.coalesce("tokens", zero).cast("long").alias("tokens"), round2(F.coalesce("cost", zero.cast(MONEY))).alias("cost_usd"),
        F.coalesce("session_count", zero).cast("long").alias("session_count"), F.coalesce("messages", zero).cast("long").alias("messages"),
    )


def weekly_by_tool(days_by_tool: DataFrame) -> DataFrame:
    """(week_ending, tool, tokens, cost_usd) of active weeks."""
    return days_by_tool.groupBy(F.date_format(week_ending(F.col("date")), "yyyy-MM-dd").alias("week_ending"), "tool").agg(F.sum("tokens").cast("long").alias("tokens"), round2(F.sum(F.col("cost_usd").cast(MONEY))).alias("cost_usd"))


def streaks(days: DataFrame, today: str) -> DataFrame:
    """One row (current_streak, longest_streak): runs of consecutive dates; the current one counts only if today is active.

    Dates are at most a few thousand, whatever the number of events.
    """
    dates = days.select(F.col("date").cast("date").alias("d")).distinct()
    runs = dates.withColumn("run", F.date_sub("d", F.row_number().over(Window.orderBy("d")))).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"), F.min("d").alias("first"))
    day = F.lit(today).cast("date")
    now = F.max(F.when((F.col("first") <= day) & (F.col("last") >= day), F.datediff(day, F.col("first")) + 1))
    return runs.agg(F.coalesce(now, F.lit(0)).cast("long").alias("current_streak"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("longest_streak"))


def peak_hour(hours: DataFrame) -> DataFrame:
    """One row (peak_hour): the hour with most messages, the smallest of equals, 0 if there are none."""
    return hours.agg(F.coalesce(F.min_by("hour", F.struct((-F.col("messages")).alias("m"), F.col("hour"))), F.lit(0)).cast("int").alias("peak_hour"))


#: What a report names as favourite when there are no events.
NO_MODEL = {"tool": "claude-code", "provider": "anthropic", "model": "unknown"}


def favourite_model(models: DataFrame) -> DataFrame:
    """One row (favourite_tool, favourite_provider, favourite_model): most messages, then the smallest key."""
    key = F.concat_ws("|", *MODEL_KEY)
    best = models.agg(F.min_by(F.struct(*MODEL_KEY), F.struct((-F.col("messages")).alias("m"), key.alias("k"))).alias("m"))
    return best.select(*[F.coalesce(F.col(f"m.{c}"), F.lit(d)).alias(f"favourite_{c}") for c, d in NO_MODEL.items()])


def summary(base: DataFrame, today: str) -> DataFrame:
    """One row: total_tokens, total_cost_usd, session_count, messages, active_days, streaks, peak hour, favourite model."""
    return summary_of(daily(base), daily_by(base, "model"), base, today)


def summary_of(days: DataFrame, models: DataFrame, hours: DataFrame, today: str) -> DataFrame:
    """The summary of days, of their models and of (hour, messages) rows."""
    zero = F.lit(0)
    totals = days.agg(
        F.coalesce(F.sum("tokens"), zero).cast("long").alias("total_tokens"), round2(F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), zero.cast(MONEY))).alias("total_cost_usd"),
        F.coalesce(F.sum("session_count"), zero).cast("long").alias("session_count"), F.coalesce(F.sum("messages"), zero).cast("long").alias("messages"), F.count_distinct("date").alias("active_days"),
    )
    # each side is one row
    return totals.crossJoin(streaks(days, today)).crossJoin(peak_hour(hour_histogram(hours))).crossJoin(favourite_model(breakdown(models, "model")))


def within(events: DataFrame, tz: str, start: str | None, end: str | None) -> DataFrame:
    """Events whose local date is in [start, end]; an end that is None is open."""
    day = local_date(F.col("ts"), tz)
    keep = F.col("ts").isNotNull()
    keep = keep & (day >= start) if start else keep
    return events.where(keep & (day <= end) if end else keep)


def merge_daily(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Days of both; where both have one, the fresh one."""
    return prior.join(fresh.select("date"), "date", "left_anti").unionByName(fresh)


def weekly_pull_requests(weeks: DataFrame, prs: DataFrame, tz: str) -> DataFrame:
    """Adds prs_merged, additions and deletions to weeks that are there; ``prs``: state, merged_at, additions, deletions."""
    merged = prs.where("state = 'merged' and merged_at is not null")
    counted = merged.groupBy(F.date_format(week_ending(local_date(F.col("merged_at"), tz)), "yyyy-MM-dd").alias("week_ending")).agg(F.count(F.lit(1)).alias("prs_merged"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return weeks.join(counted, "week_ending", "left").fillna(0, ["prs_merged", "additions", "deletions"])


def weekly_highlights(prs: DataFrame, prior: DataFrame, tz: str, start: str) -> DataFrame:
    """(week_ending, pull_requests, summary): requests of a week by churn, newest week first, earlier summaries carried over.

    ``prs`` also has url, title and created_at; a request that isn't merged counts where it was created.
    """
    week = F.date_format(week_ending(local_date(F.coalesce("merged_at", "created_at"), tz)), "yyyy-MM-dd")
    entry = F.struct((-(F.col("additions") + F.col("deletions"))).alias("churn"), "url", "title", "state", "additions", "deletions")
    grouped = prs.groupBy(week.alias("week_ending")).agg(F.array_sort(F.collect_list(entry)).alias("pull_requests")).where(F.col("week_ending") >= start)
    told = prior.where("summary <> ''").select("week_ending", "summary")
    return grouped.join(told, "week_ending", "left").orderBy(F.desc("week_ending"))
