"""Scalar expressions: money, local time, weeks, scores."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,12)"


def round2(x: Column) -> Column:
    """Two decimals, halves towards plus infinity, on the double itself (``round`` would go through decimal text)."""
    return F.floor(x.cast("double") * 100 + 0.5) / 100.0


def local_time(ts: Column, tz: str) -> Column:
    """A UTC timestamp as wall-clock time of ``tz``, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_date(ts: Column, tz: str) -> Column:
    return F.date_format(local_time(ts, tz), "yyyy-MM-dd")


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(local_time(ts, tz))


def week_ending(day: Column) -> Column:
    """The Sunday on or after a date."""
    d = day.cast("date")
    return F.date_add(d, F.pmod(8 - F.dayofweek(d), F.lit(7)))


def total_tokens() -> Column:
    """Reads from the cache don't count."""
    return F.col("input") + F.col("output") + F.col("cache_write")


def artifact(text: Column) -> Column:
    """A pull or merge request's address, or a commit hash in back quotes or brackets."""
    return text.rlike(r"(?i)/(pull|merge_requests)/\d+") | text.rlike(r"(?i)`[0-9a-f]{7,40}`|\([0-9a-f]{7,40}\)")


def significance(messages: Column, files: Column, has_artifact: Column) -> Column:
    return F.log2(messages.cast("double") + 1) + 0.5 * F.least(files, F.lit(10)) + F.when(has_artifact, 2.0).otherwise(0.0)


def blended(score: Column, day: Column, now: str) -> Column:
    """A score that halves with each week of age; a date that can't be read is a century old."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.try_to_timestamp(day).cast("double")) / 86400.0
    return score * F.pow(F.lit(0.5), F.greatest(F.coalesce(age, F.lit(36500.0)), F.lit(0.0)) / 7.0)


def trivia(messages: Column, files: Column, has_artifact: Column) -> Column:
    return (messages <= 2) & (files == 0) & ~has_artifact


def under(path: Column, root: str) -> Column:
    """``path`` is ``root`` or lies below it; a sibling whose name only starts alike does not."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def resolve_project(cwd: Column) -> Column:
    """The repository below a developer folder, else the last name of the path, else ``unknown``."""
    trimmed = F.regexp_replace(cwd, r"/+$", "")
    found = F.regexp_extract(cwd, r"^/[^/]+/[^/]+/Developer/([^/]+)", 1)
    base = F.substring_index(trimmed, "/", -1)
    return F.when(found != "", found).when(F.coalesce(base, F.lit("")) != "", base).otherwise("unknown")


def allowed(project: Column, include: tuple[str, ...] = (), include_prefixes: tuple[str, ...] = (), exclude: tuple[str, ...] = (), exclude_prefixes: tuple[str, ...] = ()) -> Column:
    """Kept: whatever the include lists name (all, if both are empty) and the exclude lists don't."""

    def named(exact: tuple[str, ...], prefixes: tuple[str, ...]) -> Column:
        hit = project.isin(*exact) if exact else F.lit(False)
        for p in prefixes:
            hit = hit | project.startswith(p)
        return hit

    wanted = named(include, include_prefixes) if include or include_prefixes else F.lit(True)
    return wanted & ~named(exclude, exclude_prefixes)


def period(preset: str, today: date) -> tuple[str, str]:
    """First and last day (inclusive) of a named period; ``YYYY-MM`` names a month."""
    first = today.replace(day=1)
    if preset == "today":
        span = today, today
    elif preset == "this-week":
        span = today - timedelta(days=today.weekday()), today
    elif preset == "this-month":
        span = first, today
    elif preset == "last-month":
        end = first - timedelta(days=1)
        span = end.replace(day=1), end
    elif preset == "this-year":
        span = today.replace(month=1, day=1), today
    else:
        parts = preset.split("-")
        if len(parts) != 2 or not all(p.isdigit() for p in parts) or len(parts[0]) != 4 or len(parts[1]) != 2 or not 1 <= int(parts[1]) <= 12:
            raise ValueError(f"not a period: {preset!r}")
        start = date(int(parts[0]), int(parts[1]), 1)
        span = start, (start + timedelta(days=31)).replace(day=1) - timedelta(days=1)
    return span[0].isoformat(), span[1].isoformat()


def days_ago(today: date, days: int) -> str:
    """The first day of the last ``days`` days, today included."""
    return (today - timedelta(days=days - 1)).isoformat()


def chosen_period(today: date, preset: str | None = None, days: int | None = None, start: str | None = None, end: str | None = None) -> tuple[str | None, str | None]:
    """A preset comes before a number of days, and that before explicit ends."""
    if preset:
        return period(preset, today)
    if days:
        return days_ago(today, days), today.isoformat()
    return start, end


def relative_day(day: Column, today: str) -> Column:
    """today, yesterday, days up to a week, weeks up to a month, else the date itself."""
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date(day))
    return (
        F.when(age.isNull(), day)
        .when(age <= 0, "today")
        .when(age == 1, "yesterday")
        .when(age < 7, F.concat(age.cast("string"), F.lit("d")))
        .when(age < 30, F.concat(F.floor(age / 7).cast("string"), F.lit("w")))
        .otherwise(day)
    )
