"""Days as a report has them, one row each with breakdowns in maps, so that days of earlier reports merge with fresh ones.

What an earlier report counted can't be counted again without its events.
Projects that are no longer wanted are taken out of its days by folds over
the maps, and all totals of the new report are made from the merged days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import MONEY, round2
from . import usage_cube

#: Names in a report of what the cube calls otherwise.
PUBLIC = {"cost_usd": "costUSD", "session_count": "sessionCount", "model": "id"}
#: Where a day keeps each breakdown.
FIELDS = {"tool": "byTool", "provider": "byProvider", "model": "byModel", "project": "byProject"}
_TYPES = {"cost_usd": "double"}


def _fields(names: tuple[str, ...]) -> str:
    return ",".join(f"{PUBLIC.get(n, n)}:{_TYPES.get(n, 'bigint')}" for n in names)


def _slot_type(slot: str) -> str:
    keys, measures = usage_cube.SLOTS[slot]
    if len(keys) == 1:
        return f"map<string,struct<{_fields(measures)}>>"
    return f"array<struct<{','.join(f'{PUBLIC.get(k, k)}:string' for k in keys)},{_fields(measures)}>>"


SLOT_TYPES = {s: _slot_type(s) for s in usage_cube.SLOTS}
DAY = f"date:string,{_fields(usage_cube.ALL)},hourCounts:array<bigint>," + ",".join(f"{FIELDS[s]}:{t}" for s, t in SLOT_TYPES.items())
#: What is read of a report.
REPORT = f"generatedAt string, daily array<struct<{DAY}>>, weeklyHighlights array<struct<weekEnding:string,summary:string>>"


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Days, and (week_ending, summary), of the report at ``path`` or of all in that folder; where several have a day or week, the latest report's counts.

    A summary that is null or empty tells nothing. What a day lacks is empty or 0.
    """
    found = spark.read.schema(REPORT).option("multiLine", True).json(path)
    days = found.select("generatedAt", F.explode("daily").alias("day")).where("day.date is not null")
    days = days.groupBy("day.date").agg(F.max_by("day", F.coalesce("generatedAt", F.lit(""))).alias("day")).select("day.*")
    told = found.select("generatedAt", F.inline("weeklyHighlights")).where("weekEnding is not null and summary <> ''")
    told = told.groupBy(F.col("weekEnding").alias("week_ending")).agg(F.max_by("summary", F.coalesce("generatedAt", F.lit(""))).alias("summary"))
    return whole(days), told


def whole(days: DataFrame) -> DataFrame:
    """Days without nulls: missing numbers are 0, missing breakdowns empty."""
    empty = {FIELDS[s]: F.from_json(F.lit("[]" if t.startswith("array") else "{}"), t) for s, t in SLOT_TYPES.items()}
    columns = {PUBLIC.get(n, n): F.coalesce(PUBLIC.get(n, n), F.lit(0).cast(_TYPES.get(n, "bigint"))) for n in usage_cube.ALL}
    columns |= {c: F.coalesce(c, e) for c, e in empty.items()}
    return days.withColumns(columns | {"hourCounts": F.coalesce("hourCounts", F.array_repeat(F.lit(0).cast("long"), 24))})


def fresh_days(base: DataFrame) -> DataFrame:
    """Facts as days in the same shape; a key that is null is called unknown. A day holds its own keys, as its row of a report does."""
    base = base.fillna("unknown", list(usage_cube.MODEL_KEY) + ["project"])
    days = usage_cube.daily(base).join(usage_cube.daily_hours(base).withColumnRenamed("hour_counts", "hourCounts"), "date")
    for slot, (keys, measures) in usage_cube.SLOTS.items():
        values = [F.coalesce(m, F.lit(0)).alias(PUBLIC.get(m, m)) for m in measures]
        if len(keys) == 1:
            entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(slot), F.struct(*values)))))
        else:
            listed = F.array_sort(F.collect_list(F.struct((-F.col("cost_usd")).alias("order"), *[F.col(k).alias(PUBLIC.get(k, k)) for k in keys], *values)))
            entries = F.transform(listed, lambda x: x.dropFields("order"))
        days = days.join(usage_cube.daily_by(base, slot).groupBy("date").agg(entries.alias(FIELDS[slot])), "date")
    return days.withColumnsRenamed({k: v for k, v in PUBLIC.items() if k in usage_cube.ALL})


def without_projects(days: DataFrame, kept: Callable[[Column], Column]) -> DataFrame:
    """Days less what projects that ``kept`` refuses contributed: tokens, cost and runs; messages, hours and other breakdowns stay."""
    gone = F.map_values(F.map_filter("byProject", lambda k, _: ~kept(k)))

    def total(name: str, kind: str) -> Column:
        return F.aggregate(gone, F.lit(0).cast(kind), lambda so_far, x: (so_far + F.coalesce(x[name], F.lit(0)).cast(kind)).cast(kind))

    return days.withColumns({
        "tokens": F.col("tokens") - total("tokens", "bigint"),
        "costUSD": round2(F.col("costUSD").cast(MONEY) - total("costUSD", MONEY)),
        "sessionCount": F.col("sessionCount") - total("sessionCount", "bigint"),
        "byProject": F.map_filter("byProject", lambda k, _: kept(k)),
    })


def _cube_names(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({v: k for k, v in PUBLIC.items()})


def totals(days: DataFrame) -> DataFrame:
    """The rows of ``usage_cube.daily``."""
    return _cube_names(days).select("date", *usage_cube.ALL)


def unfolded(days: DataFrame, slot: str) -> DataFrame:
    """The rows of ``usage_cube.daily_by``; measures that a breakdown lacks are 0."""
    keys, measures = usage_cube.SLOTS[slot]
    if len(keys) > 1:
        rows = days.select("date", F.inline(FIELDS[slot]))
    else:
        rows = days.select("date", F.explode(FIELDS[slot]).alias(slot, "m")).select("date", slot, "m.*")
    return _cube_names(rows).select("date", *keys, *measures).fillna(0, list(measures))


def hours(days: DataFrame) -> DataFrame:
    """(hour, messages) of every day, for ``usage_cube.hour_histogram``."""
    return days.select(F.posexplode("hourCounts").alias("hour", "messages")).where("hour < 24")
