"""Live variants: new log files as a stream, and daily counts that late events still reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import MONEY, local_date, total_tokens
from ..sources import log_source, logs


def followed(spark: SparkSession, root: str, tool: str, pattern: str = "**") -> DataFrame:
    """A stream of lines of log files that appear below ``root`` or grow: (tool, file_path, file_size, mtime, n_lines, line_no, v).

    Each line comes once, when its line feed is there; a batch's lines of a
    file are numbered from where the batch begins to read it, by the byte at
    which their range begins, so they are in order but not dense.
    ``file_size`` is what had been read of the file by the end of the batch.
    """
    log_source.register(spark)
    found = spark.readStream.format("agent_logs").options(tool=tool, pattern=pattern).load(root)
    numbered = found.select("tool", "file_path", "file_size", "mtime", F.lit(0).alias("n_lines"), (F.col("block") + F.col("k")).alias("line_no"), "line")
    return logs.parsed(numbered)


def live_daily(events: DataFrame, tz: str, lateness: str = "2 days") -> DataFrame:
    """Running (date, tool, tokens, cost_usd, messages) over a stream of usage events; a day is closed once ``lateness`` has passed."""
    day = F.window("ts", "1 day")
    rows = events.withWatermark("ts", lateness).withColumns({"date": local_date(F.col("ts"), tz), "tokens": total_tokens()})
    grouped = rows.groupBy(day.alias("span"), "date", "tool").agg(F.sum("tokens").alias("tokens"), F.sum(F.coalesce("cost_usd", F.lit(0)).cast(MONEY)).alias("cost"), F.count(F.lit(1)).alias("messages"))
    return grouped.select("date", "tool", "tokens", F.col("cost").cast("double").alias("cost_usd"), "messages")


def into(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, once: bool = True):
    """Hands every micro-batch to ``handle``; with ``once`` what is there is read and the query ends."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
