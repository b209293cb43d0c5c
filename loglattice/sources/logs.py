"""Log files as lines: one row a line, its JSON as a VARIANT that is parsed once.

A line's number orders everything that is folded over a session; lines that are
no JSON are dropped. Files are read in ranges by ``log_source``; the numbers of
a file of several ranges are those in the range plus the lines of all ranges
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import log_source

LINES = "tool string, file_path string, file_size bigint, mtime timestamp, n_lines int, line_no int, v variant"
#: Where each tool keeps runs below its root: one folder deep, or at any depth.
LAYOUTS = {"claude": "*/*.jsonl", "pi": "**", "codex": "**"}
SUBAGENTS = "*/*/subagents/*.jsonl"


def _source(spark: SparkSession, kind: str, tool: str, root: str, **options: str) -> DataFrame:
    log_source.register(spark)
    return spark.read.format(kind).options(tool=tool, **options).load(*[root] if root else [])


def numbered(spark: SparkSession, tool: str, root: str = "", split_bytes: int = log_source.SPLIT_BYTES, **options: str) -> DataFrame:
    """(tool, file_path, file_size, mtime, n_lines, line_no, line) of every line below ``root``.

    Lines are numbered from 0; ``n_lines`` counts up to the last line with
    anything to see. Where no file is larger than a range, as nearly always,
    one scan of whole files is all. Larger files are cut: the lines of each of
    their ranges are counted where they are, and a sum over a file's ranges
    tells where each begins, so no file is read by one task.
    """
    columns = ("tool", "file_path", "file_size", "mtime")

    def whole(**more: str) -> DataFrame:
        rows = _source(spark, "agent_logs", tool, root, **options, **more)
        return rows.select(*columns, F.greatest(F.col("shown") + 1, F.lit(1)).alias("n_lines"), F.col("k").alias("line_no"), "line")

    if log_source.largest({"path": root, **options}) <= split_bytes:
        return whole(split_bytes="all")
    split = {"split_bytes": str(split_bytes)}
    counts = _source(spark, "agent_log_blocks", tool, root, sizes="many", **options, **split)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(F.when(F.col("shown") >= 0, F.col("first") + F.col("shown") + 1)).over(Window.partitionBy("file_path"))
    starts = counts.select("file_path", "block", "shown", before.alias("first")).select("file_path", "block", "first", F.coalesce(last, F.lit(1)).cast("int").alias("n_lines"))
    parts = _source(spark, "agent_logs", tool, root, sizes="many", **options, **split).join(starts, ["file_path", "block"])
    return whole(sizes="one", **split).unionByName(parts.select(*columns, "n_lines", (F.col("first") + F.col("k")).cast("int").alias("line_no"), "line"))


def parsed(rows: DataFrame) -> DataFrame:
    """Numbered lines as VARIANT. Blank lines and lines that don't parse are left out, but keep their number.

    Of equal keys the last counts, as in other readers: the session allows
    them from here on (``spark.sql.variant.allowDuplicateKeys``).
    """
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return rows.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line")).where("v is not null").drop("line")


def of_list(spark: SparkSession, at: str, paths: DataFrame, tool: str) -> DataFrame:
    """Lines of the files that a table names. The list is written to ``at``, where the source finds it."""
    paths.select("file_path").write.text(at)
    return parsed(numbered(spark, tool, listed_in=at))


def raw_lines(spark: SparkSession, roots: dict[str, str], recursive: bool = False, slugs: dict[str, str] | None = None, split_bytes: int = log_source.SPLIT_BYTES) -> DataFrame:
    """Lines of all tools in ``roots``; only the branches that are asked for are read.

    ``recursive`` finds files at any depth, so those of subagents too.
    ``slugs`` names how a tool's folders must start, so that others aren't
    listed; a session's own folder is still what a filter goes by.
    """
    out = spark.createDataFrame([], LINES)
    for tool, root in roots.items():
        pattern = "**" if recursive else LAYOUTS[tool]
        if pattern != "**" and slugs and tool in slugs:
            pattern = slugs[tool] + pattern
        out = out.unionByName(parsed(numbered(spark, tool, root, split_bytes, pattern=pattern)))
    return out


def subagent_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of subagents' files with their parent session's path as ``file_path``."""
    lines = parsed(numbered(spark, "claude", root, pattern=SUBAGENTS)).withColumn("sidecar", F.col("file_path"))
    return lines.withColumn("file_path", F.regexp_replace("file_path", r"/subagents/[^/]+\.jsonl$", ".jsonl"))
