"""The index on disk: session, message and postings tables that follow the log files.

All tables are partitioned by a hash of the file's path, so a refresh writes
only the buckets whose files changed, by Spark's dynamic partition overwrite;
a bucket is replaced as a whole or not at all. The session table, which holds
the times and sizes that tell what changed, is written last: after a failure
before that, the next refresh finds the same files changed and writes their
buckets again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups, search, session_index
from . import log_source, logs, shared

#: Changes whenever the tables do; other layouts are ignored.
LAYOUT = "layout-2"
#: In the order in which they are written.
TABLES = ("postings", "messages", "runs")
#: Buckets of the tables. A refresh rewrites a bucket for each changed file at most.
BUCKETS = 64


@dataclass
class Index:
    runs: DataFrame
    messages: DataFrame
    postings: DataFrame


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/{LAYOUT}-{buckets}"
        self.buckets = buckets

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def current(self) -> Index | None:
        """The tables as they are; None if there are none or they are damaged."""
        try:
            tables = {name: self._table(name) for name in TABLES}
            tables["runs"].select("file_path").limit(1).count()
        except (PySparkException, Py4JJavaError):
            return None
        return Index(**{name: df.where("file_path is not null").drop("bucket") for name, df in tables.items()})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Replaces these buckets. Each gets a row without a path too, so that one whose rows are all gone is replaced as well."""
        blank = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        marks = blank.withColumn("bucket", F.explode(F.array(*map(F.lit, buckets))))
        every = rows.withColumn("bucket", self._bucket()).unionByName(marks).repartition("bucket")
        order = ["bucket", "term"] if name == "postings" else ["bucket", "file_path"]
        every.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def manifest(self, roots: dict[str, str]) -> DataFrame:
        """(tool, file_path, mtime, size) of all session files, without reading them."""
        log_source.register(self.spark)
        out = None
        for tool, root in roots.items():
            found = self.spark.read.format("agent_log_files").options(tool=tool, pattern=logs.LAYOUTS[tool]).load(root)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], log_source.FILES) if out is None else out

    def _tables(self, lines: DataFrame, helpers: DataFrame | None) -> dict[str, DataFrame]:
        found = session_index.session_rows(lines, helpers)
        texts = found.select("file_path", "text.*")
        return {"runs": found, "messages": session_index.messages(lines).join(found.select("file_path"), "file_path", "left_semi"), "postings": search.postings(texts, "file_path").withColumnRenamed("key", "file_path")}

    def refresh(self, roots: dict[str, str]) -> Index:
        """Brings the index up to date: only files that are new or whose time or size changed are read, only their buckets are written.

        What the driver holds is the listing, as with any files, and the
        numbers of changed buckets. A changed file that no longer names a
        folder keeps its earlier row, with its new time and size; rows of files that are gone are dropped.
        """
        now = self.current()
        helpers = logs.subagent_lines(self.spark, roots["claude"]) if "claude" in roots else None
        if now is None:
            self.clear()
            for name, df in self._tables(logs.raw_lines(self.spark, roots), helpers).items():
                self._write(name, df, list(range(self.buckets)))
            return self.current()
        found = self.manifest(roots)
        at = shared.folder(self.spark, "changed")
        rollups.changed(found, now.runs).select("tool", "file_path").write.parquet(at)
        stale = self.spark.read.schema("tool string, file_path string").parquet(at)
        if not stale.limit(1).count() and not rollups.removed(now.runs.select("file_path"), found).limit(1).count():
            return now
        lines = [logs.of_list(self.spark, f"{at}/{tool}", stale.where(F.col("tool") == tool), tool) for tool in sorted(roots)]
        fresh = self._tables(reduce(DataFrame.unionByName, lines), helpers)
        renewed, gone = fresh["runs"].select("file_path"), rollups.removed(now.runs.select("file_path"), found).select("file_path")
        seen = stale.select("file_path").join(now.runs.select("file_path"), "file_path", "left_semi")
        touched = sorted(r[0] for r in renewed.unionByName(gone).unionByName(seen).select(self._bucket()).distinct().toLocalIterator())
        for name in TABLES if touched else ():
            old = self._table(name).where(F.col("bucket").isin(*touched) & F.col("file_path").isNotNull()).drop("bucket")
            kept = old.join(renewed, "file_path", "left_anti").join(found.select("file_path", F.col("mtime").alias("mtime_now"), F.col("size").alias("size_now")), "file_path")
            if name == "runs":  # as it is seen now, so that a file without a folder isn't read again until it changes
                kept = kept.withColumns({"mtime": F.col("mtime_now"), "size": F.col("size_now")})
            self._write(name, kept.drop("mtime_now", "size_now").unionByName(fresh[name]), touched)
        return self.current()
