"""A corpus pipeline of five stages, each by one of the operators in ``loglattice.llm``.

Every stage reads what its predecessor kept from Parquet. All but the last
return the columns of documents, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglattice.llm import stages
from loglattice.llm.common import Workspace, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", stages.keep_good),
    ("exact dedup", stages.drop_copies),
    ("near dedup", stages.drop_near_copies),
    ("mix sources", stages.mix_sources),
    ("pack", stages.pack),
]

#: Near-duplicate links and token ids are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again, and its working tables are deleted."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        known = list(Workspace.opened)
        before, docs = docs, work.put(stage(spark, docs, sf_dir))
        work.drop(before)
        for used in [w for w in Workspace.opened if w not in known]:
            used.clear()
    return STAGES[-1][1](spark, docs, sf_dir)
