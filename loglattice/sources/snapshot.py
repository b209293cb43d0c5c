"""Embedded prices: what a report uses when no price list is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pricing import RATES, SCHEMA, layered

#: Public list prices in dollars for a million tokens: input, output, cache write, cache read.
PER_MILLION = {
    "claude-opus-4": (15.0, 75.0, 18.75, 1.5),
    "claude-opus-4-1": (15.0, 75.0, 18.75, 1.5),
    "claude-opus-4-5": (5.0, 25.0, 6.25, 0.5),
    "claude-sonnet-4": (3.0, 15.0, 3.75, 0.3),
    "claude-sonnet-4-5": (3.0, 15.0, 3.75, 0.3),
    "claude-haiku-4-5": (1.0, 5.0, 1.25, 0.1),
    "claude-3-5-haiku": (0.8, 4.0, 1.0, 0.08),
    "gpt-5": (1.25, 10.0, None, 0.125),
    "gpt-5-mini": (0.25, 2.0, None, 0.025),
    "gpt-5-codex": (1.25, 10.0, None, 0.125),
    "gpt-4.1": (2.0, 8.0, None, 0.5),
    "o3": (2.0, 8.0, None, 0.5),
}

#: Rates of models that price lists tend to lag behind on, in the same order; they win over any list.
OVERRIDES = {
    "claude-opus-4-8": (5.0, 25.0, 6.25, 0.5),
    "claude-opus-4-7": (5.0, 25.0, 6.25, 0.5),
    "claude-opus-4-6": (5.0, 25.0, 6.25, 0.5),
    "claude-opus-4-5": (5.0, 25.0, 6.25, 0.5),
    "claude-opus-4": (15.0, 75.0, 18.75, 1.5),
    "claude-sonnet-4-6": (3.0, 15.0, 3.75, 0.3),
    "claude-haiku-4-5": (1.0, 5.0, 1.25, 0.1),
    "claude-fable-5": (10.0, 50.0, 12.5, 1.0),
    "gpt-5.5": (5.0, 30.0, 5.0, 0.5),
    "gpt-5.4": (2.5, 15.0, 2.5, 0.25),
}


def _prices(spark: SparkSession, listed: dict[str, tuple]) -> DataFrame:
    rows = [(k, *(None if x is None else x / 1e6 for x in p), *(None,) * (len(RATES) - 4)) for k, p in listed.items()]
    return spark.createDataFrame(rows, SCHEMA)


def embedded(spark: SparkSession, *lists: DataFrame) -> DataFrame:
    """The snapshot, ``lists`` that came at run time over it, and the overrides over both."""
    return layered(_prices(spark, PER_MILLION), *lists, _prices(spark, OVERRIDES))
