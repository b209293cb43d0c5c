"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document's ledger row holds its measurements
and one failure bit for each rule. A policy is a versioned mask of the rules it
enforces, so verdicts of any policy, and what each rule alone decides, come
from the stored bits without reading texts again; with the measurements, so do
other thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, text_or_empty

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails``: from measurements by name to a condition that is true where a document fails."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: A rule's place is its bit. New rules go to the end; places never change.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_lines") > 3) & (m("n_dup_lines") * 10 > m("n_lines") * 3)),
    Rule("word_length", lambda m: (m("n_words") > 0) & ((m("word_chars") > m("n_words") * 25) | (m("word_chars") < m("n_words") * 2))),
    Rule("shouting", lambda m: m("n_upper") > m("n_lower")),
    Rule("exclaimed", lambda m: m("n_exclaimed") * 4 > m("n_words")),
    Rule("no_words", lambda m: m("n_words") == 0),
)

#: Versioned policies: the names of the rules they enforce.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting", "exclaimed"),
    3: ("no_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting", "exclaimed"),
}
#: The policy whose rules' failures the base columns report.
BASE = 1


def mask(policy: int) -> int:
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[policy])


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more, the first occurrences included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) < 1 << 21:
        window = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # too many distinct words for 21 bits each
        pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
        window = pair[:-1] << 32 | ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaimed")


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    following = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    upper = len(text) - len(text.translate(None, bytes(range(ord("A"), ord("Z") + 1))))
    lower = len(text) - len(text.translate(None, bytes(range(ord("a"), ord("z") + 1))))
    spaces = len(text) - len(text.translate(None, SPACE))
    return (
        len(words),
        len(text) - following - spaces,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        upper,
        lower,
        text.count(b"!"),
    )


def ledger_row(text: str = "text") -> Column:
    """The measurements of a row's text as a struct, made beside the row; a null text is an empty one."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return measures(text_or_empty(text).cast("binary"))


def bits(measured: Callable[[str], Column]) -> Column:
    """Every rule evaluated once: its bit is set where the document fails."""
    each = (F.when(r.fails(measured), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES))
    return sum(each, F.lit(0).cast("long"))


def passes(failed: Column, policy: int) -> Column:
    """A policy's verdict on failure bits."""
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, measurements, failed bits) of every row, in one pass without a shuffle.

    A null text is an empty one. Rows that repeat and null keys give a row
    each; other columns are left aside; an empty table gives no row.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), ledger_row(text).alias("m")).select("doc_id", "m.*")
    return rows.withColumn("failed", bits(F.col))


def verdict(rows: DataFrame, policy: int = 2) -> DataFrame:
    """Adds ``kept`` under a policy to ledger rows."""
    return rows.withColumn("kept", passes(F.col("failed"), policy))


def ablations(rows: DataFrame, policy: int = 2) -> DataFrame:
    """(rule, enforced, failing, alone, without_it): documents that fail each rule, those that it alone rejects, and those kept without it.

    One aggregation by distinct bit pattern, of which there are at most
    2 ** len(RULES), however many documents; patterns are then compared by
    their bits.
    """
    enforced = mask(policy)
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES)])
    each = patterns.select("failed", "n", F.explode(names).alias("r")).select("failed", "n", "r.*")
    hit, own = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.lit(enforced))
    without = own.bitwiseAND(F.bitwise_not("bit")) == 0

    def among(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long").alias(name)

    counted = each.groupBy("rule", "bit").agg(among(hit, "failing"), among(own == F.col("bit"), "alone"), among(without, "without_it"))
    return counted.select("rule", (F.col("bit").bitwiseAND(F.lit(enforced)) != 0).alias("enforced"), "failing", "alone", "without_it")


def quality_rules(docs: DataFrame, policy: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ledger with ``base_failed``, ``kept``, ``policy`` and ``only_rule``; see ``ledger`` for odd rows.

    What fails a base rule is never kept, whatever the policy. ``only_rule``
    is the ablation of a single document: the bit of the one rule that
    rejects it, 0 where none or several do.
    """
    enforced = mask(policy) | mask(BASE)
    own = F.col("failed").bitwiseAND(F.lit(enforced))
    only = F.when(own.bitwiseAND(own - 1) == 0, own).otherwise(F.lit(0).cast("long"))
    base = ~passes(F.col("failed"), BASE)
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rest = tuple(m for m in MEASURES if m not in first)
    return ledger(docs, text, key).select("doc_id", *first, base.alias("base_failed"), (own == 0).alias("kept"), *rest, "failed", F.lit(policy).alias("policy"), only.alias("only_rule"))


def kept_rows(docs: DataFrame, policy: int = 2, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ledger row passes the policy, with all their columns.

    The ledger row stands beside the document, so neither a join nor a
    shuffle is needed; its columns' names may be anything.
    """
    row = fresh(docs, "ledger")
    marked = docs.withColumn(row, ledger_row(text))
    return marked.where(passes(bits(lambda m: F.col(row)[m]), policy)).select(*docs.columns)
