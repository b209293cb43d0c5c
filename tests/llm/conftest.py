from __future__ import annotations

import random

import pytest

PROSE = "the quick brown fox jumps over lazy dogs while many small birds sing about winter rain and summer light on old stone walls near quiet rivers".split()  # noqa: SIM905
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names stand for something inside the operators, too.
CLASHES = ["gone", "mixed", "k", "t", "size", "copies", "shard", "bucket", "kept", "failed", "print", "part", "__copies", "__n", "__sha", "__ledger", "of", "sha", "n", "own", "one", "row", "rank", "place", "ledger", "least", "more", "usual", "h", "s", "w"]


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        word = r.choice(PROSE) + str(r.randrange(40))
        out.append(word + ("\n" if i % 17 == 16 else " "))
    return "".join(out).strip()


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Documents with copies, near copies, shared passages, short, empty, null and very long texts."""
    r = random.Random(seed)
    texts: list[str | None] = [prose(r, r.randrange(60, 300)) for _ in range(n)]
    passage = prose(r, 70)
    for i in range(0, 12):
        texts.append(texts[i].replace(" ", "  \t"))  # equal but for white space
        texts.append(texts[i])
        words = texts[i].split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(prose(r, 30) + " " + passage + " " + prose(r, 40))
    hot = prose(r, 80)
    texts += [hot] * 60
    texts += [hot + f" tail{i}" for i in range(30)]
    texts += [None, None, "", "   \n ", "one", "one two", "ONE two", "x" * 50_000, prose(r, 6000), "word " * 400, "a\nb\nc\n" * 30, "¡§ 日本語 🙂🙂 ß " * 30, "#### $$$$ " * 60]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(k, texts[i], "en", r.choice(["a", "b", "b", "b", "c", None]), None) for k, i in enumerate(order)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys, repeated rows, one key with two texts, and columns with clashing names."""
    from pyspark.sql import functions as F

    base = [(None, "null key text here", "en", "a", 1), (None, None, None, None, None), (7, "same row " * 30, "en", "a", 2), (7, "same row " * 30, "en", "a", 2), (8, "first text " * 40, "en", "b", 3), (8, "second text " * 40, "en", "b", 4), (9, "", None, None, None)]
    df = spark.createDataFrame(base, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
