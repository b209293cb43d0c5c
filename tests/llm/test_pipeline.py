"""The pipeline against plain versions of its stages, and the entry without this folder."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from loglattice.llm import mixing, quality, stages

from . import brute
from .test_operators import check_pack


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, docs, rows, tmp_path):
    at = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        df = at[name] = spark.read.parquet(str(tmp_path / name))
    good = [(r[0], r[1]) for r in rows if not any_failure(r[1])]
    assert sorted(texts_of(at["quality rules"])) == sorted(good)
    exact = brute.exact(good)
    unique = [(k, t) for k, t in good if exact[k][2]]
    assert sorted(texts_of(at["exact dedup"])) == sorted(unique)
    near = brute.near(unique, 5, 80)
    apart = [(k, t) for k, t in unique if near[k][1] == k]
    assert sorted(texts_of(at["near dedup"])) == sorted(apart) and len(apart) < len(unique) < len(good) < len(rows)
    mixed = texts_of(at["mix sources"])
    assert set(mixed) <= set(apart) and max(Counter(mixed).values()) <= mixing.MOST_COPIES
    want = {r.doc_id: r.copies for r in mixing.mix(at["near dedup"]).collect()}
    assert Counter(k for k, _ in mixed) == Counter({k: n for k, n in want.items() if n})
    check_pack(at["pack"].collect(), mixed)


def any_failure(text):
    """The pipeline's policy, in plain Python."""
    n, chars, symbols, copied, repeated, _ = brute.quality(text)
    t = text or ""
    lines = len([x for x in t.split("\n") if brute.words(x)])
    upper, lower = (sum(a <= c <= b for c in t) for a, b in ("AZ", "az"))
    return n == 0 or 2 * repeated > n or 10 * symbols > n or (lines > 3 and 10 * copied > 3 * lines) or not 2 * n <= chars <= 25 * n or upper > lower or 4 * t.count("!") > n


def test_run_and_empty_table(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_odd_rows_pass_every_stage(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        assert out.count() >= 0 and (name == "pack" or out.columns == odd.columns), name
    copies = defaultdict(int)
    for k, t in texts_of(stages.drop_copies(spark, odd, "")):
        copies[k, t] += 1
    assert copies[7, "same row " * 30] == 1 and copies[8, "first text " * 40] == copies[8, "second text " * 40] == 1
    assert len(copies) == 5  # the null text yields to the empty one of document 9
