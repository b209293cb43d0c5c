"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each applying one operator's decisions.

A decision that most documents share needs no join: a Bloom filter of the keys
with another decision tells nearly all others apart beside the row. Only what
the filter lets through is joined by key, so only these texts are shuffled. A
null key is a key like others. Rows that share a key share its decision; see
each stage for rows that repeat. Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, near_dedup, packing, quality
from .common import Bloom, Workspace, fresh, numbered, tokenizer_path

#: The policy of the quality ledger that the pipeline applies: it keeps short documents.
POLICY = 3
#: Sources whose usual number of copies is broadcast; with more, every row is joined with its own.
SOURCES = 1 << 16


def _key(docs: DataFrame) -> F.Column:
    return docs["doc_id"].cast("long")


def _apart(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be one of ``keys`` (doc_id, distinct), and rows whose key is none of them."""
    hit = Bloom(keys.select(F.xxhash64("doc_id").alias("h"))).column(F.xxhash64(_key(docs)))
    return docs.where(hit), docs.where(~hit)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    gone = keys.select(F.col("doc_id").alias(fresh(docs, "gone")))
    return docs.join(gone, _key(docs).eqNullSafe(gone[gone.columns[0]]), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps.

    A ledger row is a function of the text alone, so it is made beside the
    document, the policy reads its bits, and nothing is shuffled.
    """
    return quality.kept_rows(docs, POLICY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of every group of equal texts; of rows that repeat its key and text, one."""
    work = Workspace(spark)
    found = work.put(exact_dedup.exact_dedup(docs))
    # keys with a row that goes, or with several rows, which are settled row by row
    settled = work.put(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept"))
    possible, others = _apart(docs, settled)
    stay = others.unionByName(_without(possible, settled))
    repeated = settled.where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return stay
    of, sha = fresh(docs, "of"), fresh(docs, "sha")
    good = found.where("kept").join(repeated.withColumnRenamed("doc_id", of), F.col("doc_id").eqNullSafe(F.col(of)), "left_semi").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha)).distinct()
    own = F.sha2(F.translate(F.coalesce(possible["text"], F.lit("")), " \t\n\r\x0b\x0c", ""), 256)
    several = possible.join(good, _key(possible).eqNullSafe(good[of]) & (own == good[sha]), "left_semi")
    own = F.sha2(F.translate(F.coalesce(several["text"], F.lit("")), " \t\n\r\x0b\x0c", ""), 256)
    # one row of each text, by an aggregate that combines before the shuffle
    first = F.struct(-F.coalesce(F.length(several["text"]), F.lit(-1)), several["doc_id"].isNull(), several["doc_id"], several["text"])
    row = F.min_by(F.struct(*[several[c] for c in docs.columns]), first).alias("row")
    return stay.unionByName(several.groupBy(own.alias("own")).agg(row).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of every component of near-duplicates; shingles of five words, similarity 0.8."""
    work = Workspace(spark)
    found = work.put(near_dedup.near_dedup(docs))
    gone = work.put(found.where("not kept").select("doc_id").distinct())
    possible, others = _apart(docs, gone)
    return others.unionByName(_without(possible, gone))


def _repeat(rows: DataFrame, copies: str, columns: list[str]) -> DataFrame:
    """Every row as often as its column ``copies`` says, with ``columns`` only."""
    one = fresh(rows, "one")
    return rows.where(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that share a key, source and size share out their counts.

    Most documents of a source are taken equally often; those that aren't, and
    rows whose key repeats, are joined with their counts.
    """
    work = Workspace(spark)
    found = work.put(mixing.mix(docs))
    counted = found.where("size > 0").groupBy("source", "copies").agg(F.count(F.lit(1)).alias("n"))
    usual = work.put(counted.groupBy("source").agg(F.max_by("copies", F.struct("n", "copies")).alias("usual")))
    if usual.count() > SOURCES:
        usual = usual.limit(0)
    keys = found.join(F.broadcast(usual.select(F.col("source").alias("of"), "usual")), F.col("source").eqNullSafe(F.col("of")), "left")
    keys = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("size") > 0) & ~F.col("copies").eqNullSafe(F.col("usual"))).alias("other"), F.first("copies").alias("copies"))
    special = work.put(keys.where("n > 1 or other"))
    possible, others = _apart(docs, special)

    of, n, copies = (fresh(docs, c) for c in ("of", "n", "copies"))
    words = F.coalesce(F.regexp_like("text", F.lit(mixing.WORD)), F.lit(False))

    def usually(rows: DataFrame) -> DataFrame:
        by = usual.select(F.col("source").alias(of), F.col("usual").alias(copies))
        return _repeat(rows.where(words).join(F.broadcast(by), F.col("source").cast("string").eqNullSafe(F.col(of))), copies, docs.columns)

    own = special.where("n = 1").select(F.col("doc_id").alias(of), F.col("copies").alias(copies))
    counts = _repeat(possible.join(own, _key(possible).eqNullSafe(own[of])), copies, docs.columns)
    out = usually(others.unionByName(_without(possible, special))).unionByName(counts)
    repeated = special.where("n > 1").select(F.col("doc_id").alias(of))
    if not repeated.limit(1).count():
        return out
    # rows of one key, source and size have the same counts but for one copy more; the first of them get it
    several = possible.join(repeated, _key(possible).eqNullSafe(repeated[of]), "left_semi")
    k, s, w, place, rank, least, more = (fresh(docs, c) for c in ("k", "s", "w", "place", "rank", "least", "more"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).cast("long")
    several = work.put(several.select("*", _key(several).alias(k), F.col("source").cast("string").alias(s), size.alias(w), F.monotonically_increasing_id().alias(place)))
    group = found.groupBy(F.col("doc_id").alias(k), F.col("source").alias(s), F.col("size").alias(w)).agg(F.min("copies").alias(least), F.sum("copies").alias(n), F.count(F.lit(1)).alias(copies))
    group = group.withColumn(more, F.col(n) - F.col(least) * F.col(copies)).drop(n, copies)
    ranked = numbered(several.select(k, s, w, place), [k, s, w], F.shiftright(place, 33), [place], rank)
    same = [ranked[c].eqNullSafe(group[c]) for c in (k, s, w)]
    taken = ranked.join(group, same[0] & same[1] & same[2]).select(ranked[place], (F.col(least) + (F.col(rank) < F.col(more)).cast("long")).alias(copies))
    return out.unionByName(_repeat(several.join(taken, place), copies, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, copies included, with their sequences."""
    return packing.pack_documents(docs, tokenizer_path())
