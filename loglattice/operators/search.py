"""Relevance-ranked search: tokens, postings, phrases, weighted BM25, snippets.

Documents have a key and seven text columns. The index is a postings table,
one row for each term of each column with the list of its places. A query
reads the rows of its terms; corpus figures (documents, document frequency,
mean length) cover the whole index, whatever filters a search has.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Text columns and their weights, in declared order.
WEIGHTS = {"headline": 10.0, "user_content": 3.0, "assistant_content": 2.0, "commands": 6.0, "paths": 5.0, "context_text": 2.0, "thinking": 0.5}
K1, B = 1.2, 0.75
#: idf where a phrase stands in half of all documents or more.
FLOOR = 1e-6
SNIPPET_TOKENS = 32
#: What is no letter, number, mark or private-use character parts tokens.
APART = r"[^\p{L}\p{N}\p{M}\p{Co}]+"


def fold(token: str) -> str:
    """Lower case, without diacritics."""
    low = token.lower()
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)) if not low.isascii() else low


#: Vowels, y, and all else of ASCII, which counts as consonants.
KINDS = {i: "v" if chr(i) in "aeiou" else "y" if chr(i) == "y" else "c" for i in range(128)}


def _kinds(w: str) -> str:
    """c or v for each character; a y is a consonant at the start and behind a vowel. Of a prefix, they are the prefix."""
    kinds = w.translate(KINDS)
    while (i := kinds.find("y")) >= 0:
        kinds = f"{kinds[:i]}{'v' if kinds[i - 1 : i] == 'c' else 'c'}{kinds[i + 1 :]}"
    return kinds


def _short(w: str, kinds: str, n: int) -> bool:
    """Whether the first n characters end in consonant, vowel and another consonant than w, x and y."""
    return n > 2 and kinds[n - 3 : n] == "cvc" and w[n - 1] not in "wxy"


#: The suffixes of Porter's 1980 algorithm, steps 2 to 4, with the two later changes in step 2 (bli, logi).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"), ("bli", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()  # noqa: SIM905




def _by_last(pairs: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Suffixes by their last letter, the longest first."""
    return {z: sorted((p for p in pairs if p[0][-1] == z), key=lambda p: -len(p[0])) for z in {p[0][-1] for p in pairs}}


BY_LAST2, BY_LAST3, BY_LAST4 = _by_last(STEP2), _by_last(STEP3), _by_last([(x, "") for x in STEP4])
#: Last letters that any rule asks for.
ENDS = frozenset("sdgyel").union(BY_LAST2, BY_LAST3, BY_LAST4)


def porter(w: str) -> str:
    """Porter's stem of a folded token; tokens that are short, long or not plain letters and digits stay.

    The measure of a prefix is how often its kinds go from vowel to consonant.
    """
    if w[-1:] not in ENDS or not 3 <= len(w) <= 64 or not w.isascii():
        return w
    if w[-1] == "s":
        if w.endswith("sses") or w.endswith("ies") and len(w) > 3:
            w = w[:-2]
        elif w[-2] != "s":
            w = w[:-1]
    kinds, n = _kinds(w), 0
    if w.endswith("eed"):
        if kinds.count("vc", 0, len(w) - 3) > 0:
            w = w[:-1]
    elif w.endswith("ed"):
        n = len(w) - 2
    elif w.endswith("ing"):
        n = len(w) - 3
    if n > 0 and "v" in kinds[:n]:
        w = w[:n]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif n > 1 and w[-1] == w[-2] and kinds[n - 1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif kinds.count("vc", 0, n) == 1 and _short(w, kinds, n):
            w += "e"
        kinds = _kinds(w)
    if w[-1] == "y" and "v" in kinds[: len(w) - 1]:
        w = w[:-1] + "i"
        kinds = kinds[: len(w) - 1] + "v"
    for by_last in (BY_LAST2, BY_LAST3):
        for suffix, other in by_last.get(w[-1], ()):
            if w.endswith(suffix):
                if kinds.count("vc", 0, len(w) - len(suffix)) > 0:
                    w = w[: -len(suffix)] + other
                    kinds = _kinds(w)
                break
    for suffix, _ in BY_LAST4.get(w[-1], ()):
        if w.endswith(suffix):
            n = len(w) - len(suffix)
            if kinds.count("vc", 0, n) > 1 and (suffix != "ion" or w[n - 1] in "st"):
                w = w[:n]
            break
    if w[-1] == "e":
        m = kinds.count("vc", 0, len(w) - 1)
        if m > 1 or m == 1 and not _short(w, kinds, len(w) - 1):
            w = w[:-1]
    if w.endswith("ll") and kinds.count("vc", 0, len(w) - 1) > 1:
        w = w[:-1]
    return w


def stemmed(term: str) -> Column:
    """Stems of folded terms; a column of distinct ones."""

    @F.pandas_udf("string")
    def of(terms: pd.Series) -> pd.Series:
        return terms.map(porter)

    return of(F.col(term))


def tokens_of(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(APART, text) if t]


def query_phrases(query: str, stem: bool = True) -> list[list[str]]:
    """One phrase for each word of a query, quotes removed: its tokens in order; words without tokens match nothing."""
    out = []
    for word in re.sub(r"['\"]", "", query).split():
        terms = [porter(fold(t)) if stem else t.lower() for t in tokens_of(word)]
        if terms and terms not in out:
            out.append(terms)
    return out


def term_of(token: str, stem: bool) -> str:
    return porter(fold(token)) if stem else token.lower()


#: Bytes of text and tokens that a worker indexes at once, and postings in one batch of rows.
STEP_BYTES, STEP_TOKENS, BATCH_ROWS = 4 << 20, 1 << 20, 1 << 15
#: Distinct tokens at which a step ends: they are objects, and weigh more than the arrays.
REMEMBERED = 1 << 17
#: ASCII letters and digits as they are, all else of ASCII as blanks.
PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 0x20 for c in range(256))


def terms_of(tokens: list[str], stem: bool) -> pa.DictionaryArray:
    """``term_of`` of many tokens at once; a blank parts them, as none holds one."""
    text = " ".join(tokens).lower()
    if not stem:
        return pa.array(text.split(" ")).dictionary_encode()
    text = unicodedata.normalize("NFD", text)
    marks = "".join(c for c in set(text) if unicodedata.combining(c))
    return pa.array(map(porter, (re.sub(f"[{marks}]+", "", text) if marks else text).split(" ")), pa.string()).dictionary_encode()


def _numbers(text: bytes, table: dict[str | bytes, int]) -> np.ndarray:
    """Numbers of the text's tokens, in order; the table gives new ones."""
    tokens = text.translate(PLAIN).split() if text.isascii() else tokens_of(text.decode())
    return np.fromiter(map(table.__getitem__, tokens), np.int32, len(tokens))


def postings(docs: DataFrame, key: str, columns: list[str] | None = None, stem: bool = True) -> DataFrame:
    """(key, term, col, n, gaps, length): one row for each term of each text column.

    ``gaps`` are the term's places in the column, the first as it is and each
    other as its distance from the one before; ``length`` counts the tokens of
    all the document's columns, so a score needs no other table. Tokens are
    folded and stemmed where they stand: nothing is shuffled. Rows come in
    order of terms for every few MB of text, so that the statistics of a
    written file's pages tell which may hold a term. Null texts are empty;
    rows of one key are documents of their own only if their keys differ.
    """
    names = columns or list(WEIGHTS)
    narrow = docs.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])
    kind = narrow.schema["key"].dataType

    def rows(keys: pa.Array, ids: list[np.ndarray], table: dict[str | bytes, int]) -> Iterator[pa.RecordBatch]:
        """``ids``: of every text of the first document, then of the next; they and the table are emptied, as they are copied."""
        texts, sizes = len(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        every = np.concatenate(ids)
        ids.clear()
        if not total:
            return
        tokens = [t if isinstance(t, str) else t.decode() for t in table]
        table.clear()
        terms = terms_of(tokens, stem)
        del tokens
        shown = pc.sort_indices(terms.dictionary)
        names_of = terms.dictionary.take(shown)
        rank = np.empty(len(shown), np.int64)
        rank[shown.to_numpy()] = np.arange(len(shown))
        cell = rank[terms.indices.to_numpy()][every]
        del terms, shown
        cell *= texts
        cell += np.repeat(np.arange(texts, dtype=np.int32), sizes)
        del every, rank
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.append(0, np.flatnonzero(cell[1:] != cell[:-1]) + 1)
        cell = cell[first]
        place = np.arange(total, dtype=np.int32)
        place -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        place = place[order]
        del order
        gap = place.copy()
        gap[1:] -= place[:-1]
        gap[first] = place[first]
        del place
        lengths = sizes.reshape(-1, len(names)).sum(axis=1)
        ends = np.append(first, total)
        for a in range(0, len(first), BATCH_ROWS):
            cuts = ends[a : a + BATCH_ROWS + 1]
            term, text = np.divmod(cell[a : a + BATCH_ROWS], texts)
            owner, column = np.divmod(text, len(names))
            places = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(gap[cuts[0] : cuts[-1]]))
            columns = [keys.take(pa.array(owner)), names_of.take(pa.array(term)), pa.array(names).take(pa.array(column)), pa.array(np.diff(cuts).astype(np.int32)), places, pa.array(lengths[owner])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "term", "col", "n", "gaps", "length"])

    def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A batch may hold 10,000 long texts: they are taken out one by one, as the bytes they are."""
        texts = [c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()) for c in batch.columns[1:]]
        begin, size, tokens, ids, table = 0, 0, 0, [], defaultdict(count().__next__)
        for i in range(batch.num_rows):
            for c in texts:
                text = c[i].as_py()
                ids.append(_numbers(text, table))
                size += len(text)
                tokens += len(ids[-1])
            if size > STEP_BYTES or tokens > STEP_TOKENS or len(table) > REMEMBERED or i == batch.num_rows - 1:
                yield from rows(batch.column(0).slice(begin, i + 1 - begin), ids, table)
                begin, size, tokens, ids, table = i + 1, 0, 0, [], defaultdict(count().__next__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A worker keeps nothing from step to step, and no batch while the next is read."""
        for batch in batches:
            yield from steps(batch)
            del batch

    schema = StructType([StructField("key", kind), StructField("term", StringType()), StructField("col", StringType()), StructField("n", IntegerType()), StructField("gaps", ArrayType(IntegerType())), StructField("length", LongType())])
    return narrow.mapInArrow(run, schema)


def _starts(gaps: list[np.ndarray | None]) -> int:
    """How often terms with these places follow one another."""
    at = None
    for j, own in enumerate(gaps):
        if own is None:
            return 0
        here = np.cumsum(own) - j
        at = here if at is None else np.intersect1d(at, here, assume_unique=True)
    return len(at)


def phrase_hits(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(key, phrase, col, n, length): how often each phrase stands in each column. Only rows of the phrases' terms are read; a phrase of one term is its row."""
    wanted = sorted({t for p in phrases for t in p})
    if not wanted:
        return index.select("key", F.lit(0).alias("phrase"), "col", F.col("n").cast("long").alias("n"), "length").limit(0)
    single = {p[0]: i for i, p in enumerate(phrases) if len(p) == 1}
    longer = [(i, p) for i, p in enumerate(phrases) if len(p) > 1]
    out = None
    if single:
        number = F.create_map(*[F.lit(x) for pair in single.items() for x in pair])
        out = index.where(F.col("term").isin(*sorted(single))).select("key", F.element_at(number, F.col("term")).alias("phrase"), "col", F.col("n").cast("long").alias("n"), "length")
    if longer:
        terms = sorted({t for _, p in longer for t in p})
        parts = index.where(F.col("term").isin(*terms)).groupBy("key", "col").agg(F.first("length").alias("length"), *[F.first(F.when(F.col("term") == t, F.col("gaps")), ignorenulls=True).alias(f"at{i}") for i, t in enumerate(terms)])

        @F.pandas_udf("array<long>")
        def counts(*at: pd.Series) -> pd.Series:
            return pd.Series([[_starts([row[terms.index(t)] for t in p]) for _, p in longer] for row in zip(*at, strict=True)])

        each = parts.select("key", "col", "length", F.posexplode(counts(*[f"at{i}" for i in range(len(terms))])).alias("which", "n"))
        which = F.create_map(*[F.lit(x) for pair in enumerate(i for i, _ in longer) for x in pair])
        found = each.where("n > 0").select("key", F.element_at(which, F.col("which")).alias("phrase"), "col", "n", "length")
        out = found if out is None else out.unionByName(found)
    return out


def bm25(index: DataFrame, phrases: list[list[str]], weights: dict[str, float] | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(key, score) of documents with any of the phrases; lower is better.

    Weights multiply how often a phrase stands in a column. ``documents`` is
    what the index covers, where texts may be empty.
    """
    weights = weights or WEIGHTS
    total = index.agg(F.count_distinct("key").alias("docs")) if documents is None else documents.agg(F.count(F.lit(1)).alias("docs"))
    mean = index.agg(F.sum("n").alias("tokens"))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    tf = phrase_hits(index, phrases).groupBy("key", "phrase").agg(F.sum(F.col("n") * F.element_at(weight, F.col("col"))).alias("tf"), F.first("length").alias("length"))
    frequency = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    # corpus figures are one row, frequencies one for each word of the query
    joined = tf.join(F.broadcast(frequency), "phrase").crossJoin(F.broadcast(total.crossJoin(mean)))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (F.col("tokens") / F.col("docs"))))
    return joined.groupBy("key").agg((-F.sum(part)).alias("score"))


def _sentences(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Tokens that begin a sentence: the first, and those behind a full stop or colon and white space."""
    out = [0]
    for i, (begin, _) in enumerate(spans[1:], 1):
        before = text[max(0, spans[i - 1][1]) : begin]
        bare = before.rstrip(" \t\n\r")
        if len(bare) < len(before) and bare[-1:] in (".", ":"):
            out.append(i)
    return out


def snippet(columns: dict[str, str], phrases: list[list[str]], size: int = SNIPPET_TOKENS, stem: bool = True) -> str | None:
    """The best piece of ``size`` tokens of any column, as SQLite's full-text index picks it; null without a hit.

    Every hit opens a window, and so does the start of the sentence it stands
    in. A phrase's first hit in a window counts 1000, others 1; a window that
    begins a sentence counts 100 more, 120 the text's first. A window that a
    hit opens is then moved so that its hits are in the middle. Of equal
    windows the earliest stays.
    """
    import regex

    best = None
    for text in columns.values():
        text = text or ""
        spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}\p{M}\p{Co}]+", text)]
        terms = [term_of(text[a:b], stem) for a, b in spans]
        hits = sorted((i, k) for k, p in enumerate(phrases) for i in range(len(terms) - len(p) + 1) if terms[i : i + len(p)] == p)
        if not hits:
            continue
        starts = _sentences(text, spans)

        def scored(begin: int, hits=hits, n=len(spans)) -> tuple[int, int]:
            """The window's worth, and where it begins once its hits are in the middle."""
            seen, worth, first, last = set(), 0, -1, 0
            for at, k in hits:
                if begin <= at < begin + size:
                    worth += 1 if k in seen else 1000
                    seen.add(k)
                    first, last = at if first < 0 else first, at + len(phrases[k])
            return worth, max(0, min(first - int((size - (last - first)) / 2), n - size))

        for at, _ in hits:
            worth, begin = scored(at)
            if best is None or worth > best[0]:
                best = (worth, text, spans, begin)
            if len(spans) > size:
                start = max((s for s in starts if s <= at), default=0)
                if start < at:
                    worth = scored(start)[0] + (100 if start else 120)
                    if worth > best[0]:
                        best = (worth, text, spans, start)
    if best is None:
        return None
    _, text, spans, start = best
    end = min(len(spans), start + size)
    body = text[spans[start][0] if start else 0 : spans[end - 1][1] if end < len(spans) else len(text)]
    return ("…" if start else "") + body + ("…" if end < len(spans) else "")


def snippets(columns: list[str], phrases: list[list[str]], size: int = SNIPPET_TOKENS, stem: bool = True) -> Column:
    """The snippet of each row, made by executors; for rows that are shown, after the limit."""

    @F.pandas_udf("string")
    def of(*texts: pd.Series) -> pd.Series:
        return pd.Series([snippet(dict(zip(columns, row, strict=True)), phrases, size, stem) for row in zip(*texts, strict=True)], dtype=object)

    return of(*[F.col(c) for c in columns])


def ranked(scores: DataFrame, runs: DataFrame, limit: int, *filters: Column) -> DataFrame:
    """Best runs first; filters narrow what is shown, not the figures of the index."""
    rows = runs
    for f in filters:
        rows = rows.where(f)
    return rows.join(scores.withColumnRenamed("key", "file_path"), "file_path").orderBy("score", "file_path").limit(limit)
