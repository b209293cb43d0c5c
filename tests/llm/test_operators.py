"""Operators against plain versions, and what they make of odd tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loglattice.llm import components, exact_dedup, license_model, licenses, mixing, near_dedup, packing, quality, revisits, sharding, substring_dedup, token_counts
from loglattice.llm.common import Workspace, tokenizer_path
from pyspark.sql import functions as F

from . import brute


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


MIXED = st.lists(st.sampled_from([*"ab '\n\t .,1Zé日🙂\x1c\xa0　s", "<|endoftext|>", "  ", "'ll", " the"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(MIXED, st.text(max_size=30)), min_size=1, max_size=8))
def test_tokens_of_any_text(texts):
    want = library(texts)
    assert token_counts.counter(tokenizer_path()).count(pa.array(texts)).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in packing.coder(tokenizer_path()).of(pa.array(texts))] == want


def test_chunk_table_starts_afresh_and_grows():
    counter = token_counts.TokenCounter(tokenizer_path())
    counter.table.bits = 6
    counter.table._clear()
    r = random.Random(2)
    for _ in range(5):
        texts = [" ".join(f"w{r.randrange(3000)}x" for _ in range(60)) for _ in range(8)]
        assert counter.count(pa.array(texts)).tolist() == [len(x) for x in library(texts)]


def thue_morse(n, a, b):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)]


@pytest.mark.parametrize("letters", ["ab", "th", "xq", "01"])
@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_that_polynomial_hashes_confuse(n, letters):
    texts = [*thue_morse(n, *letters), *["a " + t for t in thue_morse(n, *letters)]] * 2
    want = library(texts)
    assert token_counts.TokenCounter(tokenizer_path()).count(pa.array(texts)).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in packing.TokenIds(tokenizer_path()).of(pa.array(texts))] == want


def test_long_pretokens():
    r = random.Random(5)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "日本語", "!?.") for n in (2047, 2048, 30_000)]
    texts += ["x" * 50_001, "ab" * 5000 + "a", "aaab" * 4000, " " * 5000]
    assert token_counts.counter(tokenizer_path()).count(pa.array(texts)).tolist() == [len(x) for x in library(texts)]


def test_vocabularies_with_other_rules_are_refused(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        at = tmp_path / "other.json"
        at.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            token_counts.TokenCounter(str(at))


def test_token_counts(docs, rows, odd, empty):
    want = dict(zip((k for k, _ in pairs(rows)), library([t or "" for _, t in pairs(rows)]), strict=True))
    for r in token_counts.token_counts(docs, tokenizer_path()).collect():
        text = rows[r.doc_id][1] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(want[r.doc_id]), len(want[r.doc_id]) > 512)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd, tokenizer_path()).collect()) == Counter((r.doc_id, len(library([r.text or ""])[0])) for r in odd.collect())
    assert token_counts.token_counts(empty, tokenizer_path()).count() == 0


def check_pack(found, texts):
    """texts: [(doc_id, text)], each row once."""
    ids = Counter()
    for k, t in texts:
        x = np.array([*library([t or ""])[0], 0], "<u4")
        ids[k, len(x), zlib.crc32(x.tobytes())] += 1
    assert sum(r.length for r in found) == sum(n * c for (_, n, _), c in ids.items())
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 1024
    return by_sequence


def test_pack(docs, rows, odd, empty):
    found = packing.pack_documents(docs, tokenizer_path()).collect()
    sequences = check_pack(found, pairs(rows))
    assert sum(r.length for r in found) / 1024 / len(sequences) > 0.95
    of = defaultdict(list)
    for r in found:
        of[r.doc_id].append(r)
    for k, t in pairs(rows):
        x = np.array([*library([t or ""])[0], 0], "<u4")
        own = sorted(of[k], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(y.length for y in own[:i]) for i in range(len(own))] and own[-1].start + own[-1].length == len(x)
        assert all(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(x) for r in own)
    again = packing.pack_documents(docs.repartition(3), tokenizer_path()).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    check_pack(packing.pack_documents(odd, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_differencing(lengths):
    x = np.array(lengths, np.int64)
    windows = packing.pack_lengths(x)
    assert sorted(i for w in windows for i in w) == list(range(len(x)))
    assert all(x[w].sum() <= 1024 for w in windows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200), st.integers(1, 7))
def test_rice_code_round_trip(values, owners):
    bounds = exact_dedup.owner_bounds(owners)
    x = np.sort(np.array(values, np.uint64))
    for low, high in zip(bounds, bounds[1:], strict=False):
        own = x[[low <= int(v) < high for v in x]] if len(x) else x
        bits, unary, rest = exact_dedup.rice_encode(own, low, high)
        assert (exact_dedup.rice_decode(len(own), bits, unary, rest, low) == own).all()


def test_exact(docs, rows, odd, empty):
    want = brute.exact(pairs(rows))
    for owners in (1, 5):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, owners=owners).collect()}
        assert got == want
    found = exact_dedup.exact_dedup(odd).collect()
    assert len(found) == 7 and [r.group_size for r in found if r.doc_id == 7] == [2, 2] and all(r.kept for r in found if r.doc_id in (7, 8))
    assert Counter(r.kept for r in found if r.doc_id is None) == {True: 1, False: 1}  # the empty one yields to document 9
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_substrings(docs, rows, odd, empty):
    want = brute.repeats(pairs(rows))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 5000
    small = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, size=9, with_text=True).collect()}
    assert small == brute.repeats(pairs(rows), 9)
    found = substring_dedup.substring_dedup(odd).collect()
    assert len(found) == 7 and all(r.n_removed == 0 for r in found) and substring_dedup.substring_dedup(empty).count() == 0


def test_substrings_of_many_repeated_rows(spark):
    """Rows that repeat key and text are one document: they take from none of themselves, and all lose what another holds before."""
    r = random.Random(17)
    shared = " ".join(f"w{r.randrange(500)}" for _ in range(120))
    first, again = (1, shared + " one"), (2, "own " + shared)
    rows = spark.createDataFrame([first], "doc_id long, text string").unionByName(spark.range(20_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(again[1]).alias("text")))
    want = brute.repeats([first, again])
    found = substring_dedup.substring_dedup(rows.repartition(8)).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    assert {f.doc_id: (f.n_words, f.n_removed, f.kept_sha256) for f in found} == want and {f.doc_id: f["count"] for f in found} == {1: 1, 2: 20_000}
    assert want[2][1] == 120


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near(docs, rows, size, percent):
    want = brute.near(pairs(rows), size, percent)
    found = near_dedup.near_dedup(docs, size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_in_blocks(spark, monkeypatch):
    """Copies at the limit: many pairs of one bucket are linked to each other but not to the smallest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(len(words))] = f"z{r.randrange(6)}"
        rows.append((k, " ".join(words)))
    want = brute.near(rows, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_near_odd(odd, empty):
    found = near_dedup.near_dedup(odd).collect()
    assert len(found) == 7 and all(r.component_id == r.doc_id and r.kept for r in found)
    assert near_dedup.near_dedup(empty).count() == 0


def test_large_components_in_blocks(spark, monkeypatch):
    """Most of a bucket is one component that fills blocks of its own; the others link to single members of it."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(40)]
    for k in range(40, 70):
        words = list(base)
        for _ in range(r.randrange(3, 9)):
            words[r.randrange(len(words))] = f"z{r.randrange(9)}"
        rows.append((k, " ".join(words)))
    want = brute.near(rows, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_bloom_filter(spark):
    from loglattice.llm.common import Bloom

    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    hit = Bloom(keys).column(F.xxhash64("id"))
    got = {r.id for r in spark.range(3000).where(hit).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1100
    assert spark.range(30).where(Bloom(keys, most=1 << 10).column(F.xxhash64("id"))).count() <= 30  # few bits: many pass
    assert spark.range(30).where(Bloom(keys, most=1 << 8).column(F.xxhash64("id"))).count() == 30
    assert spark.range(30).where(Bloom(keys.limit(0)).column(F.xxhash64("id"))).count() == 0


def test_lookups_and_ranks_of_hot_keys(spark, monkeypatch):
    from loglattice.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = Workspace(spark).put(spark.range(1000).repartition(3).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id", F.monotonically_increasing_id().alias("place")))
    figures = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("k <> 7")
    got = common.lookup(rows, figures, ["k"]).collect()
    assert len(got) == len({r.id for r in got}) == rows.where("k <> 7").count() and all(r.least == (r.k or 0) for r in got)
    ranks = defaultdict(list)
    for r in common.numbered(rows, ["k"], F.shiftright("place", 33), ["place"], "rank").collect():
        ranks[r.k].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {x.u: x.v for x in components.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_sharding(spark, docs, rows, odd, empty):
    found = sharding.shard_rows(docs, 7).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        t = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = {r.doc_id: r.shard for r in sharding.shard_rows(many, 20).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_rows(many, 21).collect()}
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert 1 / 21 <= moved < 0.35  # dealing anew would move 20 of 21
    assert Counter(r.shard for r in sharding.shard_rows(odd, 3).collect()).keys() == {0, 1, 2} and sharding.shard_rows(empty, 3).count() == 0


def walk(owner, rows, capacity):
    """Where rows (cell, order) go: each shard first takes its own cells' rows in clockwise order, then what is left walks on to the next with room."""
    room, placed, left = list(capacity), {}, []
    for cell, key in sorted(rows):
        if room[owner[cell]]:
            room[owner[cell]] -= 1
            placed[key] = owner[cell]
        else:
            left.append((cell, key))
    for cell, key in left:
        at = cell
        while not room[owner[at]]:
            at = (at + 1) % len(owner)
        room[owner[at]] -= 1
        placed[key] = owner[at]
    return placed


@pytest.mark.parametrize("ranked", [1 << 18, 20])
def test_placement_against_a_plain_walk(spark, monkeypatch, ranked):
    monkeypatch.setattr(sharding, "RANKED", ranked)
    n, shards = 3000, 6
    keys = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text")).repartition(3)
    bits = sharding.cell_bits(shards)
    hashes = keys.select("doc_id", F.xxhash64(F.lit("ring"), "doc_id").alias("h")).collect()
    rows = [(((r.h % (1 << 64)) >> (64 - bits)), (r.h, r.doc_id, i)) for i, r in enumerate(hashes)]
    want = walk(sharding.ring(shards, bits=bits), rows, sharding.capacities(n, shards))
    got = sharding.shard_rows(keys, shards).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((key[1], shard) for key, shard in want.items())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(shards))


def test_ring_keeps_all_points():
    for shards in (3, 40, 600):
        owner = sharding.ring(shards, bits=sharding.cell_bits(shards))
        assert set(owner) == set(range(shards)) and len(owner) >= 16 * 64 * shards


def test_overflow_fills_all():
    owner = sharding.ring(5, 8, 8)
    r = random.Random(1)
    for _ in range(20):
        loads = {c: r.randrange(50) for c in r.sample(range(256), 100)}
        total = sum(loads.values())
        out = sharding.overflow(owner, loads, sharding.capacities(total, 5))
        assert sum(b - a for _, a, b, _, _ in out) == total
        for cell, n in loads.items():
            spans = sorted((a, b) for c, a, b, _, _ in out if c == cell)
            assert [x for a, b in spans for x in range(a, b)] == list(range(n))


def test_mixing(spark, docs, rows, odd, empty):
    found = mixing.mix(docs, batch_rows=16, fan_in=3).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    assert Counter(map(tuple, mixing.mix(docs.repartition(2), batch_rows=16, fan_in=3).collect())) == Counter(map(tuple, found))
    sizes, target, taken = Counter(), {}, Counter()
    for r in found:
        assert r.size == len(brute.words(rows[r.doc_id][1])) and r.source == rows[r.doc_id][3] and r.taken == r.copies * r.size <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights, goal, open_names = dict(zip(names, [5, 2, 1, 5], strict=True)), {}, set(names)
    while True:  # cap and share again, step by step
        rest = sum(sizes.values()) - sum(goal.values())
        share = {n: rest * weights[n] / sum(weights[m] for m in open_names) for n in open_names}
        over = {n for n in open_names if share[n] > 3 * sizes[n]}
        if not over:
            break
        goal |= {n: 3.0 * sizes[n] for n in over}
        open_names -= over
    goal |= share
    longest = max(r.size for r in found)
    for n in names:
        assert target[n] == pytest.approx(goal[n]) and abs(taken[n] - target[n]) <= longest
    got = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r.doc_id, len(brute.words(r.text)), r.source) for r in odd.collect()) and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mix(empty).count() == 0


def test_pivot_keeps_sums_and_expectations():
    r = random.Random(0)
    size, share = np.array([3, 50, 7, 120, 9, 30]), np.array([0.2, 0.7, 0.5, 0.4, 0.9, 0.3])
    total = np.zeros(6)
    for _ in range(4000):
        got = mixing.pivot(share, size, r)
        assert ((got > 0) & (got < 1)).sum() <= 1 and (got * size).sum() == pytest.approx((share * size).sum())
        total += got
    assert np.abs(total / 4000 - share).max() < 0.04


def test_settling_leaves_little():
    size = np.array(sorted((3 * i * i + 1 for i in range(40)), reverse=True))
    share = np.full(40, 0.37)
    for k in range(300):
        got = mixing.settle(share, size, random.Random(k))
        assert set(got) <= {0.0, 1.0} and abs((got * size).sum() - (share * size).sum()) < 400


def test_quality(docs, rows, odd, empty):
    found = quality.quality_rules(docs).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in found} == {k: brute.quality(t) for k, t in pairs(rows)}
    assert not any(r.kept and r.base_failed for r in found) and any(r.kept for r in found)
    ledger = quality.ledger(docs)
    report = {r.rule: r for r in quality.ablations(ledger).collect()}
    own = [r.failed & quality.mask(2) for r in found]
    assert all(r.only_rule == (f if bin(f).count("1") == 1 else 0) for r, f in zip(found, own, strict=True))
    assert all(report[rule.name].without_it == sum(f & ~(1 << i) == 0 for f in own) for i, rule in enumerate(quality.RULES))
    for i, rule in enumerate(quality.RULES):
        assert report[rule.name].failing == sum(r.failed >> i & 1 for r in found)
        assert report[rule.name].alone == sum((r.failed & quality.mask(2)) == 1 << i for r in found)
    kept = {r.doc_id for r in quality.kept_rows(docs).collect()}
    assert kept == {r.doc_id for r in found if r.kept}
    assert sorted((r.n_words, r.base_failed) for r in quality.quality_rules(odd).collect()) == sorted((brute.quality(r.text)[0], brute.quality(r.text)[5]) for r in odd.collect())
    assert quality.quality_rules(empty).count() == 0
    assert quality.kept_rows(odd).columns == odd.columns


def test_many_distinct_words():
    words = [str(i % 7 if i < 20 else i).encode() for i in range(60)]
    assert quality.repeat_words(words) == brute.quality(" ".join(w.decode() for w in words))[4]


def test_license_model():
    model = license_model.trained()
    assert model.accuracy > 0.97 and 0.5 <= model.threshold < 1 and len(model.weights) < 1000


def test_licenses(spark, odd, empty):
    texts = ["some words\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "All rights reserved.\n\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "The bus driver lost his license.", "MIT students watched the Apache helicopter", None, "x " * 9000 + "\nReleased under the MIT License."]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.families for r in found] == ["apache", "mit", "gpl,proprietary", "cc-by-nc", "cc-by", "", "", "", "mit"]
    assert [r.n_paragraphs for r in found][:3] == [3, 1, 2] and found[2].top_family == "gpl"
    assert licenses.scan(odd).count() == 7 and licenses.scan(empty).count() == 0


def record(i, url, ts, kind="response", status=200, headers=None, digest=None):
    return (i, url, ts, kind, status, headers, digest)


RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string"


def test_revisits(spark):
    rows = [
        record(1, "http://www.Example.org:80/a/?b=2&utm_source=x&a=1#top", 10, headers={"etag": '"v1"', "content-type": "text/html", "date": "d1"}, digest="D1"),
        record(2, "https://example.org/a?a=1&b=2", 20, headers={"etag": '"v2"', "last-modified": "m2"}, digest="D2"),
        record(3, "https://example.org/a?a=1&b=2", 25, status=404),
        record(4, "https://example.org/a?a=1&b=2", 26, status=206, digest="part"),
        record(11, "http://example.org/a?a=1&b=2", 15, "revisit", 304, {"etag": 'W/"v1"', "date": "d2", "content-type": "no"}),
        record(12, "http://example.org/a?a=1&b=2", 30, "revisit", 304, {"etag": '"v1"'}),
        record(13, "http://example.org/a?a=1&b=2", 30, "revisit", 304, {"last-modified": "m2"}),
        record(14, "http://example.org/a?a=1&b=2", 10, "revisit", 304, None),
        record(15, "http://example.org/a?a=1&b=2", 21, "revisit", 304, {}, "D2"),
        record(16, "http://example.org/a?a=1&b=2", 22, "revisit", 304, {"etag": None}),
        record(17, None, 22, "revisit", 304, {}),
        record(18, "http://other.org", None, "revisit", 304, {}),
        record(18, "http://other.org", None, "revisit", 304, {}),
    ]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 9
    assert {k: (r.response_id, r.outcome) for k, r in by.items()} == {11: (1, "resolved"), 12: (2, "mismatch"), 13: (2, "resolved"), 14: (None, "unanchored"), 15: (2, "resolved"), 16: (2, "unverified"), 17: (None, "unanchored"), 18: (None, "unanchored")}
    assert by[11].headers == {"etag": 'W/"v1"', "content-type": "text/html", "date": "d2"} and by[11].payload_digest == "D1" and by[11].canonical_url == "example.org/a?a=1&b=2"
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_of_clashing_records(spark):
    """Ids that two URLs share, equal responses, responses without an id, and columns with names from within."""
    rows = [
        record(1, "http://a.org/", 10, headers={"etag": "x", "server": "a"}, digest="A"),
        record(1, "http://b.org/", 10, headers={"etag": "y", "server": "b"}, digest="B"),
        record(2, "http://a.org/", 20, headers={"etag": "x1", "server": "s"}, digest="C"),
        record(2, "http://a.org/", 20, headers={"etag": "x2", "server": "s"}, digest="C"),
        record(None, "http://a.org/", 25, headers={"etag": "x3"}, digest="D"),
        record(5, "http://a.org/", 15, "revisit", 304, {"etag": "x"}),
        record(6, "http://b.org/", 15, "revisit", 304, {"etag": "x"}),
        record(7, "http://a.org/", 30, "revisit", 304, {"etag": "x2"}),
    ]
    df = spark.createDataFrame(rows, RECORD)
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("key", "found", "cuts", "block", "asked", "n", "response", "stored_digest"))])
    by = {r.record_id: r for r in revisits.resolve_revisits(df).collect()}
    assert {k: (r.response_id, r.outcome, r.payload_digest) for k, r in by.items()} == {5: (1, "resolved", "A"), 6: (1, "mismatch", None), 7: (2, "resolved", "C")}
    assert by[5].headers["server"] == "a" and by[7].headers["server"] == "s"


def test_revisits_of_a_hot_url_in_blocks(spark):
    r = random.Random(8)
    rows = [record(i, r.choice(["http://hot.org/", "http://hot.org", "http://cold.org/x"]), r.randrange(400), r.choice(["response", "revisit", "revisit"]), 200, {}, "d") for i in range(600)]
    want = {}
    for i, u, ts, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, v, t, k, *_ in rows if k == "response" and v.rstrip("/") == u.rstrip("/") and t < ts]
            want[i] = max(earlier)[1] if earlier else None
    for hot in (50, 10**6):
        got = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD), hot_points=hot, blocks=8).collect()
        assert {x.record_id: x.response_id for x in got} == want


WRAPPED = [
    "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# print 1",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions of source code must retain the notice.",
]


def test_wrapped_licenses(spark):
    texts = [*WRAPPED, "\n\n".join(WRAPPED), "it was late\nin the town\n" + WRAPPED[2].replace(" ", "\n"), "Released\n\nunder the MIT\n\nLicense.", "Released under the\r\nMIT License.\nReleased under the MIT License."]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.families for r in found] == ["mit", "gpl", "bsd", "bsd,gpl,mit", "bsd", "", "mit"]
    assert [r.n_confirmed for r in found] == [1, 1, 1, 3, 1, 0, 1] and all(r.n_predicted >= r.n_confirmed for r in found)


def plain_scan(text, model):
    """(family, probability) of every line that is predicted, each line scored by all of its features."""
    out = []
    for line in text.split("\n"):
        w = license_model.words(line)
        found = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
        scores = [b + sum(model.weights[f][k] for f in found if f in model.weights) for k, b in enumerate(model.bias)]
        chance = np.exp((np.array(scores) - max(scores)) / license_model.SCALE)
        best = int(np.argmax(scores))
        if best and 1 / chance.sum() >= model.threshold:
            out.append(model.families[best])
    return out


def test_every_line_is_scored(spark):
    """Also lines of common words only, which no telling word would announce."""
    model, r = license_model.trained(), random.Random(3)
    texts = ["provided that the following are met: use in source and binary forms, with or without"]
    pool = sorted({x for f in model.weights for x in f.split()})
    texts += ["\n\n".join(" ".join(r.choice(pool) for _ in range(r.randrange(1, 12))) for _ in range(5)) for _ in range(60)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_predicted for x in found} == {i: len(plain_scan(t, model)) for i, t in enumerate(texts)}
    assert found[0].n_predicted or any(x.n_predicted for x in found)


def test_licenses_outside_the_families(spark):
    assert not any(license_model.features(h) in [license_model.features(t) for ts in (*license_model.NOTICES.values(), license_model.PLAIN) for t in ts] for h in license_model.HELD_OUT)
    texts = [
        *license_model.HELD_OUT,
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation",
        "Some rights reserved.",
        "Licensed under the Frobnitz License, Version 2.0.",
    ]
    found = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {texts[r.doc_id]: r.families for r in found if r.families} == {}
    known = [(f, t) for f, ts in license_model.NOTICES.items() for t in ts]
    found = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(known)], "doc_id long, text string")).collect()
    assert all(r.families == known[r.doc_id][0] for r in found)


def plain_difference(lengths, windows):
    """Multiway differencing as lists of (sum, pieces), without a heap."""
    parts = [sorted([(0, ())] * (windows - 1) + [(n, (i,))]) for i, n in sorted(enumerate(lengths), key=lambda x: -x[1])]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b, *parts = parts
        parts.append(sorted((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))))
    return sorted(s for s, _ in parts[0])


def test_differencing_is_as_even_as_a_plain_one():
    r = random.Random(11)
    for _ in range(40):
        lengths = np.array([r.randrange(1, 900) for _ in range(r.randrange(1, 14))])
        windows = r.randrange(1, 5)
        got = sorted(int(lengths[w].sum()) for w in packing.difference(lengths, windows))
        want = plain_difference(lengths.tolist(), windows)
        assert sum(got) == sum(want) and got[-1] - got[0] <= max(lengths) and abs((got[-1] - got[0]) - (want[-1] - want[0])) <= max(lengths) / 2


def test_pack_of_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(230))
    repeated = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    found = packing.pack_documents(repeated, tokenizer_path())
    n = len(library([text])[0]) + 1
    total, sequences = found.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total == 20_000 * n and total / 1024 / sequences > 0.95
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pack_of_short_texts(spark):
    texts = [(i, f"w{i % 90}" if i % 5 else None) for i in range(9000)]
    found = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path()).collect()
    assert len(found) == 9000
    ids = sum(r.length for r in found)
    assert ids / 1024 / len({r.sequence_id for r in found}) > 0.95
