"""Secrets, ranked search and the filter audit against plain versions, and what they make of odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loglattice.llm import filter_audit, lexical_search, secret_scan
from loglattice.llm.common import Workspace

from . import brute
from .conftest import CLASHES, PROSE, SCHEMA

ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text, model):
    """(kind, begin, end) of every span, plainly."""
    text = text or ""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = [("markov", *m.span()) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and model.score(m[0]) >= model.threshold]
    more = [x for x in more if not any(b <= x[1] and e >= x[2] for _, b, e in base)]
    return sorted(base + more, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PIECES = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " = ", '"', "'", " ", "\n", "\t", "é", "日本", "🙂", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "x", "Zq8fK2nVw0RtYb5LmJc7", "kX9/+Lp2vQe-8_sD", "under_score_name", "abcdefghijkl", "aaaaaaaaaaa", "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=5))
def test_secrets_of_any_text(texts):
    model = secret_scan.trained()
    found = secret_scan.Finder(model).rows(pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())).to_pylist()
    for r, text in zip(found, texts, strict=True):
        want = secrets(text, model)
        assert r["spans"] == told(want)
        assert r["base_sha256"] == hashlib.sha256(told(x for x in want if x[0] != "markov").encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secret_scan.KINDS] == [sum(x[0] == k for x in want) for k in secret_scan.KINDS]


def test_a_failing_match_takes_up_its_text():
    model = secret_scan.trained()
    text = "secret: token = abcdefghijklmnop; token = abcdefghijklmnop"
    assert [x[:2] for x in secrets(text, model)] == [("assign", 34)]


def test_models_tell_random_from_ordinary():
    model = secret_scan.trained()
    fresh = secret_scan.labelled(2000, seed=77)
    caught = [model.score(s) >= model.threshold for s, label in fresh if label]
    wrong = [model.score(s) >= model.threshold for s, label in fresh if not label]
    assert sum(caught) / len(caught) >= 0.99
    assert sum(wrong) / len(wrong) <= 0.005


def test_models_counted_on_executors_are_the_same(spark):
    samples = [*secret_scan.labelled(300, 5), ("", True), ("x", False), ("a b", True), (None, True)]
    frame = spark.createDataFrame(samples, "text string, random boolean")
    assert secret_scan.pairs_in(frame) == secret_scan.pairs_of((s, label) for s, label in samples if s)
    held = secret_scan.labelled(300, 6)
    assert secret_scan.train(frame, held) == secret_scan.model_of(secret_scan.pairs_of((s, label) for s, label in samples if s), held)


def test_find_secrets(spark, docs, rows, odd, empty):
    model = secret_scan.trained()
    r = random.Random(3)
    key = "".join(r.choices(secret_scan.TOKENS[3], k=40))
    more = [(1000 + i, t, "en", "a", 1) for i, t in enumerate([f"key {key} end", f'{"é " * 50}token = "{"f0" * 20}" x', "x" * 70_000 + f" {key} " + "AKIA" + "Q" * 16, None, ""])]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    got = {x.doc_id: x for x in secret_scan.find_secrets(both).collect()}
    assert len(got) == len(rows) + len(more)
    for k, t, *_ in [*rows, *more]:
        assert got[k].spans == told(secrets(t, model))
    assert got[1000].n_markov == 1 and got[1002].n_access == 1
    assert Counter((x.doc_id, x.spans) for x in secret_scan.find_secrets(odd).collect()) == Counter((x.doc_id, told(secrets(x.text, model))) for x in odd.collect())
    assert secret_scan.find_secrets(empty).count() == 0
    clean = secret_scan.redact(both, model)
    assert clean.columns == both.columns
    texts = {x.doc_id: x.text for x in clean.collect()}
    assert texts[1000] == "key [SECRET] end" and texts[1003] is None and key not in texts[1002]
    assert secret_scan.find_secrets(clean).agg({"n_hex": "sum", "n_access": "sum", "n_markov": "sum"}).first().asDict() == {"sum(n_hex)": 0, "sum(n_access)": 0, "sum(n_markov)": 0}


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(brute.lower(text))


def ranked(rows, items, k=20):
    """[(item_id, rank, doc_id, score)] for rows with known or null keys."""
    counted = [(key, Counter(own), len(own)) for key, t in rows if (own := terms(t))]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, own, _ in counted for t in own)
    out = []
    for item, text in items:
        scores = []
        for key, own, n in counted:
            m = 75 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * own[t] // (1000 * own[t] + 12 * m)) for t in terms(text) if t in own)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:k])]
    return out


def items_of(r, n=25):
    items = [(i, " ".join(r.choice(PROSE).title() + str(r.randrange(45)) for _ in range(r.randrange(1, 30)))) for i in range(n)]
    return [*items, (n, None), (n + 1, ""), (n + 2, "..."), (n + 3, items[0][1]), (None, "quick fox"), (n + 4, "word word word Ünknown ß 日本語")]


@pytest.mark.parametrize(("shard_bytes", "block_bytes"), [(8 << 20, 8 << 20), (2000, 2000), (1, 1000)])
def test_ranked_search(spark, docs, rows, shard_bytes, block_bytes):
    items = items_of(random.Random(4), 25 if block_bytes > 1000 else 4)
    table = spark.createDataFrame(items, "item_id long, text string")
    index = Workspace(spark).put(lexical_search.build_index(docs, shard_bytes=shard_bytes))
    got = lexical_search.search(index, table, 20, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked([(r[0], r[1]) for r in rows], items)
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_ranked_search_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "same row"), (2, "text"), (3, "nothing here at all")], "item_id long, text string").selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(CLASHES)], "'x' AS place")
    got = lexical_search.ranked_search(odd, items)
    want = ranked([(x.doc_id, x.text) for x in odd.collect()], [(1, "same row"), (2, "text"), (3, "nothing here at all")])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert lexical_search.ranked_search(empty, items).count() == 0
    assert lexical_search.ranked_search(odd, items.limit(0)).count() == 0


def test_equal_scores_and_many_copies(spark):
    """Ties are cut by doc_id even where one shard holds far more than k of them."""
    r = random.Random(8)
    keys = list(range(3000))
    r.shuffle(keys)
    rows = [(k, "red apple pie") for k in keys[:2000]] + [(k, "green apple tart " + "x " * r.randrange(9)) for k in keys[2000:2900]] + [(k, "red red wine") for k in keys[2900:]]
    items = [(1, "red"), (2, "apple red"), (3, "red wine apple"), (4, "pie pie pie")]
    got = lexical_search.ranked_search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(ranked(rows, items))


def test_non_essential_lists_are_only_probed():
    """A common, weak term's list isn't gone through once enough better documents are known."""
    n = 500
    header = {"docs": np.arange(n, dtype="<i8").tobytes(), "known": np.ones(n, np.uint8).tobytes(), "counts": np.full(n, 10, "<i8").tobytes()}
    every = {"number": 0, "docs": np.arange(n, dtype="<i4").tobytes(), "counts": np.ones(n, "<i4").tobytes()}
    rare = {"number": 1, "docs": np.arange(0, 100, dtype="<i4").tobytes(), "counts": np.ones(100, "<i4").tobytes()}
    shard = lexical_search.Shard(header, [every, rare], [5, 3000], n, 10 * n)
    best, query = lexical_search.Best(20), lexical_search.Query([0, 1], [1, 1])
    shard.search(query, best)
    first = list(best.rows)
    assert [r[2] for r in first] == list(range(20))

    class Untouched(dict):
        def __getitem__(self, key):
            assert key != 0, "the weak list is not needed: no document of the rare one can still come in"
            return super().__getitem__(key)

    shard.most[1] = best.floor - 1
    shard.places, shard.adds = Untouched(shard.places), Untouched(shard.adds)
    shard.most[0] = 0
    shard.search(query, best)
    assert best.rows == first


def audit(rows, labels):
    """(part, order, step) -> counts, document by document."""
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    first = defaultdict(list)
    for k, t, _ in rows:
        if k is not None:
            first[t or ""].append(k)
    fails = []
    for k, t, part in rows:
        t = t or ""
        w = brute.words(t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and min(first[t]) < k}
        fails.append((part or "", {x for x in own if own[x]}, k in good and k is not None, k in toxic and k is not None))
    out, shapley = {}, Counter()
    for p in permutations("ABCDE"):
        for part in {x[0] for x in fails}:
            left = [x for x in fails if x[0] == part]
            gone = []
            for s, f in enumerate(p):
                hit = [x for x in left if f in x[1]]
                again = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                shapley[part, f] += len(hit)
                out[part, "".join(p), s + 1] = [len(left), len(hit), again, sum(x[0] == part and x[1] == {f} for x in fails), sum(x[2] for x in hit), sum(x[3] for x in hit)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, rows, odd, empty):
    r = random.Random(6)
    table = [(k, t, r.choice(["en", "de", None, ""]) if i % 3 else "en") for i, (k, t, *_) in enumerate(rows)]
    table += [(500, "same", "en"), (500, "same", "en"), (501, "same", "de"), (None, "same", "en"), (None, None, None), (502, " ".join(f"w{i}" for i in range(300)), "fr"), (503, "AB " * 300, "fr")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k, *_ in table if k is not None and r.random() < 0.6] + [(500, 0, 1), (500, 1, 0), (None, 1, 1), (9999, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = filter_audit.filter_audit(frame.repartition(4), said).collect()
    assert len(got) == 600 * len({x[2] or "" for x in table})
    assert {tuple(x) for x in got} == audit(table, labels)
    assert {tuple(x) for x in filter_audit.filter_audit(odd, said).collect()} == audit([(x.doc_id, x.text, x.lang) for x in odd.collect()], labels)
    assert filter_audit.filter_audit(empty, said).count() == 0
    none = {tuple(x) for x in filter_audit.filter_audit(frame, said.limit(0)).collect()}
    assert none == audit(table, [])


def test_matrices_are_consistent():
    by, share = filter_audit.incidence(), filter_audit.shares()
    assert all(m.shape == (32, 600) for m in by.values())
    assert (share.sum(axis=1) % 120 == 0).all() and (by["kept"][0] == 1).all()
    masks = np.arange(32)
    for o in range(120):
        assert (by["removed"][:, o * 5 : o * 5 + 5].sum(axis=1) + by["kept"][:, o * 5 + 4] == 1).all()
    assert (by["unique_fails"].sum(axis=1) == np.where((masks & (masks - 1) == 0) & (masks > 0), 120, 0)).all()


def test_many_copies_of_one_text(spark):
    """A third of all rows share a text, many of them a key too."""
    rows = [(i % 700, "copied text", "en") for i in range(4000)] + [(i, f"own text {i} " * (i % 90), "de") for i in range(2000)]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6), spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int"))
    some = {tuple(x) for x in got.where("filter_order IN ('ABCDE', 'EDCBA')").collect()}
    assert some == {x for x in audit(rows, [(3, 1, 1)]) if x[1] in ("ABCDE", "EDCBA")}
