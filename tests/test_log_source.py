"""The log source: ranges of bytes, numbers of lines, filters on the listing, files written and read again."""

from __future__ import annotations

import json
import os
import random

import pytest
from loglattice.sources import log_source, logs


def plain(data: bytes):
    """(n_lines, [(line_no, text)]) of a file."""
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    shown = [i for i, x in enumerate(lines) if x.strip()]
    return max(shown, default=0) + 1, [(i, x.decode("utf-8", "replace")) for i, x in enumerate(lines)]


def odd_files(r):
    text = "\n".join("".join(r.choice("ab é日{}\t") for _ in range(r.choice([0, 1, 3, 40]))) for _ in range(60))
    return {
        "a/plain.jsonl": b"one\ntwo\nthree",
        "a/ended.jsonl": b"one\ntwo\n\n  \n",
        "a/empty.jsonl": b"",
        "a/feeds.jsonl": b"\n\n\n\n\n\n\n\n\n",
        "b/long.jsonl": b"x" * 300 + b"\n" + b"y" * 5 + b"\n" + b"z" * 400,
        "b/mixed.jsonl": text.encode(),
        "b/bad.jsonl": b"\xff\xfe\nfine\r\n\xe6\x97",
        "b/note.txt": b"not a log",
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("ranges")
    for name, data in odd_files(random.Random(3)).items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(data)
    return top


@pytest.mark.parametrize("split", [1, 2, 7, 64, 10_000])
def test_every_line_lies_in_one_range(folder, split, monkeypatch):
    monkeypatch.setattr(log_source, "CHUNK", 16)
    for name, data in odd_files(random.Random(3)).items():
        if name.endswith(".jsonl"):
            (f,) = [x for x in log_source.listed(str(folder)) if x.path.endswith(name)]
            found = [line for part in log_source.ranges_of([f], split) for line in log_source.lines_in(part)]
            assert [x.decode("utf-8", "replace") for x in found] == [x for _, x in plain(data)[1]], (name, split)


@pytest.mark.parametrize("split", [5, 50, 1 << 20])
def test_numbers_are_the_same_at_any_split(spark, folder, split):
    got = {}
    for r in logs.numbered(spark, "claude", str(folder), split).collect():
        got.setdefault(r.file_path.split("/ranges")[1].split("/", 1)[1], []).append((r.n_lines, r.line_no, r.line))
    want = {name: [(plain(d)[0], i, x) for i, x in plain(d)[1]] for name, d in odd_files(random.Random(3)).items() if name.endswith(".jsonl") and d}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_small_files_share_partitions_and_large_ones_are_cut():
    files = [log_source.File(f"/f{i}", size, None) for i, size in enumerate([10, 1 << 20, 5, 0, 3 << 20, 7])]
    parts = [[(r.file.path, r.begin, r.end) for r in p.value] for p in log_source.dealt(log_source.ranges_of(files, 1 << 20), 1 << 20)]
    assert parts == [[("/f0", 0, 10)], [("/f1", 0, 1 << 20)], [("/f2", 0, 5)], *[[("/f4", i << 20, i + 1 << 20)] for i in range(3)], [("/f5", 0, 7)]]
    many = log_source.dealt([log_source.Range(log_source.File(str(i), 100, None), 0, 100) for i in range(1000)], 1 << 20)
    assert sum(len(p.value) for p in many) == 1000 and 55 <= len(many) <= 65


def test_patterns_enter_only_their_folders(tmp_path):
    for name in ("p/s.jsonl", "p/s/subagents/h.jsonl", "q/deep/er/x.jsonl", "top.jsonl", "p/other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")

    def names(pattern):
        return [f.path[len(f"file://{tmp_path}/") :] for f in log_source.listed(str(tmp_path), pattern)]

    assert names("*/*.jsonl") == ["p/s.jsonl"]
    assert names("q*/*.jsonl") == [] and names("*/*/subagents/*.jsonl") == ["p/s/subagents/h.jsonl"]
    assert names("**") == ["p/s.jsonl", "p/s/subagents/h.jsonl", "q/deep/er/x.jsonl", "top.jsonl"]
    assert log_source.listed(str(tmp_path / "none")) == []
    assert log_source.listed(f"file:{tmp_path}", "*.jsonl")[0].path == f"file://{tmp_path}/top.jsonl"


def test_options_choose_files_before_any_is_opened(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}" / f"{i}.jsonl").write_text("{}\n" * (i + 1))
        os.utime(tmp_path / f"d{i % 2}" / f"{i}.jsonl", (1_700_000_000 + i,) * 2)
    log_source.register(spark)

    def of(**options):
        return spark.read.format("agent_logs").options(tool="pi", **options).load(str(tmp_path))

    some = of(pattern="d1/*.jsonl", larger="6")
    assert some.count() == 4 + 6
    assert some.rdd.getNumPartitions() == 1  # small files share a partition
    assert of(newer="2023-11-14T22:13:23+00:00").count() == 5 + 6
    both = of().where("tool = 'codex'").unionByName(of().where("tool = 'pi'"))
    assert both.count() == 21
    frame = of()
    assert frame.where("tool = 'codex'").unionByName(frame.where("tool = 'pi'")).count() == 21


def test_written_files_are_read_again(spark, tmp_path):
    rows = [(f"p{k % 3}/{k}.jsonl", i, json.dumps({"k": k, "i": i, "x": "é\n" * (i % 4)})) for k in range(20) for i in range(30)]
    random.Random(1).shuffle(rows)
    log_source.write_logs(spark.createDataFrame(rows, "file_path string, line_no int, line string").repartition(5), f"file://{tmp_path}/out")
    assert not list(tmp_path.glob("out/**/.*"))
    got = logs.raw_lines(spark, {"claude": f"file://{tmp_path}/out"}, split_bytes=100).selectExpr("try_variant_get(v, '$.k', 'int') k", "try_variant_get(v, '$.i', 'int') i", "line_no", "n_lines", "regexp_extract(file_path, '([0-9]+).jsonl', 1) f").collect()
    assert len(got) == 600 and all(r.i == r.line_no and r.n_lines == 30 and str(r.k) == r.f for r in got)
