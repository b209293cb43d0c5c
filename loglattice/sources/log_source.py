"""Log files as a data source: ``spark.read.format("agent_logs")``, and the same to follow them and to write them.

A file is cut into ranges of bytes, each a partition; a line belongs to the
range in which it starts, wherever it ends. Rows name their range (``block``)
and their place in it (``k``), so numbers of lines follow from counts by range
(``format("agent_log_blocks")``). A stream's offsets are bytes read by file,
so files that grow are read on from where they were left.

Options: ``tool`` (a name for the rows), ``pattern`` (how paths below the root
look, folder by folder; ``**`` is any depth), ``newer`` and ``larger`` (only
files changed after a time, of more bytes), ``split_bytes`` (``all``: no file is cut), ``sizes`` (only
files of ``one`` range or of ``many``), ``listed_in`` (a folder of text files
that name the files, in place of a listing). They choose files before any is opened. Files are opened by
``pyarrow.fs``, so any store that it knows will do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SPLIT_BYTES = 64 << 20
#: What opening a file counts for where small files share a partition.
OPEN_BYTES = 64 << 10
#: Bytes of lines in one batch of rows.
BATCH_BYTES = 4 << 20
CHUNK = 1 << 20
LINES = "tool string, file_path string, file_size long, mtime timestamp, block long, k int, n_block int, shown int, line string"
BLOCKS = "file_path string, block long, n int, shown int"
FILES = "tool string, file_path string, mtime timestamp, size long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme is local."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    if re.match(r"file:/(?!//)", uri):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _named(uri: str, path: str) -> str:
    """The path of a found file, with the scheme of the root."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if scheme is None or scheme[1] == "file":
        return "file://" + path
    host = re.match(r"[^:]+://([^/]*)", uri)
    inside = scheme[1] in ("s3", "s3a", "gs", "abfs", "abfss")  # there a path in the store begins with the bucket
    return f"{scheme[1]}://{path}" if inside else f"{scheme[1]}://{host[1] if host else ''}{path}"


@dataclass(frozen=True)
class File:
    path: str
    size: int
    mtime: datetime


def listed(root: str, pattern: str = "**") -> list[File]:
    """The ``.jsonl`` files below ``root``; folders that the pattern excludes aren't entered, a missing root has none."""
    store, top = opened(root)
    parts = None if pattern == "**" else pattern.split("/")
    found, level, depth = [], [top], 0
    while level:
        below = []
        for folder in level:
            for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                last = parts is None or depth == len(parts) - 1
                fits = parts is None or fnmatchcase(info.base_name, parts[depth])
                if info.type == fs.FileType.Directory and (parts is None or fits and not last):
                    below.append(info.path)
                elif info.type == fs.FileType.File and last and fits and info.base_name.endswith(".jsonl"):
                    found.append(File(_named(root, info.path), info.size, info.mtime or datetime.fromtimestamp(0, timezone.utc)))
        level, depth = below, depth + 1
    return sorted(found, key=lambda f: f.path)


@dataclass(frozen=True)
class Range:
    """Bytes of a file: lines that start in [begin, end)."""

    file: File
    begin: int
    end: int


def chosen(options: dict[str, str]) -> list[File]:
    """The files that a reader's options name."""
    if "listed_in" in options:
        found = []
        store, top = opened(options["listed_in"])
        lists = [i.path for i in store.get_file_info(fs.FileSelector(top)) if i.base_name.startswith("part-")]
        for path in (line for x in sorted(lists) for line in store.open_input_file(x).read().decode().splitlines()):
            store, at = opened(path)
            info = store.get_file_info(at)
            if info.type == fs.FileType.File:
                found.append(File(path, info.size, info.mtime))
    else:
        found = listed(options["path"], options.get("pattern", "**"))
    newer, larger = options.get("newer"), options.get("larger")
    after = None if newer is None else datetime.fromisoformat(newer).astimezone(timezone.utc)
    return [f for f in found if (after is None or f.mtime > after) and (larger is None or f.size > int(larger))]


def largest(options: dict[str, str]) -> int:
    """Bytes of the largest of these files."""
    return max((f.size for f in chosen(options)), default=0)


def ranges_of(files: list[File], split: int, sizes: str | None = None, begin: dict[str, int] | None = None, end: dict[str, int] | None = None) -> list[Range]:
    out = []
    for f in files:
        a, b = (begin or {}).get(f.path, 0), f.size if end is None else end[f.path]
        if sizes is None or (sizes == "one") == (b - a <= split):
            out += [Range(f, x, min(x + split, b)) for x in range(a, b, split)]
    return out


def dealt(ranges: list[Range], split: int) -> list[InputPartition]:
    """Partitions of about ``split`` bytes: a range, or many small files."""
    out, size = [], 0
    for r in ranges:
        own = r.end - r.begin + OPEN_BYTES
        if not out or size + own > split + OPEN_BYTES:
            out.append([])
            size = 0
        out[-1].append(r)
        size += own
    return [InputPartition(x) for x in out]


def ranges_in(partition: InputPartition | None) -> list[Range]:
    """A partition's ranges; Spark asks for none at all where there are no files."""
    return partition.value if partition is not None else []


def lines_in(part: Range) -> Iterator[bytes]:
    """Lines that start in the range, without their line feed; memory is a chunk and a line."""
    store, path = opened(part.file.path)
    with store.open_input_file(path) as source:
        at, rest = max(part.begin - 1, 0), b""
        skip = part.begin > 0  # until after the line feed at or behind begin - 1
        source.seek(at)
        while at < part.end or rest:
            chunk = source.read(CHUNK if at < part.end else CHUNK // 4)
            if not chunk:
                if rest and not skip:
                    yield rest
                return
            if skip:
                cut = chunk.find(b"\n", 0, max(0, part.end - 1 - at))
                if cut < 0:
                    at += len(chunk)
                    if at >= part.end - 1:
                        return  # no line starts in the range
                    continue
                skip, at, chunk = False, at + cut + 1, chunk[cut + 1 :]
            start = at - len(rest)  # where the line begins that is being gathered
            *whole, tail = (rest + chunk).split(b"\n")
            at += len(chunk)
            for line in whole:
                if start >= part.end:
                    return
                yield line
                start += len(line) + 1
            if start >= part.end:
                return
            rest = tail
            if not rest and at >= part.end:
                return


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    """What batches of lines, of counts and of files share: the listing.

    ``pushFilters`` is left out on purpose. Spark 4.1 plans a source's
    partitions once for a frame, so a frame that is read twice with different
    filters (as each tool's events do) got the first one's files for both.
    Options say the same and belong to one frame.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        files, split = chosen(self.options), self.options.get("split_bytes", SPLIT_BYTES)
        if split == "all":
            return dealt([Range(f, 0, f.size) for f in files if f.size], SPLIT_BYTES)
        return dealt(ranges_of(files, int(split), self.options.get("sizes")), max(int(split), SPLIT_BYTES))


def _batches(part: Range, tool: str) -> Iterator[pa.RecordBatch]:
    """Rows of the lines in a range; all of them know how many lines the range has and which is its last with anything to see."""
    n = shown = -1
    for n, line in enumerate(lines_in(part)):
        if line.strip():
            shown = n
    if n < 0:
        return
    schema = pa.schema([("tool", pa.string()), ("file_path", pa.string()), ("file_size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("block", pa.int64()), ("k", pa.int32()), ("n_block", pa.int32()), ("shown", pa.int32()), ("line", pa.string())])

    def rows(first: int, held: list[str]) -> pa.RecordBatch:
        m = len(held)
        same = [pa.array([x] * m, t) for x, t in ((tool, pa.string()), (part.file.path, pa.string()), (part.file.size, pa.int64()), (part.file.mtime, pa.timestamp("us", "UTC")), (part.begin, pa.int64()))]
        return pa.RecordBatch.from_arrays([*same, pa.array(range(first, first + m), pa.int32()), pa.array([n + 1] * m, pa.int32()), pa.array([shown] * m, pa.int32()), pa.array(held, pa.string())], schema=schema)

    first, held, size = 0, [], 0
    for line in lines_in(part):
        held.append(_text(line))
        size += len(line) + 64
        if size > BATCH_BYTES:
            yield rows(first, held)
            first, held, size = first + len(held), [], 0
    if held:
        yield rows(first, held)


class LineReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for part in ranges_in(partition):
            yield from _batches(part, self.options.get("tool", ""))


class BlockReader(_Reader):
    def read(self, partition: InputPartition):
        for part in ranges_in(partition):
            n = shown = -1
            for n, line in enumerate(lines_in(part)):
                if line.strip():
                    shown = n
            if n >= 0:
                yield part.file.path, part.begin, n + 1, shown


class FileReader(_Reader):
    """The listing alone: no file is opened."""

    def partitions(self):
        found = chosen(self.options)
        return [InputPartition(found[i : i + 10_000]) for i in range(0, len(found), 10_000)]

    def read(self, partition: InputPartition):
        for f in partition.value if partition else []:
            yield self.options.get("tool", ""), f.path, f.mtime, f.size


def _complete(path: str, size: int, known: int) -> int:
    """Bytes up to the last line feed, looked for from the end, not before what is known."""
    store, at = opened(path)
    with store.open_input_file(at) as source:
        end = size
        while end > known:
            begin = max(known, end - CHUNK)
            source.seek(begin)
            cut = source.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return known


class Follower(DataSourceStreamReader):
    """Follows files that appear and grow. An offset holds the bytes read of every file, whole lines only; a file that shrank is read anew."""

    def __init__(self, options: dict[str, str]):
        self.options, self.last = options, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for f in listed(self.options["path"], self.options.get("pattern", "**")):
            size, upto = self.last.get(f.path, (0, 0))
            known = upto if f.size >= size else 0
            out[f.path] = known if f.size == size else _complete(f.path, f.size, known)
            self.last[f.path] = (f.size, out[f.path])
        return out

    def partitions(self, start: dict, end: dict):
        begin = {path: start.get(path, 0) if start.get(path, 0) <= upto else 0 for path, upto in end.items()}
        grown = []
        for path in (p for p, upto in end.items() if upto > begin[p]):
            store, at = opened(path)
            grown.append(File(path, end[path], store.get_file_info(at).mtime or datetime.fromtimestamp(0, timezone.utc)))
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        return dealt(ranges_of(grown, split, None, begin, end), max(split, SPLIT_BYTES))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for part in ranges_in(partition):
            yield from _batches(part, self.options.get("tool", ""))


@dataclass
class Written(WriterCommitMessage):
    files: int


class LineWriter(DataSourceArrowWriter):
    """Writes rows (file_path, line) as lines; a file's rows stand together in one partition. A file appears whole or not at all."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = opened(self.root)
        path, out, part, n = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, path)

        for batch in iterator:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{top.rstrip('/')}/{name}"
                if at != path:
                    close()
                    folder, _, base = at.rpartition("/")
                    store.create_dir(folder)
                    path, part, n = at, f"{folder}/.{base}.{uuid.uuid4().hex}", n + 1
                    out = store.open_output_stream(part)
                out.write((line or "").encode() + b"\n")
        close()
        return Written(n)


class AgentLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_logs"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))

    def streamReader(self, schema) -> Follower:  # noqa: N802
        return Follower(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


class AgentLogBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_log_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


class AgentLogFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_log_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """All sources by name; registering again changes nothing."""
    for source in (AgentLogs, AgentLogBlocks, AgentLogFiles):
        spark.dataSource.register(source)


def write_logs(rows: DataFrame, root: str) -> None:
    """Writes (file_path, line_no, line) as files below ``root``, each by one task in order of its lines."""
    register(rows.sparkSession)
    dealt = rows.select("file_path", "line_no", "line").repartition("file_path").sortWithinPartitions("file_path", "line_no")
    dealt.select("file_path", "line").write.format("agent_logs").mode("append").save(root)
