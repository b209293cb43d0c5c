"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch lie one after another in one flat array of symbols. In
each round every sequence looks for its lowest-rank adjacent pair and merges
all its occurrences, all sequences at once; sequences without a mergeable pair
leave with the number of symbols that survived. A merge can only make pairs of
higher rank than its own, so merging all occurrences of a sequence's lowest
pair at once gives what one-at-a-time merging gives.

A round passes over all symbols of its sequences. Sequences that are long
enough for that to matter go by themselves: the places of each pair are kept
by rank, so a round touches only the occurrences it merges and their
neighbours.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, cut, flat, shared_blank
from .common import steps, text_or_empty

#: Fixed values of byte-level BPE: the pre-token pattern of its public vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NO_RANK = np.int64(1) << 40
#: Symbols below this have their pairs in a dense table; pairs of others are found by bisection.
DENSE = 2048
#: Pre-tokens that are merged together; bounds the arrays.
BLOCK = 1 << 17
#: Symbols from which on a sequence keeps its pairs by rank.
LONG = 2048


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """Refuses a vocabulary whose rules are not those that are written here."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    bare = not any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip"))
    if not (model.get("type", "BPE") == "BPE" and plain and split and bare and not spec.get("normalizer")):
        raise ValueError("only byte-level BPE without a normalizer, prefix space or dropout is supported")


class RaggedMerger:
    """Merge tables of a vocabulary as sorted arrays, and the synchronous merge itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_alphabet()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], np.arange(len(key))[order], made[order]
        left, right = self.key // self.width, self.key % self.width
        both = np.flatnonzero((left < DENSE) & (right < DENSE))
        self.dense = np.full(DENSE * DENSE, -1, np.int32)
        self.dense[left[both] * DENSE + right[both]] = both

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the tables, or -1."""
        low = (a < DENSE) & (b < DENSE)
        out = np.where(low, self.dense[np.where(low, a * DENSE + b, 0)], -1).astype(np.int64)
        rest = np.flatnonzero(~low)
        if len(rest):
            key = a[rest] * self.width + b[rest]
            found = np.searchsorted(self.key, key)
            found[found == len(self.key)] = 0
            out[rest] = np.where(self.key[found] == key, found, -1)
        return out

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token; none may be empty."""
        long = np.fromiter((len(p) >= LONG for p in pretokens), bool, len(pretokens))
        out = np.zeros(len(pretokens), np.int64)
        for i in np.flatnonzero(long):
            out[i] = self.count_long(pretokens[i])
        if not long.all():
            out[~long] = self._count([p for p, far in zip(pretokens, long, strict=True) if not far])
        return out

    def count_long(self, pretoken: bytes) -> int:
        """As ``count`` for one long sequence: symbols are linked to their neighbours, and the places of pairs wait by rank."""
        symbols = self.of_byte[np.frombuffer(pretoken, np.uint8)]
        n = len(symbols)
        after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        own = np.full(n, NO_RANK)  # rank of the pair that starts at each place
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(places: np.ndarray) -> None:
            """Ranks the pairs that start at ``places`` anew."""
            ends = after[places] >= n
            own[places[ends]] = NO_RANK
            places = places[~ends]
            at = self._pairs(symbols[places], symbols[after[places]])
            rank = np.where(at >= 0, self.rank[at], NO_RANK)
            own[places] = rank
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(rank)], strict=True):
                r = int(rank[a])
                if r < NO_RANK:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(places[a:b])

        look(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[live[places] & (own[places] == r)]
            if not len(places):
                continue
            run = np.r_[True, places[1:] != after[places[:-1]]]  # of overlapping occurrences every second one, from the left
            first = np.flatnonzero(run)[np.cumsum(run) - 1]
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[self._pairs(symbols[places[:1]], symbols[gone[:1]])]
            live[gone] = False
            own[gone] = NO_RANK
            after[places] = after[gone]
            follows = after[places] < n
            before[after[places[follows]]] = places[follows]
            touched = np.concatenate([places, before[places]])
            look(np.unique(touched[touched >= 0]))
        return int(live.sum())

    def _count(self, pretokens: list[bytes]) -> np.ndarray:
        left = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        out = np.zeros(len(pretokens), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.arange(len(pretokens))
        while len(owner):
            ends = np.cumsum(left)
            starts = ends - left
            at = np.full(len(symbols), -1, np.int64)
            if len(symbols) > 1:
                at[:-1] = self._pairs(symbols[:-1], symbols[1:])
                at[ends[:-1] - 1] = -1  # the next symbol is another pre-token's
            rank = np.where(at >= 0, self.rank[at], NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest < NO_RANK
            out[owner[~alive]] = left[~alive]
            chosen = rank == np.repeat(np.where(alive, lowest, -1), left)
            places = np.flatnonzero(chosen)
            if len(places):  # of overlapping occurrences (x x x) every second one, from the left
                new_run = np.r_[True, np.diff(places) > 1]
                run_start = places[np.flatnonzero(new_run)[np.cumsum(new_run) - 1]]
                places = places[(places - run_start) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = np.repeat(alive, left)
            keep[places + 1] = False
            left = np.add.reduceat(keep.astype(np.int64), starts)[alive]
            symbols, owner = symbols[keep], owner[alive]
        return out


class TokenCounter:
    """Counts tokens of texts; remembers distinct chunks and distinct pre-tokens between batches."""

    def __init__(self, path: str, limit: int = 400_000):
        self.merger = RaggedMerger(path)
        # of special strings that start at one place the longest counts
        special = sorted((t.encode() for t in self.merger.special), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.limit = limit
        self.known: dict[str, int] = {}
        self._forget()
        self.table = ChunkTable(self._learn, self._forget)

    def _forget(self) -> None:
        self.of_chunk = np.zeros(0, np.int64)

    def _counts(self, pretokens: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        new = list(set(pretokens).difference(self.known))
        long = {}
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            for p, n in zip(block, self.merger.count([p.encode() for p in block]).tolist(), strict=True):
                (self.known if len(p) < LONG else long)[p] = n  # long ones are not worth their memory
        return np.fromiter((self.known[p] if p in self.known else long[p] for p in pretokens), np.int64, len(pretokens))

    def _learn(self, chunks: list[bytes]) -> None:
        """Joined chunks are told apart by the blank that starts each; the others go one by one."""
        plain, odd = shared_blank(chunks)
        out = np.zeros(len(chunks), np.int64)
        for at in range(0, len(plain), BLOCK):
            block = plain[at : at + BLOCK]
            pretokens = PRETOKEN.findall(b"".join(chunks[i] for i in block).decode())
            starts = np.flatnonzero(np.fromiter((p[0] == " " for p in pretokens), bool, len(pretokens)))
            out[block] = np.add.reduceat(self._counts(pretokens), starts)
        if len(odd):
            found = [PRETOKEN.findall(chunks[i].decode()) for i in odd]
            counts = self._counts([p for f in found for p in f])
            out[odd] = np.add.reduceat(counts, np.r_[0, np.cumsum([len(f) for f in found])[:-1]])
        self.of_chunk = np.concatenate([self.of_chunk, out])

    def count(self, texts: pa.Array) -> np.ndarray:
        data, bounds = flat(texts)
        starts = cut(data, bounds)
        number = self.table.find(data, starts)
        total = np.r_[0, np.cumsum(self.of_chunk[number])]
        out = np.diff(total[np.searchsorted(starts, bounds)])
        if self.special and self.special.search(raw := data.tobytes()):
            for i in range(len(texts)):  # a special string is one token and parts the text
                if self.special.search(text := raw[bounds[i] : bounds[i + 1]]):
                    parts = self.special.split(text)
                    out[i] = self.count(pa.array(parts, pa.binary())).sum() + len(parts) - 1
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter for each worker process and vocabulary, kept between tasks."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of ``docs``, without a shuffle.

    ``path`` names a byte-level BPE vocabulary (tokenizers' JSON). No begin,
    end or added tokens; a special string of the vocabulary inside a text counts
    as the one token that the library makes of it. A vocabulary with other
    rules than byte-level BPE's is refused. A null or empty text has 0
    bytes and 0 tokens. Repeated rows and null keys give a row each; other
    columns are left aside, whatever their names. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for part in steps(batches, "t"):
            n = pa.array(c.count(part.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, part.column(2)], ["k", "n", "b"])

    narrow = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t")).withColumn("b", F.octet_length("t").cast("long"))
    return narrow.mapInArrow(run, "k long, n long, b long").select(F.col("k").alias("doc_id"), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
