"""Secrets in texts: three base patterns, and strings that look random to a pair of Markov models.

One model is of random strings, one of ordinary identifiers; both give the
probability of a character after another, counted from labelled samples. The
logarithm of their ratio, summed over a string and kept in whole thousandths,
says which of the two it is rather of. A run of characters that tokens are
made of is a secret where the sum reaches a threshold that labelled samples
left out of the counts have set.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import flat
from .common import steps, text_or_empty

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
#: Fewest characters: an assigned value, an access key, a run of hexadecimal digits, a run judged by the models.
LEAST = (12, 18, 16, 20)
#: For lower-cased text, so that letters of the names count in either case.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Characters of runs that the models judge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Logarithms are kept in units of 1 / SCALE.
SCALE = 1000
#: Labelled strings of each class that a model is counted from, and as many that set its threshold.
SAMPLES = 4000
#: Of the strings left out of the counts, the share of ordinary ones that may reach the threshold, and of random ones that may miss it.
FALSE_SHARE, MISSED_SHARE = 0.001, 0.001

#: Words that identifiers are commonly made of.
WORDS = """account action active add address admin agent alert alias allow amount api app archive area argument array asset attribute audio auth author available average
back base batch begin binary block board body border bottom branch browser buffer build bundle button byte cache call camera cancel card center change channel check child class clean
clear click client clone close cloud cluster code collection color column command comment commit common compare complete config connect console constant container content context control
convert cookie copy count create current cursor custom data database date debug decode default delete deploy description detail device dialog directory disable display document domain
download driver dynamic edit element email empty enable encode end engine entry error event example execute exit export
arbeit einheit freiheit geschichte gesellschaft gleichzeitig herrschaft kirche leitung menschlich rechnung schicht schrift umgebung verpflichtung versicherung wahrscheinlich wirtschaft zeitschrift zwischen
aujourd beaucoup chemin environnement heureux lorsque maintenant quelque toujours vieille adelante ciudad desarrollo guerra hermano izquierda nosotros pueblo siguiente trabajo""".split()  # noqa: SIM905
#: Alphabets of random tokens in common use.
TOKENS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
)


def _ordinary(r: random.Random) -> str:
    """An identifier, a path, a slug, a constant, a rule of one character or a long number."""
    words = r.choices(WORDS, k=r.randrange(2, 8))
    form = r.randrange(10)
    if form == 0:
        return r.choice("-=_+/") * r.randrange(20, 80)
    if form == 1:
        return r.choice(ALPHABET[26:52]) * r.randrange(2, 6) + "".join(words)
    if form == 2:
        return "-".join(f"{r.randrange(1990, 2040)}" if i % 3 == 0 else f"{r.randrange(1, 60):02d}" for i in range(r.randrange(4, 9)))
    joined = ("_".join(words), "-".join(words), "/".join(words), "".join(words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "".join(w.title() for w in words))[form - 3]
    return joined + r.choice(("", "", f"_v{r.randrange(20)}", str(r.randrange(2050)), f"={r.randrange(100)}"))


def labelled(n: int = SAMPLES, seed: int = 1) -> list[tuple[str, bool]]:
    """``n`` random strings (True) and ``n`` ordinary ones (False); a seed always gives the same."""
    r = random.Random(seed)
    strings = [("".join(r.choices(r.choice(TOKENS), k=r.randrange(20, 65))), True) for _ in range(n)]
    return strings + [(_ordinary(r), False) for _ in range(n)]


@dataclass(frozen=True)
class Model:
    """Scaled log-likelihood ratios by pair of characters (row: the one before), and the least sum that counts as random."""

    ratios: tuple[int, ...]
    threshold: int

    def score(self, text: str) -> int:
        return sum(self.ratios[ALPHABET.index(a) * len(ALPHABET) + ALPHABET.index(b)] for a, b in zip(text, text[1:], strict=False))


def pairs_of(samples: Iterable[tuple[str, bool]]) -> Counter:
    """(label, pair of characters) -> count."""
    return Counter((label, s[i : i + 2]) for s, label in samples for i in range(len(s) - 1) if s[i] in ALPHABET and s[i + 1] in ALPHABET)


def pairs_in(samples: DataFrame) -> Counter:
    """The same for a table (text string, random boolean) of any size: counted by the executors, at most twice the square of the alphabet comes back."""
    pair = F.explode(F.expr("transform(sequence(1, greatest(length(text) - 1, 0), 1), i -> substring(text, i, 2))")).alias("pair")
    long = samples.where("length(text) > 1 AND random IS NOT NULL").select("random", pair)
    known = long.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return Counter({(r["random"], r["pair"]): r["n"] for r in known.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()})


def model_of(pairs: Counter, held_out: list[tuple[str, bool]], false_share: float = FALSE_SHARE, missed_share: float = MISSED_SHARE) -> Model:
    """The model of counted pairs, with a threshold set by ``held_out``, labelled strings that weren't counted.

    Each pair counts half a time more than seen, so none is impossible. The
    threshold lies above what all but ``false_share`` of the ordinary strings
    reach; where all but ``missed_share`` of the random ones reach more, there.
    """
    ratios = []
    for a in ALPHABET:
        rows = {label: [pairs[label, a + b] + 0.5 for b in ALPHABET] for label in (True, False)}
        sums = {label: sum(row) for label, row in rows.items()}
        ratios += [round(SCALE * (math.log(x / sums[True]) - math.log(y / sums[False]))) for x, y in zip(rows[True], rows[False], strict=True)]
    model = Model(tuple(ratios), 0)
    ordinary = sorted((model.score(s) for s, label in held_out if not label), reverse=True)
    drawn = sorted(model.score(s) for s, label in held_out if label)
    least = ordinary[int(false_share * len(ordinary))] + 1 if ordinary else 1
    return Model(model.ratios, max(1, least, drawn[int(missed_share * len(drawn))] if drawn else 1))


def train(samples: DataFrame, held_out: list[tuple[str, bool]], false_share: float = FALSE_SHARE, missed_share: float = MISSED_SHARE) -> Model:
    """A model of one's own labelled samples (text string, random boolean)."""
    return model_of(pairs_in(samples), held_out, false_share, missed_share)


@cache
def trained() -> Model:
    """The model that the registered query uses, of ``SAMPLES`` labelled strings a class."""
    return model_of(pairs_of(labelled(SAMPLES, 1)), labelled(SAMPLES, 2))


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(characters.encode(), np.uint8)] = True
    return out


HEX, RUN = _class("0123456789abcdef"), _class(ALPHABET)
PLACE = np.zeros(256, np.int64)
PLACE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of longest runs of at least so many bytes."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return begin[long], end[long]


class Finder:
    """Finds the spans of a batch of texts, joined by line feeds, which no pattern matches."""

    def __init__(self, model: Model):
        self.ratios, self.threshold = np.array(model.ratios, np.int64), model.threshold

    def random_runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = _runs(RUN[data], LEAST[3])
        if not len(begin):
            return begin, end
        size = end - begin - 1  # pairs of each run
        first = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = PLACE[data[first]] * len(ALPHABET) + PLACE[data[first + 1]]
        likely = np.add.reduceat(self.ratios[pair], np.cumsum(size) - size) >= self.threshold
        return begin[likely], end[likely]

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, begin and end, by begin and then kind; a run within a base span isn't told again."""
        raw = data.tobytes()
        assign = [m.span() for m in ASSIGN.finditer(raw.lower()) if m.end(1) - m.start(1) >= LEAST[0]]
        access = [m.span() for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST[1]]
        found = [np.array(x, np.int64).reshape(-1, 2).T for x in (assign, access)]
        found.append(np.stack(_runs(HEX[data], LEAST[2])))
        base = np.concatenate(found, axis=1)
        begin, end = self.random_runs(data)
        if len(begin) and base.shape[1]:  # the furthest end of base spans that begin no later
            base_order = np.argsort(base[0], kind="stable")
            reach = np.maximum.accumulate(base[1][base_order])
            at = np.searchsorted(base[0][base_order], begin, side="right") - 1
            more = (at < 0) | (reach[np.maximum(at, 0)] < end)
            begin, end = begin[more], end[more]
        found.append(np.stack([begin, end]))
        kind = np.repeat(np.arange(4), [x.shape[1] for x in found])
        every = np.concatenate(found, axis=1).astype(np.int64)
        order = np.lexsort((kind, every[0]))
        return kind[order], every[0][order], every[1][order]

    def rows(self, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, bounds = flat(texts)
        n = len(bounds) - 1
        starts = bounds[:-1] + np.arange(n)  # each text is followed by one line feed
        joined = np.full(len(data) + n, 0x0A, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(bounds))] = data
        kind, begin, end = self.spans(joined)
        points = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
        owner = np.searchsorted(starts, begin, side="right") - 1
        counts = np.stack([np.bincount(owner[kind == k], minlength=n) for k in range(4)])
        begin, end = points[begin] - points[starts[owner]], points[end] - points[starts[owner]]
        shown = [f"{KINDS[k]}:{a}:{b}" for k, a, b in zip(kind.tolist(), begin.tolist(), end.tolist(), strict=True)]
        cuts, kinds = np.searchsorted(owner, np.arange(n + 1)).tolist(), kind.tolist()
        base, full = [hashlib.sha256().hexdigest()] * n, [""] * n
        for i in np.unique(owner).tolist():
            own = range(cuts[i], cuts[i + 1])
            base[i] = hashlib.sha256(",".join(shown[j] for j in own if kinds[j] < 3).encode()).hexdigest()
            full[i] = ",".join(shown[j] for j in own)
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(full)], schema=SCHEMA)


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def find_secrets(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row, in one pass without a shuffle.

    Spans are kind:begin:end in code points, end exclusive, by begin and then
    in the order of ``KINDS``. A kind's matches are leftmost and don't
    overlap; those with too few characters are dropped after matching, so
    they still take up what they matched. Spans of different kinds may
    overlap, but a run that the models judge random is left out where one base
    span already covers it. Null and empty texts have no spans. Repeated rows
    and null keys give a row each; other columns are left aside; an empty
    table gives no row.
    """
    own = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(own)
        for batch in steps(batches, "t"):
            yield finder.rows(batch.column(0), batch.column(1))

    narrow = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).cast("binary").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in the text replaced by ``mark``, overlapping spans by one; all columns stay, a null text stays null."""
    own = model or trained()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(own)
        for texts in batches:
            yield pd.Series([t if t is None else _redacted(finder, t, mark.encode()) for t in texts], dtype=object)

    return docs.withColumn(text, run(F.col(text).cast("string")))


def _redacted(finder: Finder, text: str, mark: bytes) -> str:
    raw = text.encode()
    _, begin, end = finder.spans(np.frombuffer(raw, np.uint8))
    out, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if a >= at:
            out += [raw[at:a], mark]
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode()
