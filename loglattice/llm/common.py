"""What several operators share: reading, writing working tables, words, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words. ``bytes.split()`` without arguments splits at exactly these.
SPACE = b" \t\n\r\x0b\x0c"
#: The same as a Java or DuckDB pattern for a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python worker holds at once.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, whatever store its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_own_folders: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder for a local session that names none; one for each application. Executors of a cluster would not see it."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folders:
        _own_folders[key] = "file://" + tempfile.mkdtemp(prefix="loglattice-")
    return _own_folders[key]


class Workspace:
    """Working tables in the folder that all executors share.

    ``spark.checkpoint.dir`` of the session names the folder; only where it is
    unset, in a local session as in tests, a temporary one is made. A table
    that was written no longer depends on any executor, so its lineage is cut.
    ``drop`` deletes tables that later steps don't need, ``clear`` all of
    them; ``opened`` lists the workspaces that may still hold tables.
    """

    opened: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        self.folder = f"{top.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0
        self.opened.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.working_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "working_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        self._delete(self.folder)
        self.opened.remove(self)


class Bloom:
    """A Bloom filter of 64-bit hashes, made by the executors, with a bound on its size.

    The filter has 16 bits a key, at most ``most`` in all (32 MB); beyond
    half a key a bit it would say little and says yes to everything, so what
    it filters is then moved whole. It holds bits, not keys, so the driver,
    which passes it on, never holds the keys either.
    """

    def __init__(self, hashes: DataFrame, most: int = 1 << 28):
        """``hashes`` has one column of longs, spread over all 64 bits."""
        spark, (name,) = hashes.sparkSession, hashes.columns
        n = hashes.count()
        self.shared = None
        if n > most // 2:
            return
        bits = min(most, max(1 << 15, 1 << (16 * n).bit_length()))
        places = F.explode(F.array(F.col(name).bitwiseAND(bits - 1), F.shiftrightunsigned(name, 32).bitwiseAND(bits - 1)))
        parts = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(0x7FFF)).alias("bits"))
        table = np.zeros((bits >> 15, 1 << 12), np.uint8)
        for r in parts.toLocalIterator():
            table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        self.shared = spark.sparkContext.broadcast(table.reshape(-1))

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function for executors: which of the hashes may be keys."""
        shared = self.shared

        def run(hashes: np.ndarray) -> np.ndarray:
            if shared is None:
                return np.ones(len(hashes), bool)
            table, h = shared.value, hashes.astype(np.int64).view(np.uint64)
            mask, out = np.uint64(8 * len(table) - 1), np.ones(len(h), bool)
            for p in (h & mask, h >> np.uint64(32) & mask):
                out &= (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            return out

        return run

    def column(self, hashes: Column) -> Column:
        """True where a row's hash may be a key."""
        if self.shared is None:
            return F.lit(True)
        run = self.test()

        @F.pandas_udf("boolean")
        def may_be(x: pd.Series) -> pd.Series:
            return pd.Series(run(x.to_numpy()))

        return may_be(hashes)


#: Rows of one key that may meet in one task, and keys with more that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1 << 12, 1 << 14


def lookup(rows: DataFrame, figures: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``figures``, which has one row a key and in ``n`` how many of ``rows`` have it; ``n`` goes.

    A key with very many rows would gather in one task, so its figures are
    broadcast. No more than ``HOT_KEYS`` keys can have more than a share of
    1 / ``HOT_KEYS`` of all rows, which bounds what is broadcast. Both
    tables are read twice, so they should be written ones.
    """
    total, most = figures.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return rows.join(figures.drop(n), keys)
    hot = F.broadcast(figures.where(F.col(n) > limit).drop(n))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(figures.where(F.col(n) <= limit).drop(n), keys)
    return rows.join(hot, keys).unionByName(rest)


def numbered(rows: DataFrame, keys: list[str], slot: Column, order: list[str], name: str) -> DataFrame:
    """Adds each row's rank among those of its key, from 0: in the order of slots, then of ``order``.

    A slot is ranked in one task; what comes before it is the sum of earlier
    slots' counts, of which a key has one a slot. ``rows`` should be a written
    table, so that both readings agree.
    """
    slotted = rows.withColumn("slot__", slot)
    counts = slotted.groupBy(*keys, "slot__").agg(F.count(F.lit(1)).alias("n__"))
    before = F.sum("n__").over(Window.partitionBy(*keys).orderBy("slot__").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before__", F.coalesce(before, F.lit(0))).where("before__ > 0").drop("n__")
    local = slotted.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "slot__").orderBy(*order)) - 1)
    same = [local[c].eqNullSafe(offsets[c]) for c in (*keys, "slot__")]
    joined = local.join(offsets, reduce(and_, same), "left")
    return joined.select(*[local[c] for c in rows.columns], (local[name] + F.coalesce(offsets["before__"], F.lit(0))).cast("long").alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of one piece hold about ``limit`` bytes; a row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32)
        ends = sizes[values.offset : values.offset + len(values) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: bytes) -> list[bytes]:
    return text.split()
