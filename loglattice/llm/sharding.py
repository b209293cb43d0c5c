"""Shards rows on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``virtual`` points on a ring of 64-bit hashes; a row belongs to
the first point clockwise of its own hash. A shard takes no more rows than its
capacity: rows that would overflow it continue clockwise to the next point
whose shard has room. Capacities differ by at most one and sum to the number
of rows, so counts do too, while most rows stay with the point of their hash
and few move when a shard joins.

The ring is cut into cells, several for each point and however many rows; a
cell belongs to the first point clockwise of its start. Rows are counted by
cell; the driver lets these counts (not rows) overflow clockwise, and each row
finds its place by its rank in its cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, numbered, text_or_empty

VIRTUAL = 64
#: The ring has at least 2 ** CELL_BITS cells, and CELLS for each point: what the driver holds and broadcasts grows with shards only.
CELL_BITS, CELLS = 14, 16
#: Rows of a cell that are ranked in one task; only repeated keys make a cell so much larger than others.
RANKED = 1 << 18


def cell_bits(shards: int, virtual: int = VIRTUAL) -> int:
    return max(CELL_BITS, (shards * virtual * CELLS - 1).bit_length())


def ring(shards: int, virtual: int = VIRTUAL, bits: int = CELL_BITS) -> list[int]:
    """The shard that each cell belongs to, in clockwise order. A point whose cell has one already takes the next free cell, so none is lost."""
    owner: list[int | None] = [None] * (1 << bits)
    points = []
    for shard in range(shards):
        for v in range(virtual):
            digest = hashlib.sha256(f"shard {shard} point {v}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big") >> (64 - bits), digest, shard))
    if len(points) > len(owner):
        raise ValueError("more points than cells")
    for cell, _, shard in sorted(points):
        while owner[cell] is not None:
            cell = (cell + 1) % len(owner)
        owner[cell] = shard
    following = next(s for s in owner if s is not None)
    for cell in range(len(owner) - 1, -1, -1):
        following = owner[cell] = owner[cell] if owner[cell] is not None else following
    return owner


def capacities(rows: int, shards: int) -> list[int]:
    """Sum to ``rows`` and differ by one at most."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def overflow(owner: list[int], loads: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Lets the loads of cells overflow clockwise: (cell, from, to, shard, slot of the first row) for ranks in [from, to).

    First every shard takes what its own cells hold, cell by cell, up to its
    capacity. What is left over continues clockwise, in the order of the cells
    it comes from, to the next cell whose shard has room.
    """
    room, used, out, left = list(capacity), [0] * len(capacity), [], []

    def place(cell: int, start: int, end: int, shard: int) -> int:
        take = min(end - start, room[shard])
        if take:
            out.append((cell, start, start + take, shard, used[shard]))
            used[shard] += take
            room[shard] -= take
        return start + take

    for cell in sorted(loads):
        start = place(cell, 0, loads[cell], owner[cell])
        if start < loads[cell]:
            left.append((cell, start))
    onward = list(range(1, len(owner))) + [0]  # the next cell to look at, with full ones skipped

    def next_open(cell: int) -> int:
        passed = []
        while room[owner[cell]] == 0:
            passed.append(cell)
            cell = onward[cell]
        for p in passed:
            onward[p] = cell
        return cell

    for cell, start in left:
        while start < loads[cell]:
            start = place(cell, start, loads[cell], owner[next_open(cell)])
    return out


def shard_rows(docs: DataFrame, shards: int = 40, virtual: int = VIRTUAL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a shard and a place in it for every row.

    The law that holds is ``rows``: counts of shards differ by at most one.
    Size is the UTF-8 bytes of the text (null: none) plus 16. Slots run from 0
    without gaps in every shard. ``grown_shard`` is null, as loads decide and
    not keys alone. A null key is placed by its text's checksum; rows that
    repeat are ranked in any order, which makes no difference. Other columns
    are left aside; an empty table gives no row.

    A cell that a repeated key fills is ranked in parts, by the place where
    its rows were written.
    """
    spark, bits = docs.sparkSession, cell_bits(shards, virtual)
    crc = F.crc32(F.col("t").cast("binary"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("t")).select(
        "doc_id", (F.octet_length("t") + 16).cast("long").alias("size"), crc.alias("text_crc32"), F.when(F.col("doc_id").isNull(), F.xxhash64(crc)).otherwise(F.xxhash64(F.lit("ring"), "doc_id")).alias("hash")
    )
    rows = Workspace(spark).put(rows.withColumn("cell", F.shiftrightunsigned("hash", 64 - bits).cast("int")).withColumn("place", F.monotonically_increasing_id()))
    loads = dict(map(tuple, rows.groupBy("cell").count().collect()))
    places = overflow(ring(shards, virtual, bits), loads, capacities(sum(loads.values()), shards))
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0)], "cell int, start long, end long, shard int, slot long")
    large = [cell for cell, n in loads.items() if n > max(RANKED, 4 * sum(loads.values()) >> bits)]
    parted = F.array_contains(F.lit(large).cast("array<int>"), F.col("cell")) if large else F.lit(False)
    ranked = numbered(rows, ["cell"], F.when(parted, F.shiftright("place", 33)).otherwise(F.lit(0).cast("long")), ["hash", "doc_id", "text_crc32", "size", "place"], "rank")
    placed = ranked.join(F.broadcast(table), "cell").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
