"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring; a document belongs to the first point clockwise of its own hash. A shard may hold at most
(1 + slack) times the mean of documents: what overflows it goes on clockwise to the next point of a shard that has room. Without
slack, counts are at most one apart.

The ring has a fixed number of cells. Documents are counted per cell (a table of fixed size), the overflow is worked out cell by
cell in ring order, and a cell whose documents go to several shards is cut by their number in the order of their hashes. This is
the only rule, whatever the sizes of documents and table. Only DataFrame functions touch the documents.

The hash is that of doc_id, bytes and checksum of the text together, so rows with a null or repeated doc_id lie all over the ring. Rows equal
in these are counted before they are moved, take consecutive places and are told apart again at the end. A null text has no
bytes. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

CELL_BITS = 14
POINTS = 64
ROW_BYTES = 16
#: Equal rows that one task makes of their count.
COPIES = 4096

RESULT = "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint"


def ring(shards: int, points: int = POINTS, cells: int = 1 << CELL_BITS) -> tuple[list[int], list[int]]:
    """Cells of all points, in ring order, and the shards that own them."""
    owned = []
    for shard in range(shards):
        for point in range(points):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{point}".encode()).digest()[:8], "big") % cells
            owned.append((at, shard, point))
    owned.sort()
    return [c for c, _, _ in owned], [s for _, s, _ in owned]


def rooms(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Documents that each shard may hold: together at least all."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


class Loads:
    """Documents on each shard, and the walk clockwise."""

    def __init__(self, room: list[int], points: int = POINTS, cells: int = 1 << CELL_BITS) -> None:
        self.room = room
        self.held = [0] * len(room)
        self.at, self.owner = ring(len(room), points, cells)

    def place_cell(self, cell: int, rows: int) -> list[tuple[int, int, int, int]]:
        """(shard, from, to, first slot) of the parts of a cell's documents. Cells must come in ring order."""
        parts, done = [], 0
        at = bisect.bisect_left(self.at, cell)
        while done < rows:
            shard = self.owner[at % len(self.at)]
            at += 1
            take = min(rows - done, self.room[shard] - self.held[shard])
            if take > 0:
                parts.append((shard, done, done + take, self.held[shard]))
                self.held[shard] += take
                done += take
        return parts


def ring_hash() -> Column:
    """Where a document lies on the ring, from ``doc_id``, ``size`` and ``text_crc32``."""
    return F.xxhash64(F.lit("ring"), F.col("doc_id"), F.col("size"), F.col("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 40, slack: float = 0.0, points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of each document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    own = ["doc_id", "size", "text_crc32"]
    equal = digest.groupBy(*own).agg(F.count("*").alias("copies")).withColumn("h", ring_hash())
    equal = durable(equal.withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int")))
    cells = equal.groupBy("cell").agg(F.sum("copies").alias("rows")).orderBy("cell").collect()  # 2**CELL_BITS rows at most
    if not cells:
        return spark.createDataFrame([], RESULT)

    loads = Loads(rooms(sum(r["rows"] for r in cells), shards, slack), points)
    parts = [(r["cell"], *p) for r in cells for p in loads.place_cell(r["cell"], r["rows"])]  # a row for each cell, and for each shard that fills up
    table = F.broadcast(spark.createDataFrame(parts, "cell int, shard int, begun bigint, ended bigint, slot bigint"))
    order = Window.partitionBy("cell").orderBy("h", *own).rowsBetween(Window.unboundedPreceding, 0)
    cut = equal.withColumn("to", F.sum("copies").over(order)).join(table, "cell").where("to > begun and to - copies < ended")
    first, last = F.greatest(F.expr("to - copies"), F.col("begun")), F.least("to", "ended") - 1
    shift = F.col("slot") - F.col("begun")
    placed = durable(cut.select(*own, "shard", (first + shift).alias("first"), (last + shift).alias("last")))
    # Copies beyond one task's share are dealt out before they are made.
    many = placed.where(F.col("last") - F.col("first") >= COPIES)
    many = many.withColumn("first", F.explode(F.sequence("first", "last", F.lit(COPIES)))).repartition(*own, "first")
    many = many.withColumn("last", F.least("last", F.col("first") + (COPIES - 1)))
    few = placed.where(F.col("last") - F.col("first") < COPIES)
    return few.unionByName(many).select(*own, "shard", F.explode(F.sequence("first", "last")).alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
