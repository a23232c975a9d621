"""What several operators share: durable intermediate tables, hashed word lists, rolling hashes, fixed-size bit tables."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def durable(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder that all executors share (``spark.checkpoint.dir``).

    Only a session in one process (master ``local`` or ``local[...]``) may do without the setting, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and checkpoints that nothing refers to any more: it learns of them when the driver's memory is
    collected, which on a large heap may be long after a round has ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text, as they stand; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def text_marks(text: Column) -> list[Column]:
    """``t1`` and ``t2``: 128 bits that tell texts apart, where an id is null or repeated; null has its own."""
    return [F.xxhash64(F.lit(1), F.isnull(text), text).alias("t1"), F.xxhash64(F.lit(2), F.isnull(text), text).alias("t2")]


# --- numpy side


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the usual multiply and xor-shift finish)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: np.uint64 = BASE) -> None:
        self.base = base
        self.inverse = U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))])
                    for b in (self.base, self.inverse)
                )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which spans() makes the hash of any span of values."""
    up, _ = POWERS.get(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] of each pair; equal sequences have equal hashes wherever they stand."""
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def rolling(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive values from each place (short of the last n - 1)."""
    if len(sums) <= n:
        return np.zeros(0, U64)
    _, down = POWERS.get(len(sums))
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def flat(column: pa.Array, kind: str = "uint64") -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return (values.view(kind) if values.dtype.itemsize == np.dtype(kind).itemsize else values.astype(kind)), offsets - offsets[0]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


#: Values that a task works on at once: numpy makes some twenty arrays of that length on the way.
PIECE_VALUES = 1 << 17


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_VALUES) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches whose lists of ``column`` have about ``limit`` values together, one row at least."""
    for b in batches:
        offsets = b.column(column).offsets.to_numpy()
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), b.num_rows)
            yield b.slice(start, end - start)
            start = end


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row that each flat value belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Flat places from which n values of the same row follow."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    total = int(counts.sum())
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(total)


# --- bit tables: a filter of fixed size that passes every member and few others, whatever the number of members


class BitTable:
    """A set of 64-bit hashes as 2**bits bits. Its size does not depend on the data: at most 2**bits / 8 bytes reach the driver
    and the executors. Where members are many it lets more others pass; what uses it must be right without it too."""

    def __init__(self, words_: np.ndarray, bits: int) -> None:
        self.words, self.bits = words_, bits

    @staticmethod
    def of(hashes: DataFrame, column: str, bits: int = 24) -> BitTable:
        place = F.shiftrightunsigned(F.col(column), 64 - bits)
        rows = (
            hashes.select(F.shiftright(place, 6).alias("at"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
            .groupBy("at")
            .agg(F.expr("bit_or(shiftleft(one, bit))").alias("word"))
            .toArrow()
        )
        out = np.zeros(1 << (bits - 6), U64)
        out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(U64)
        return BitTable(out, bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> U64(64 - self.bits)
        return (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1


# --- connected components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for each end of ``edges`` (a, b): root is the smallest id of its component.

    Each round points every node to the smallest id among its neighbours' pointers, keeps that as new edges, and so halves
    distances (large star, then small star), until each edge leads from a node to its root. Each round is written durably, so
    lost executors cost one round.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = durable(pairs)
    for _ in range(most_rounds):
        if _all_stars(pairs):
            break
        both = _exploded(pairs, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = durable(pairs.join(low, "b").select("a", F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _exploded(large.join(low, "a"), ("b", "m"), ("a", "m"))
        pairs = durable(small.where("a <> b").distinct())
        del both, low, large, small
        release(spark)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def _exploded(df: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """A row (a, b) of each of the named pairs of columns."""
    made = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends])
    return df.select(F.explode(made).alias("e")).select("e.a", "e.b")


def _all_stars(pairs: DataFrame) -> bool:
    """Whether each node has one lower neighbour at most, and none if it is a lower neighbour itself. ``pairs``: distinct, a > b."""
    ends = pairs.withColumn("up", F.lit(1)).withColumn("no", F.lit(0))
    nodes = _exploded(ends, ("a", "up"), ("b", "no")).groupBy("a").agg(F.sum("b").alias("lower"), F.min("b").alias("leaf"))
    return nodes.where("lower > 1 or lower = 1 and leaf = 0").agg(F.count("*")).first()[0] == 0
