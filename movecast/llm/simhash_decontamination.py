"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item belongs to a width class, somewhat shorter than itself, and has a 64-bit SimHash of its words for each window
of that width. Documents have the SimHash of such a window at every word, so an edited passage is found where any window beside
the edit is whole. Hashes are cut into four blocks of 16 bits: two within a Hamming distance of three share a block, so the join
on blocks finds every pair within that radius. Two filters of fixed size, whatever the number of items, decide first which
windows go to the join: 65,536 bits for each class and block, and for what passes them 2**PART_BITS bits of block and part, as
the other 48 bits of such a pair, cut into four parts of 12, agree in one. Candidates are then verified by a weighted Jaccard
likeness of five-word shingles between the item and the item-sized window of the document.

Words are runs of letters and digits in lower case. Items of fewer than five words are not searched for, null ones neither. A
null text has no words. Documents with equal doc_id and text give one row for each item; rows with equal doc_id and other
texts are judged by their own texts, and the best place counts. A null doc_id is kept as such. Items with equal texts are
reported each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitTable, durable, flat, lists, mix, owners, pieces, prefix_sums, rolling, text_marks

SHINGLE = 5
LIKENESS = 0.8
RADIUS = 3
BLOCKS = 4
#: An item of n words has windows of the largest width that is no more than this share (7 / 10) of n: in integers, as 21 / 0.7 > 30.
SHARE = (7, 10)
DOCUMENT_BITS = 22
PART_BITS = 25
NOT_WORD = r"[^\p{L}\p{N}]+"


def widths(most: int) -> list[int]:
    """Width classes up to ``most`` words, each about 1.4 times the one before."""
    out = [3]
    while out[-1] < most:
        out.append(max(out[-1] + 1, round(out[-1] * 1.4)))
    return out


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def bit_sums(values: np.ndarray) -> np.ndarray:
    """Running sums, for each of 64 bits, of 1 where a word's hash has it and -1 where not. They may wrap: differences count."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(values) + 1, 64), np.int16)
    np.cumsum(bits, axis=0, dtype=np.int16, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows: a bit is set where more than half of the words have it."""
    ones = sums[starts + width] - sums[starts]
    return np.packbits(ones > width // 2, axis=1).view(np.uint64).ravel()


def window_prints(sums: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the window at every place, in slices that stay in the processor's cache."""
    n, half = max(0, len(sums) - width), width // 2
    out = np.empty((n, 8), np.uint8)
    for a in range(0, n, 1024):
        b = min(n, a + 1024)
        out[a:b] = np.packbits(sums[a + width : b + width] - sums[a:b] > half, axis=1)
    return out.view(np.uint64).ravel()


def _block_keys(prints: np.ndarray, class_: int) -> np.ndarray:
    """(n, BLOCKS) keys of class, block number and block."""
    blocks = prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)
    return blocks | (np.arange(BLOCKS) << 16) | (class_ << 20)


def _part_keys(prints: np.ndarray, class_: int, block: np.ndarray) -> np.ndarray:
    """(n, 4) hashes of class, block number, block and one of the four parts of the rest."""
    shift = np.asarray(block, np.uint64) * np.uint64(16)
    top = prints >> shift & np.uint64(0xFFFF)
    # The other three blocks: those above move down by one.
    under = (np.uint64(1) << shift) - np.uint64(1)
    rest = (prints & under) | (prints >> np.uint64(16) & ~under)
    key = top | (np.asarray(block, np.uint64) << np.uint64(16)) | (np.uint64(class_) << np.uint64(20))
    return np.stack([mix(mix(key ^ np.uint64(p << 60)) ^ (rest >> np.uint64(12 * p) & np.uint64(0xFFF))) for p in range(4)], axis=1)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n, width) of the items that can be searched for."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).withColumn("n", F.size("words")).where(F.col("n") >= SHINGLE)
    share = F.floor(F.col("n").cast("long") * SHARE[0] / SHARE[1])
    most = items.agg(F.max("n")).first()[0] or 0
    ladder = F.array(*[F.lit(w) for w in widths(most)])
    return items.withColumn("width", F.array_max(F.filter(ladder, lambda w: w <= share))).dropDuplicates(["item_id", "words"])


def item_windows(items: DataFrame) -> DataFrame:
    """(key, print, number, at, parts): four rows for each window of each item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", 1 << 16):
            values, offsets = flat(batch.column("words"))
            sums, width_of = bit_sums(values), batch.column("width").to_numpy()
            ids = batch.column("number").to_numpy()
            for width in np.unique(width_of):
                lengths = np.where(width_of == width, np.diff(offsets), 0)
                counts = np.maximum(lengths - width + 1, 0)
                row = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                prints = fingerprints(sums, offsets[row] + at, int(width))
                keys = _block_keys(prints, int(width)).ravel()
                parts = _part_keys(np.repeat(prints, BLOCKS), int(width), np.tile(np.arange(BLOCKS), len(prints)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        pa.array(np.repeat(prints.view(np.int64), BLOCKS)),
                        pa.array(np.repeat(ids[row], BLOCKS)),
                        pa.array(np.repeat(at, BLOCKS)),
                        lists(parts.view(np.int64).ravel(), np.arange(len(keys) + 1) * 4, pa.int64()),
                    ],
                    names=["key", "print", "number", "at", "parts"],
                )

    return items.select("number", "words", "width").mapInArrow(rows, "key bigint, print bigint, number bigint, at bigint, parts array<bigint>")


def document_windows(docs: DataFrame, keys: DataFrame, classes: list[int]) -> DataFrame:
    """(key, print, rank, start) of the windows that share a block with an item, once for each such block."""
    spark = docs.sparkSession
    slots = {w: i for i, w in enumerate(classes)}
    passing = np.zeros((len(classes), BLOCKS, 1 << 16), bool)  # of fixed size for each class, however many items
    words = keys.select(F.shiftright("key", 6).alias("word"), F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("bit"), F.expr("1L").alias("one"))
    for r in words.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits")).collect():
        bits = np.flatnonzero(np.unpackbits(np.array([r["bits"]], np.int64).view(np.uint8), bitorder="little"))
        key = (r["word"] << 6) + bits
        passing[slots[int(key[0] >> 20)], (key >> 16) & 15, key & 0xFFFF] = True
    parts = BitTable.of(keys.select(F.explode("parts").alias("h")), "h", PART_BITS)
    table = spark.sparkContext.broadcast((passing, parts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, close = table.value
        for batch in pieces(batches, "words", 1 << 16):
            values, offsets = flat(batch.column("words"))
            sums, ranks, row_of = bit_sums(values), batch.column("rank").to_numpy(), owners(offsets)
            left = offsets[1:][row_of] - np.arange(len(row_of))  # words from here to the end of the row
            for width in classes:
                prints = window_prints(sums, width)
                if not len(prints):
                    continue
                blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
                hit = np.stack([known[slots[width], b][blocks[:, b]] for b in range(BLOCKS)], axis=1)
                hit &= (left[: len(prints)] >= width)[:, None]
                starts, block = np.nonzero(hit)
                which = close.has(_part_keys(prints[starts], width, block).ravel()).reshape(-1, 4).any(axis=1)
                starts, block = starts[which], block[which]
                prints = prints[starts]
                row = row_of[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_block_keys(prints, width)[np.arange(len(starts)), block]),
                        pa.array(prints.view(np.int64)),
                        pa.array(ranks[row]),
                        pa.array(starts - offsets[row]),
                    ],
                    names=["key", "print", "rank", "start"],
                )

    return docs.select("rank", "words").mapInArrow(rows, "key bigint, print bigint, rank bigint, start bigint")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for rank, words, item, weights, rare, places in zip(
            batch.column("rank").to_pylist(),
            *(batch.column(c) for c in ("words", "item", "weights", "rare", "places")),
            strict=True,
        ):
            words, item = (np.asarray(x.values.to_numpy(), np.int64).view(np.uint64) for x in (words, item))
            wanted = rolling(prefix_sums(item), SHINGLE)
            weight = dict(zip(wanted.tolist(), weights.as_py(), strict=True))
            counts: dict[int, int] = {}
            for h in wanted.tolist():
                counts[h] = counts.get(h, 0) + 1
            total = sum(weight[h] * c for h, c in counts.items())
            here = rolling(prefix_sums(words), SHINGLE).tolist()
            best = (-1.0, 0)
            for start in places.as_py():
                start = max(0, min(start, len(here) - len(wanted)))
                seen: dict[int, int] = {}
                for h in here[start : start + len(wanted)]:
                    seen[h] = seen.get(h, 0) + 1
                shared = sum(weight[h] * min(c, seen.get(h, 0)) for h, c in counts.items())
                other = sum(weight.get(h, rare.as_py()) * c for h, c in seen.items())
                best = max(best, (shared / (total + other - shared), -start))
            if best[0] >= LIKENESS:
                out.append((rank, best[0], -best[1]))
            else:
                out.append((rank, None, None))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("number"), batch.column("t1"), batch.column("t2"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.int64()), strict=True))],
            names=["number", "t1", "t2", "rank", "likeness", "start"],
        )


NULL_RANK = 2**63 - 1


def _judged(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(rank, t1, t2, number, likeness, start) of the texts that have an item, each by its own words, and the items."""
    spark = docs.sparkSession
    items = item_table(benchmark).withColumn("number", F.xxhash64("item_id", "words"))
    items = durable(items)
    classes = sorted(r[0] for r in items.select("width").distinct().collect())  # one for each width, not for each item
    if not classes:
        return None
    windows = item_windows(items)
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_RANK))
    source = docs.select(rank.alias("rank"), *text_marks(F.col("text")), "text").withColumn("key", F.xxhash64("rank", "t1", "t2"))
    # Candidates go by row, not by id: texts with a null or repeated id don't meet each other's.
    hashed = source.select(F.col("key").alias("rank"), word_hashes(F.col("text")).alias("words"))
    found = document_windows(hashed, windows.select("key", "parts"), classes)
    near = found.alias("d").join(windows.alias("i"), "key").where(F.expr(f"bit_count(d.print ^ i.print) <= {RADIUS}"))
    places = near.select("rank", "number", (F.col("start") - F.col("at")).alias("place"))
    candidates = durable(places.groupBy(F.col("rank").alias("key"), "number").agg(F.collect_set("place").alias("places")))

    # Weight of a shingle: the rarer among items, the more; one that no item has weighs as one that a single item has.
    shingles = items.select("number", F.posexplode_outer(F.transform(F.slice("words", 1, F.col("n") - SHINGLE + 1), lambda _, i: F.slice("words", i + 1, SHINGLE))).alias("at", "shingle"))
    count = items.count()
    df = shingles.groupBy("shingle").agg(F.log(1 + count / F.countDistinct("number")).alias("weight"))
    weighted = shingles.join(df, "shingle").groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weight"))), lambda x: x["weight"]).alias("weights"))
    judged = items.select("number", "item_id", "n", F.col("words").alias("item")).join(weighted, "number")

    table = spark.sparkContext.broadcast(BitTable.of(candidates.select(F.xxhash64("key").alias("h")), "h", DOCUMENT_BITS))

    @F.pandas_udf("boolean")
    def may_have(h):
        return h.__class__(table.value.has(h.to_numpy().view(np.uint64)))

    few = source.where(may_have(F.xxhash64("key"))).select("key", "rank", "t1", "t2", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    pairs = few.join(candidates, "key").join(judged.select("number", "item", "weights"), "number")
    checked = pairs.select("number", "t1", "t2", "rank", "words", "item", "weights", F.lit(float(np.log(1 + count))).alias("rare"), "places").mapInArrow(
        _verify, "number bigint, t1 bigint, t2 bigint, rank bigint, likeness double, start bigint"
    )
    return checked.where("likeness is not null"), judged.select("number", "item_id", "n")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, likeness, start, n_words): the items that each document has, with the best place, in words."""
    found = _judged(docs, benchmark)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, likeness double, start bigint, n_words bigint")
    checked, items = found
    best = checked.groupBy("rank", "number").agg(F.max(F.struct("likeness", (-F.col("start")).alias("back"))).alias("b"))
    return best.join(items, "number").select(
        F.when(F.col("rank") != NULL_RANK, F.col("rank")).alias("doc_id"),
        F.col("item_id").cast("bigint").alias("item_id"),
        F.col("b.likeness").alias("likeness"),
        (-F.col("b.back")).alias("start"),
        F.col("n").cast("bigint").alias("n_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have no item, with all their columns. Each row is judged by its own text, whatever its id."""
    found = _judged(docs, benchmark)
    if found is None:
        return docs
    bad = found[0].select("rank", "t1", "t2").distinct()
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_RANK))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), rank.alias("rank"), *text_marks(F.col("text")))
    return row.join(bad, ["rank", "t1", "t2"], "left_anti").select("row.*")
