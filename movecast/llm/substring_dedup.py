"""Substring dedup by seed and extend.

Seeds: every 50 consecutive words hold a winnowed anchor, the 10 words with the least hash among them, chosen by the words
alone; so two equal stretches of 50 words have the same anchor at the same place. The stretches that follow each other with one
anchor are its block. Extension, both ways from the anchor: blocks that are equal to their last word are joined at once with the
first document (smallest doc_id) that has them, and only that document goes on for them. Where blocks with one anchor differ
(the ends of a copied passage, a changed word), their single stretches of 50 words are joined with the first document that has
them. What matches merges into maximal repeats, which are removed everywhere but in that first document. Nothing is paired
within a group of copies: each block or stretch meets one row.

Bit tables of fixed size tell, where texts are read, which blocks and stretches are wanted. They pass every row that is needed: a
block is left to the first document that has it only if the table of first owners, which holds all blocks with such anchors, rules
this document out. Where these tables are full, more rows than needed travel and the result is the same.

Words are runs without space, tab, line feed, vertical tab, form feed and carriage return, unchanged. A null text has none. A null
doc_id comes after all others. Rows with equal doc_id are no source for each other, and each is judged by its own text. An empty
table gives no rows. Fingerprints have 64 bits; n different stretches have about n * n / 2**65 false matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, BitTable, durable, flat, owners, pieces, prefix_sums, rolling, spans, window_starts, word_hashes

WORDS = 50
ANCHOR_WORDS = 10
#: Bits of the tables of blocks and of changed documents: 4 MB and 2 MB each, whatever the data.
BLOCK_BITS = 25
DOCUMENT_BITS = 24
LAST = 2**63 - 1
_LOW = U64((1 << 24) - 1)


def _anchored(values: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Starts of all stretches, their hashes, and their anchors' places and hashes."""
    sums = prefix_sums(values)
    starts = window_starts(offsets, length)
    if not len(starts):
        none = np.zeros(0, U64)
        return starts, none, starts, none
    grams = rolling(sums, anchor)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
    width, want = 1, length - anchor + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    at = (least[starts] & _LOW).astype(np.int64)
    return starts, rolling(sums, length)[starts], at, grams[at]


def _hashed(docs: DataFrame) -> DataFrame:
    """rank (doc_id, null last), the mark of the text (64 bits), and the words' hashes."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("rank"),
        F.xxhash64("text").alias("mark"),
        word_hashes(F.col("text")).alias("words"),
    )


def _blocks(values: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each block: its first start, the number of its stretches, its hash, and its anchor's hash; then the stretches."""
    starts, stretch, at, hashes = _anchored(values, offsets, length, anchor)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    size = np.diff(np.append(first, len(at)))
    begin = starts[first]
    whole = spans(prefix_sums(values), begin, begin + size + length - 1) if len(begin) else np.zeros(0, U64)
    return begin, size, whole, hashes[first], first, stretch


def blocks(hashed: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, block, first, last): each different block, with the first and the last document that has it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", 1 << 18):
            values, offsets = flat(batch.column("words"))
            begin, _, whole, anchors, *_ = _blocks(values, offsets, length, anchor)
            rank = batch.column("rank").to_numpy()[owners(offsets)[begin]] if len(begin) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rank)], names=["anchor", "block", "rank"]
            )

    found = hashed.select("rank", "words").mapInArrow(rows, "anchor bigint, block bigint, rank bigint")
    return found.groupBy("anchor", "block").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))


def _owned(block: Column, rank: Column) -> Column:
    return block.bitwiseXOR(F.shiftleft(rank, 64 - BLOCK_BITS))


def extended(hashed: DataFrame, tables: tuple[BitTable, BitTable, BitTable], length: int, anchor: int) -> DataFrame:
    """(stretch, rank, mark, place) of each block that several documents have, and of each stretch of 50 words, of the first document
    of its block, whose anchor has different blocks. ``place``: its start and number of words.

    ``tables``: blocks that several documents have, blocks of contested anchors with their first document, contested anchors."""
    sent = hashed.sparkSession.sparkContext.broadcast(tables)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, firsts, contested = sent.value
        for batch in pieces(batches, "words", 1 << 18):
            values, offsets = flat(batch.column("words"))
            begin, size, whole, anchors, at, stretch = _blocks(values, offsets, length, anchor)
            row = owners(offsets)[begin] if len(begin) else begin
            ranks = batch.column("rank").to_numpy()
            several = repeated.has(whole)
            leads = firsts.has(whole ^ (ranks[row].view(np.uint64) << U64(64 - BLOCK_BITS)))
            open_ = np.flatnonzero(contested.has(anchors) & leads)
            block = np.repeat(open_, size[open_])
            step = np.arange(len(block)) - np.repeat(np.cumsum(size[open_]) - size[open_], size[open_])
            start = np.concatenate([begin[several], begin[block] + step])
            words = np.concatenate([size[several] + length - 1, np.full(len(block), length)])
            hashes = np.concatenate([whole[several], stretch[at[block] + step]])
            row = np.concatenate([row[several], row[block]])
            place = ((start - offsets[row]) << 32) | words
            mark = batch.column("mark").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(ranks[row]), pa.array(mark), pa.array(place)], names=["stretch", "rank", "mark", "place"]
            )

    return hashed.mapInArrow(rows, "stretch bigint, rank bigint, mark bigint, place bigint")


def _among(table: BitTable, spark: SparkSession) -> Callable:
    """Column function: may the table hold this hash?"""
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def among(h):
        return h.__class__(sent.value.has(h.to_numpy().view(np.uint64)))

    return among


def _tables(different: DataFrame) -> tuple[BitTable, BitTable, BitTable]:
    """Tables of ``extended``, from the different blocks with their first and last document."""
    of_anchor = different.groupBy("anchor").agg(F.count("*").alias("blocks"), F.min("first").alias("a"), F.max("last").alias("b"))
    contested = BitTable.of(of_anchor.where("blocks > 1 and a < b"), "anchor", BLOCK_BITS)
    may_differ = different.where(_among(contested, different.sparkSession)("anchor"))
    return (
        BitTable.of(different.where("first < last"), "block", BLOCK_BITS),
        BitTable.of(may_differ.select(_owned(F.col("block"), F.col("first")).alias("h")), "h", BLOCK_BITS),
        contested,
    )


def maximal_repeats(docs: DataFrame, length: int = WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(rank, mark, start, end) in words of each stretch, as long as it goes, that a document with a smaller id has in parts
    of at least ``length`` words."""
    hashed = _hashed(docs)
    different = blocks(hashed, length, anchor).persist(StorageLevel.DISK_ONLY)
    tables = _tables(different)
    different.unpersist()
    stretches = extended(hashed, tables, length, anchor)
    first = durable(stretches.groupBy("stretch").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last"))
    wanted = stretches.where(_among(BitTable.of(first, "stretch", BLOCK_BITS), docs.sparkSession)("stretch"))
    repeated = wanted.join(first, "stretch").where(F.col("rank") > F.col("first"))
    per_doc = repeated.groupBy("rank", "mark").agg(F.collect_set("place").alias("places"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "places"):
            values, offsets = flat(batch.column("places"), "int64")
            row, start = owners(offsets), values >> 32
            end = start + (values & 0xFFFFFFFF)
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            reach = np.maximum.accumulate((row << 32) + end) - (row << 32) if len(row) else end
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(row))[: len(at)] - 1
            rank, mark = (batch.column(c).to_numpy()[row[at]] for c in ("rank", "mark"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank), pa.array(mark), *(pa.array(x.astype(np.int32)) for x in (start[at], reach[last]))],
                names=["rank", "mark", "start", "end"],
            )

    return per_doc.mapInArrow(merge, "rank bigint, mark bigint, start int, end int")


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _split(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, repeats in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
            words = _split(text.as_py() or "")
            n, cut = len(words), repeats.as_py() or ()
            for span in reversed(cut):
                del words[span["start"] : span["end"]]
            kept = " ".join(words)
            sha = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, n, n - len(words), sha, kept if texts else None))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, length: int = WORDS, anchor: int = ANCHOR_WORDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if ``texts``) the kept words joined by one space, of each document.

    Only documents that may lose words are shuffled to meet their repeats; the others are done where they are read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    repeats = durable(maximal_repeats(docs, length, anchor))
    changed = BitTable.of(repeats.select(F.xxhash64("rank", "mark").alias("h")), "h", DOCUMENT_BITS)
    rank = F.coalesce("doc_id", F.lit(LAST))
    seen = docs.select("doc_id", "text", rank.alias("rank"), F.xxhash64("text").alias("mark")).withColumn("h", F.xxhash64("rank", "mark"))

    may_change = _among(changed, docs.sparkSession)
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    whole = seen.where(~may_change("h")).select("doc_id", "text", none.alias("spans"))
    found = repeats.groupBy("rank", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    cut = seen.where(may_change("h")).join(found, ["rank", "mark"], "left").select("doc_id", "text", "spans")
    return whole.unionByName(cut).mapInArrow(lambda b: _kept(b, texts), DIGEST)


def repeat_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, texts=False).drop("kept")
