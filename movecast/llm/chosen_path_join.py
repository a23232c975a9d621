"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles. In each run a set walks down a path: at every node it goes on by the shared token
that a seeded hash samples from it, so two sets of likeness J stay together with chance J at each step. A node of few sets is a
leaf and is searched by brute force; larger ones are split again, down to ``DEPTH`` steps, and what is still large then (copies
that agree in nearly all tokens) is searched in blocks of bounded size. Runs are repeated until a pair of the wanted likeness
is found together with the target recall. Sets that agree in half of all sampled tokens, far below the wanted likeness, become
candidates.

Candidates are gathered into components, and within a component *all* pairs are verified by the exact Jaccard likeness of
their shingles, block by block. Pairs are counted and merged where they are found and never leave the task: a group of n near
copies gives n rows and n counts, not n * n rows. Equal sets are one set with several documents from the start.

Words are runs of letters and digits in lower case; a text of one to four words is one shingle. A text without words (also a null
one) has no set: it is a class of its own without links. Rows with equal doc_id count as one document where they have equal
sets; a null doc_id comes last. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, BitTable, components, durable, flat, lists, mix, owners, pieces, prefix_sums, release, rolling, spans, text_marks
from .simhash_decontamination import word_hashes

SHINGLE = 5
LIKENESS = 0.8
RECALL = 0.9999
DEPTH = 3
#: A node with no more sets than this is a leaf.
LEAF = 64
#: Most sets that are compared with each other, or with another block, at once.
BLOCK = 256
DOCUMENT_BITS = 24
LAST = 2**63 - 1


def runs_for(likeness: float = LIKENESS, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair of this likeness, split ``depth`` times in each, is together in one with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - likeness**depth))


def shingle_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order, and their offsets."""
    sums = prefix_sums(values)
    lengths = np.diff(offsets)
    counts = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), counts)
    start = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    end = np.minimum(start + SHINGLE, offsets[1:][row])
    hashes = spans(sums, start, end) if len(row) else np.zeros(0, U64)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    sizes = np.bincount(row[new], minlength=len(counts))
    return hashes[new], np.concatenate([[0], np.cumsum(sizes)])


def set_prints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for an empty one."""
    out = []
    for seed in (U64(0x51AFD7ED558CCD01), U64(0xB9FE1A85EC53C4CF)):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ seed))])
        out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


def _sampled(hashes: np.ndarray, offsets: np.ndarray, samples: int) -> np.ndarray:
    """(sets, samples): the token that each seeded hash samples, as the low half of its hash. Sets must not be empty."""
    seeds = mix(np.arange(1, samples + 1, dtype=U64))
    out = np.empty((len(offsets) - 1, samples), np.int32)
    for k, seed in enumerate(seeds):
        low = np.minimum.reduceat((hashes ^ seed) * U64(0x9FB21C651E98DF25) ^ (hashes >> U64(29)), offsets[:-1])
        out[:, k] = mix(low).astype(np.uint32).view(np.int32)
    return out


def sets(docs: DataFrame, samples: int) -> DataFrame:
    """(rank, t1, t2, sid, second, n, tokens): each document's set by its fingerprints, its size, and its sampled tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            hashes, offsets = shingle_sets(*flat(batch.column("words")))
            sid, second = set_prints(hashes, offsets)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            tokens = np.zeros((len(n), samples), np.int32)
            if len(full):
                tokens[full] = _sampled(hashes, np.append(offsets[:-1][full], offsets[-1]), samples)
            width = np.where(n > 0, samples, 0)
            columns = [
                *(batch.column(c) for c in ("rank", "t1", "t2")),
                pa.array(sid.view(np.int64)),
                pa.array(second.view(np.int64)),
                pa.array(n.astype(np.int32)),
                lists(tokens[full].ravel(), np.concatenate([[0], np.cumsum(width)]), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "t1", "t2", "sid", "second", "n", "tokens"])

    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    hashed = docs.select(rank.alias("rank"), *text_marks(F.col("text")), word_hashes(F.col("text")).alias("words"))
    return hashed.mapInArrow(rows, "rank bigint, t1 bigint, t2 bigint, sid bigint, second bigint, n int, tokens array<int>")


def leaves(nodes: DataFrame, runs: int, depth: int = DEPTH) -> DataFrame:
    """(leaf, sid, count): where each set's path ends in each run, for leaves of two sets or more."""
    path = nodes.select("sid", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    at = F.xxhash64("run")
    for level in range(depth):
        at = F.xxhash64(at, F.get("tokens", F.col("run") * depth + level))
        path = path.withColumn(f"b{level}", at)
        at = F.col(f"b{level}")
    path = path.drop("tokens", "run")
    found = None
    for level in range(depth):
        node = f"b{level}"
        sizes = path.groupBy(node).agg(F.count("*").alias("count")).where("count > 1")
        met = path.join(sizes, node)
        ended = met.where(F.col("count") <= LEAF) if level < depth - 1 else met
        ended = ended.select(F.col(node).alias("leaf"), "sid", "count")
        found = ended if found is None else found.unionByName(ended)
        path = met.where(F.col("count") > LEAF).drop(node, "count")
    return found


def blocked(df: DataFrame, group: str, count: str, member: str, most: int = BLOCK) -> DataFrame:
    """Deal the members of large groups to blocks of about ``most``, and give each pair of blocks its copy of their members:
    columns i <= j number the pair, ``side`` tells the member's block. Small groups are one block."""
    n = F.ceil(F.col(count) / most).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), F.col(member)), n).cast("int")
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = df.withColumn("side", own).withColumn("pair", F.explode_outer(others))
    dealt = dealt.select("*", "pair.i", "pair.j").drop("pair", count)
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", member)


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups, of about ``rows`` rows or one group."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        keys = [table.column(n).to_numpy() for n in names]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.flatnonzero(new)

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            last = int(bounds(table)[-1])
            if last:
                yield table.slice(0, last)
                held = table.slice(last).to_batches()
                size = table.num_rows - last
    if size:
        yield pa.Table.from_batches(held)


def _group_numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    keys = [table.column(n).to_numpy() for n in names]
    new = np.zeros(table.num_rows, np.int64)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.cumsum(new)


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row of each row's component under the links a - b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def candidates(leaf_rows: DataFrame, nodes: DataFrame, samples: int) -> DataFrame:
    """(a, b): links that hold together the sets that met in a leaf and agree in half of their tokens."""
    tokens = blocked(leaf_rows.join(nodes.select("sid", "tokens"), "sid"), "leaf", "count", "sid")
    least = samples // 2

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("leaf", "i", "j")
        for table in whole_groups(batches, keys, 1 << 14):
            table = table.combine_chunks()
            group, side = _group_numbers(table, keys), table.column("side").to_numpy()
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            sid = table.column("sid").to_numpy()
            values, _ = flat(table.column("tokens").chunk(0), "int32")
            values = values.reshape(-1, samples)
            lefts, rights = [], []
            rows, step = np.arange(len(group)), 0
            while True:
                step += 1
                rows = rows[rows + step < len(group)]
                rows = rows[group[rows] == group[rows + step]]
                if not len(rows):
                    break
                ask = rows[~across[rows] | (side[rows] != side[rows + step])]
                ask = ask[(values[ask] == values[ask + step]).sum(axis=1) >= least]
                lefts.append(ask)
                rights.append(ask + step)
            if lefts:
                label = _lowest(len(group), np.concatenate(lefts), np.concatenate(rights))
                linked = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(sid[linked]), pa.array(sid[label[linked]])], names=["a", "b"])

    return tokens.mapInArrow(search, "a bigint, b bigint")


def _intersections(shingles: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, from the tokens that two of them have."""
    g = len(shingles)
    if g == 2:
        shared = len(np.intersect1d(shingles[0], shingles[1], assume_unique=True))
        return np.array([[len(shingles[0]), shared], [shared, len(shingles[1])]], np.float32)
    _, token, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), [len(s) for s in shingles])
    number = np.cumsum(counts > 1) - 1
    use = counts[token] > 1
    token, owner = number[token[use]], owner[use]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((g, g), np.float32)
    width = 4096
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (first, first + width))
        has = np.zeros((g, width), np.float32)
        has[owner[a:b], token[a:b] - first] = 1
        out += has @ has.T
    return out


def verified(members: DataFrame, likeness: float) -> DataFrame:
    """(root, sid, low, links) of each member and pair of blocks that it is in: the sets in this pair that are at least so like
    it, and the first set of those that hold together with it here. ``members``: (root, count, sid, n, shingles)."""
    dealt = blocked(members, "root", "count", "sid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("root", "i", "j")
        for table in whole_groups(batches, keys, 512):
            table = table.combine_chunks()
            roots, sids, sides = (table.column(c).to_numpy() for c in ("root", "sid", "side"))
            several = table.column("several").to_numpy(zero_copy_only=False)
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            values, offsets = flat(table.column("shingles").chunk(0))
            starts = np.append(np.flatnonzero(np.diff(_group_numbers(table, keys), prepend=-1)), table.num_rows)
            out = []
            for first, end in zip(starts[:-1], starts[1:], strict=True):
                rows = np.arange(first, end)
                rows = rows[np.append(True, sids[rows][1:] != sids[rows][:-1])]  # repeated rows
                if len(rows) < 2:
                    continue
                shared = _intersections([values[offsets[r] : offsets[r + 1]] for r in rows])
                n = np.diff(offsets)[rows].astype(np.float64)
                like = shared >= likeness * (n[:, None] + n - shared) - 1e-6
                np.fill_diagonal(like, False)
                if across[first]:
                    like &= sides[rows][:, None] != sides[rows]
                a, b = np.nonzero(like)
                label = _lowest(len(rows), a, b)
                out.append((roots[rows], sids[rows], sids[rows][label], like.sum(axis=1), several[rows]))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["root", "sid", "low", "links", "several"])

    return dealt.mapInArrow(check, "root bigint, sid bigint, low bigint, links bigint, several boolean")


def _classed(docs: DataFrame, likeness: float, recall: float) -> DataFrame:
    """(rank, t1, t2, n, low, class, copies, links) of each row; ``low`` names its class where it has a set."""
    runs = runs_for(likeness, recall)
    samples = runs * DEPTH
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    members = durable(sets(docs, samples))
    nodes = members.where("n > 0").groupBy("sid", "second").agg(F.min(F.struct("rank", "t1", "t2")).alias("row"), F.count_distinct("rank").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    nodes = durable(nodes.select("*", F.col("row.rank").alias("rep"), "row.t1", "row.t2").drop("row"))

    links = candidates(leaves(nodes, runs), nodes, samples)
    grouped = durable(components(links).withColumnRenamed("id", "sid"))
    release(docs.sparkSession)
    sizes = grouped.groupBy("root").agg(F.count("*").alias("count"))
    wanted = durable(grouped.join(sizes, "root").join(nodes.select("sid", "rep", "t1", "t2"), "sid"))

    # Texts of the candidates only: a bit table tells where they are read.
    rank = F.coalesce("doc_id", F.lit(LAST))
    table = docs.sparkSession.sparkContext.broadcast(BitTable.of(wanted.select(F.xxhash64("rep", "t1", "t2").alias("h")), "h", DOCUMENT_BITS))

    @F.pandas_udf("boolean")
    def may_be(h):
        return h.__class__(table.value.has(h.to_numpy().view(np.uint64)))

    few = docs.select(rank.alias("rep"), *text_marks(F.col("text")), "text").where(may_be(F.xxhash64("rep", "t1", "t2"))).join(wanted, ["rep", "t1", "t2"])
    hashed = few.select("root", "count", "sid", word_hashes(F.col("text")).alias("words"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            hashes, offsets = shingle_sets(*flat(batch.column("words")))
            own = set_prints(hashes, offsets)[0].view(np.int64) == batch.column("sid").to_numpy()  # not another text of that id
            hashes, sizes_ = hashes[own[owners(offsets)]], np.diff(offsets)[own]
            kept = batch.filter(pa.array(own))
            several = pa.array(kept.column("count").to_numpy() > BLOCK)
            column = lists(hashes.view(np.int64), np.concatenate([[0], np.cumsum(sizes_)]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [kept.column("root"), kept.column("count"), kept.column("sid"), several, column], names=["root", "count", "sid", "several", "shingles"]
            )

    texts = hashed.mapInArrow(shingled, "root bigint, count bigint, sid bigint, several boolean, shingles array<bigint>")
    checked = durable(verified(texts, likeness))
    counted = checked.groupBy("sid").agg(F.sum("links").alias("links"), F.min("low").alias("low"), F.first("several").alias("several"))
    # A component of one block is settled by its labels; those of several need theirs joined.
    across = components(checked.where("several").select(F.col("sid").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "sid")
    settled = counted.join(across, "sid", "left").select("sid", "links", F.when(F.col("several"), F.coalesce("root", "sid")).otherwise(F.col("low")).alias("low"))
    labelled = nodes.select("sid", "second", "rep", "copies").join(settled, "sid", "left").withColumn("low", F.coalesce("low", "sid"))
    smallest = labelled.groupBy("low").agg(F.min("rep").alias("class"))
    named = labelled.join(smallest, "low").select("sid", "second", "low", "class", "copies", "links")
    return members.select("rank", "t1", "t2", "sid", "second", "n").join(named, ["sid", "second"], "left")


def classes(docs: DataFrame, likeness: float = LIKENESS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each row: the smallest doc_id among all that links join to it, the number of
    other sets at least so like its own, and the number of other documents with its own set."""
    result = _classed(docs, likeness, recall)
    given = lambda c: F.when(c != LAST, c)
    return result.select(
        given(F.col("rank")).alias("doc_id"),
        given(F.coalesce("class", "rank")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """One row of ``docs`` of each class, with all its columns: that with the smallest doc_id, a null one last, then by a hash of
    the text. Each row is judged by its own text, whatever its id; of equal rows one stays. Texts without words all stay."""
    mark = ["rank", "t1", "t2"]
    rows = _classed(docs, likeness, RECALL).where("n > 0").groupBy(*mark, "low").agg(F.count("*").alias("times"))
    rows = durable(rows)
    kept = rows.groupBy("low").agg(F.min(F.struct(*mark)).alias("kept"))
    decided = rows.join(kept, "low").select(*mark, (F.struct(*mark) != F.col("kept")).alias("gone"), "times").where("gone or times > 1")
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), rank.alias("rank"), *text_marks(F.col("text")))
    told = row.join(decided, mark, "left")
    whole = told.where("gone is null").select("row")
    # Rows that are there several times: any one of them stands for all.
    one = told.where("not gone").groupBy(*mark).agg(F.first("row").alias("row")).select("row")
    return whole.unionByName(one).select("row.*")
