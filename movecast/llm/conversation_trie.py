"""Trie of conversation prefixes, by union-find over the common prefixes of sorted neighbours.

Conversations are cut into stretches of ``STRETCH`` turns. A stretch knows the fingerprint of all turns before it, so a conversation of
any length is many bounded rows, and the trie is a forest of bounded trees: one below each fingerprint at which stretches begin.
Stretches are range-partitioned and sorted by what stands before them and then turn by turn. Neighbours have an edge as deep as
their common prefix. Within a block of rows the edges are taken in descending depth: a union-find merges the components at its
two ends, and a component that is merged higher up than it began leaves the chain of nodes in between. Nodes that touch neither end
of their block are finished. The others, at most two paths of ``STRETCH`` nodes a block, are contracted to their counts and
merged across blocks by fingerprint.

Sums over subtrees need no walk: every node stands for itself at its smallest member, whose nodes form the end of that
member's path. A second pass over the same forest adds up, for each node, the totals of its members; what the smallest member has
above the node is a running sum along its path, and is taken off.

Numbers of turns are counted over range partitions, so a conversation that holds a third of all rows is dealt over many tasks. Digests
of the ends take ids in order as text chunks, so one task streams a few large rows where a node ends very many conversations.

Turns are told apart by 128 bits of role and text. A null role or text is empty; a null turn comes first; rows with equal turn are
ordered by a hash of role and text (so repeated rows are turns of their own, next to each other). Rows with a null conv_id
belong to no conversation and are left out. Families of negative ids follow SQL: -5 % 100 is -5. Very long texts count as one turn. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, flat

#: Turns of a stretch, and so the most nodes that a block leaves open on either side.
STRETCH = 64
#: Conversations take over the first turns of the conversation whose id is the next lower multiple of this.
FAMILY = 100
#: One more than the most turns that are taken over.
HEADS = 6
#: Characters of ids that one chunk of a digest has at most.
CHUNK = 1 << 16


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, part, at, a, b, chars) with ``at`` running within ``part``, and for each (conv_id, part) the number that its
    first turn has in the conversation (``before``, from 0) and its ``at`` (``first``)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.length(text).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("seq"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b", "seq"]
    rows = rows.repartitionByRange(_slots(rows), *order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "a", "b", "chars")
    rows = durable(rows)
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    along = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, durable(counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, chars, h1, h2) of each turn of the rebuilt conversations, and all ids with their rebuilt length.

    ``h1`` and ``h2`` are hashes of depth and turn; xor over the turns up to a depth is the fingerprint of that prefix.
    """
    rows, links = numbered(conversations)
    at = F.col("before") + F.col("at") - F.col("first") + 1
    base = rows.where(F.col("conv_id") % FAMILY == 0).join(links.where("before < 5"), ["conv_id", "part"]).withColumn("at", at)
    turn = F.struct("at", "a", "b", "chars")
    heads = base.where(F.col("at") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = links.groupBy("conv_id").agg(F.sum("n").alias("own"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    taken = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast("array<struct<at:bigint,a:bigint,b:bigint,chars:bigint>>"))
    convs = convs.withColumn("head", taken.otherwise(F.slice("head", 1, F.col("h"))))
    convs = durable(convs.select("conv_id", "own", "h", "head", F.size("head").alias("k")))
    lengths = convs.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    first = convs.select("conv_id", F.inline("head")).withColumnRenamed("at", "depth")
    known = links.join(convs.select("conv_id", "h", "k"), "conv_id")
    own = rows.join(known, ["conv_id", "part"]).withColumn("at", at).where("at > h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "chars")
    every = first.select("conv_id", "depth", "a", "b", "chars").unionByName(own)
    marks = [F.xxhash64(F.lit(k), "depth", "a", "b").alias(f"h{k}") for k in (1, 2)]
    return every.select("conv_id", "depth", "chars", *marks), lengths


def stretches(turns: DataFrame) -> DataFrame:
    """(conv_id, level, k1, k2, e1, e2, h1, h2, chars): up to ``STRETCH`` consecutive turns in order, the fingerprints of what stands
    before them, and of all up to their end."""
    turn = F.struct("depth", "h1", "h2", "chars")
    level = F.floor((F.col("depth") - 1) / STRETCH).alias("level")
    out = turns.groupBy("conv_id", level).agg(F.sort_array(F.collect_list(turn)).alias("s"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"k{k}": F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)) for k in (1, 2)})
    ends = [F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"e{k}") for k in (1, 2)]
    return out.select("conv_id", "level", "k1", "k2", *ends, *[F.col(f"s.{c}").alias(c) for c in ("h1", "h2", "chars")])


_NODES = "depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, conv_id bigint, n bigint, chars bigint, total bigint, leaves bigint, open boolean"
_NODE_NAMES = [c.split()[0] for c in _NODES.split(", ")]


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, filled up with zeros, and their lengths."""
    values, offsets = flat(column, "int64")
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), STRETCH), np.int64)
    out[np.arange(STRETCH) < lengths[:, None]] = values
    return out, lengths


def chains(common: np.ndarray, lengths: np.ndarray, conv: list[int], totals: list[int], leaves: list[int]) -> list[tuple]:
    """Union-find over neighbours: (row, from depth, to depth, members, smallest, total, leaves, first row, last row) of each chain of
    nodes that have the same members. ``common``: depth of the edge after each row, -1 for none."""
    m = len(lengths)
    parent, top = list(range(m)), lengths.tolist()
    n, low, total, leaf = [1] * m, list(conv), list(totals), list(leaves)
    last = list(range(m))
    out = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def leave(x: int, depth: int) -> None:
        """The nodes of component x below ``depth`` are complete."""
        if top[x] > depth:
            out.append((x, depth + 1, top[x], n[x], low[x], total[x], leaf[x], x, last[x]))
            top[x] = depth

    order = np.argsort(-common, kind="stable")
    for edge, depth in zip(order.tolist(), common[order].tolist(), strict=True):
        if depth < 0:
            break
        a, b = find(edge), find(edge + 1)  # a component is named after its first row
        leave(a, depth)
        leave(b, depth)
        parent[b], last[a] = a, last[b]
        n[a], low[a], total[a], leaf[a] = n[a] + n[b], min(low[a], low[b]), total[a] + total[b], leaf[a] + leaf[b]
    for x in range(m):
        if parent[x] == x:
            leave(x, 0)
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted stretches, block by block; ``open`` ones may go on in another block."""
    for b in batches:
        if not b.num_rows:
            continue
        level, k1, k2, conv, total, leaves = (b.column(c).to_numpy() for c in ("level", "k1", "k2", "conv_id", "total", "leaves"))
        h1, lengths = _padded(b.column("h1"))
        h2, _ = _padded(b.column("h2"))
        chars, _ = _padded(b.column("chars"))
        shared = np.arange(STRETCH) < np.minimum(lengths[1:], lengths[:-1])[:, None]
        same = np.cumprod((h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & shared, axis=1, dtype=np.int8)
        common = same.sum(axis=1, dtype=np.int64)
        common[(level[1:] != level[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] = -1
        found = np.array(chains(common, lengths, conv.tolist(), total.tolist(), leaves.tolist()), np.int64)
        row, start, end, n, low, total, leaves, first, last = found.T
        path = [np.concatenate([k[:, None], h], axis=1) for k, h in ((k1, h1), (k2, h2))]
        p1, p2 = (np.bitwise_xor.accumulate(p, axis=1) for p in path)
        times = end - start + 1
        own = np.repeat(np.arange(len(row)), times)
        depth = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + start[own]
        r = row[own]
        opened = ((first == 0) | (last == b.num_rows - 1))[own]
        columns = [level[r] * STRETCH + depth, p1[r, depth], p2[r, depth], p1[r, depth - 1], p2[r, depth - 1], low[own], n[own], chars[r, depth - 1], total[own], leaves[own], opened]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NODE_NAMES)


def nodes(parts: DataFrame) -> DataFrame:
    """One row for each node but the root: its fingerprint, its parent's (q1, q2), smallest member, members, code points of the last turn,
    and the members' sums of ``total`` and ``leaves``."""
    order = ["level", "k1", "k2", "h1", "conv_id"]
    laid = parts.select("level", "k1", "k2", "h1", "h2", "chars", "conv_id", "total", "leaves")
    laid = laid.repartitionByRange(_slots(laid), *order).sortWithinPartitions(*order)
    pieces = durable(laid.mapInArrow(_forest, _NODES))
    key = ["depth", "p1", "p2", "q1", "q2"]
    sums = [F.sum(c).alias(c) for c in ("n", "total", "leaves")]
    merged = pieces.where("open").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"), *sums)
    return pieces.where("not open").drop("open").unionByName(merged)


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): digest of the ids that end at each node, in ascending order, joined by commas. ``ends``: (p1, p2, conv_id)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p1, p2, conv = (b.column(c).to_numpy() for c in ("p1", "p2", "conv_id"))
            text = conv.astype(str)
            new = np.ones(len(conv), bool)
            new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
            new |= np.arange(len(conv)) % (CHUNK // 21) == 0
            starts = np.flatnonzero(new)
            joined = [",".join(text[i:j]) for i, j in zip(starts, [*starts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[starts]) for c in (p1, p2, conv)] + [pa.array(joined)], names=["p1", "p2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([d for _, d in done])]
            return pa.RecordBatch.from_arrays(columns, names=["p1", "p2", "ends_sha256"])

        for b in batches:
            done = []
            for p1, p2, ids in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if key == (p1, p2):
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = (p1, p2), hashlib.sha256(ids.encode())
            if done:
                yield out()
        if key is not None:
            done = [(key, digest.hexdigest())]
            yield out()

    order = ["p1", "p2", "conv_id"]
    laid = ends.repartitionByRange(_slots(ends), *order).sortWithinPartitions(*order)
    text = laid.mapInArrow(chunks, "p1 bigint, p2 bigint, first bigint, ids string")
    text = text.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return text.mapInArrow(digests, "p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see the module, and ``rebuilt``): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations)
    parts = durable(stretches(turns))
    lengths = durable(lengths)

    counted = durable(nodes(parts.withColumns({"total": F.lit(0).cast("bigint"), "leaves": F.lit(0).cast("bigint")})))
    children = counted.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    children = durable(children)
    value = ((F.col("n") - 1) * F.col("chars")).alias("value")
    own = counted.join(children, ["p1", "p2"], "left").select("p1", "p2", "conv_id", "depth", value, F.col("n_children").isNull().cast("bigint").alias("leaf"))
    own = durable(own)
    totals = own.groupBy("conv_id").agg(F.sum("value").alias("total"), F.sum("leaf").alias("leaves"))

    # What the smallest member has above each of its nodes.
    level = F.floor(F.col("depth") / STRETCH)
    here = Window.partitionBy("conv_id", "level").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("level", level)
    higher = own.groupBy("conv_id", "level").agg(F.sum("value").alias("sum")).withColumn("higher", F.coalesce(F.sum("sum").over(along), F.lit(0)))
    above = own.withColumn("above", F.coalesce(F.sum("value").over(here), F.lit(0))).join(higher, ["conv_id", "level"])
    above = above.select("p1", "p2", (F.col("above") + F.col("higher")).alias("above"))

    weighed = parts.join(totals, "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "leaves")})
    found = nodes(weighed)
    root = lengths.select("conv_id").join(totals, "conv_id", "left").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves")
    )
    nothing = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    root = root.where("n > 0").select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), nothing.alias("q1"), nothing.alias("q2"), "conv_id", zero.alias("chars"), "n", "total", F.greatest("leaves", F.lit(1)).alias("leaves")
    )
    every = found.unionByName(root)
    parents = counted.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    parents = parents.unionByName(root.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id")))

    last = parts.withColumn("length", F.col("level") * STRETCH + F.size("h1")).join(lengths, ["conv_id", "length"])
    ends = last.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), "conv_id").unionByName(lengths.where("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))

    key = ["p1", "p2"]
    out = every.join(children, key, "left").join(above, key, "left").join(end_digests(ends), key, "left").join(parents, ["q1", "q2"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.coalesce("above", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
