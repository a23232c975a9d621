"""Near duplicates by min-max hashing.

A document is its set of three-word shingles. Each of ``PERMUTATIONS`` seeded permutations is evaluated once for each shingle and
leaves two values, the minimum and the maximum, so half the hash evaluations make a signature of the wanted length. Both agree
between two sets with the chance of their likeness, and they err in opposite places (a shingle cannot be first and last), so the
estimate from both has less variance than one from as many minima. Bands are made of ``ROWS`` minima or ``ROWS`` maxima of as many
permutations: a pair at the limit misses all of them with a chance of 4e-7 (``miss``).

Equal sets are one set from the start. In each bucket of a band every set is held against one of its members, the one that
meets most others in its buckets, on the full shingles; what that confirms is joined into components. Buckets that are then one component need nothing more, so a group of n
near copies costs about n comparisons. In the other ones the sets outside the largest component are compared with all sets of
other components, in blocks of bounded size: pairs whose signatures agree in ``FILTER`` of their values (six standard deviations
below the limit) are verified on the full sets where they meet, and only links that join components leave the task. The work of such
a bucket is the number of sets outside its largest component times its size.

Words: A-Z in lower case, split at white space. A text of one or two words is one shingle; a null text or one without words has no
set, is linked with nothing, and its component is itself. Each row is judged by its own text: rows with equal doc_id may be in
different components; a null doc_id comes last, and a component of null ids has none. ``kept`` says whether the row has the smallest
doc_id of its component (so all rows that share that id are kept). Very long texts are shingled whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path_join import LAST, _group_numbers, _intersections, _lowest, set_prints, whole_groups
from .common import U64, BitTable, components, durable, flat, lists, mix, pieces, prefix_sums, spans, text_marks, word_hashes

SHINGLE = 3
#: Links have at least this likeness, in percent.
PERCENT = 85
PERMUTATIONS = 40
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Share of signature values in which a pair must agree before its sets are compared.
FILTER = 0.6
#: Sets of a block that are compared with those of another one at once.
BLOCK = 512
DOCUMENT_BITS = 24
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def miss(likeness: float = PERCENT / 100) -> float:
    """Chance that a pair of this likeness shares no band."""
    return (1 - likeness**ROWS) ** BANDS


def shingle_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order, and their offsets."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), counts)
    start = offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    end = np.minimum(start + SHINGLE, offsets[1:][row])
    hashes = spans(prefix_sums(values), start, end) if len(row) else np.zeros(0, U64)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(counts)))])


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): minima, then maxima, as their high halves. ``starts``: where each set begins; none is empty."""
    seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U64))
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.int32)
    for k in range(PERMUTATIONS):
        image = (hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | U64(1))
        image ^= image >> U64(32)
        for place, end in ((k, np.minimum), (PERMUTATIONS + k, np.maximum)):
            out[:, place] = (end.reduceat(image, starts) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def _words(docs: DataFrame, *columns) -> DataFrame:
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), CAPITALS, SMALL)
    return docs.select(*columns, word_hashes(text).alias("words"))


def sets(docs: DataFrame) -> DataFrame:
    """(rank, t1, t2, sid, second, n, signature) of each row; no signature without a set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", 1 << 19):
            hashes, offsets = shingle_sets(*flat(batch.column("words")))
            sid, second = set_prints(hashes, offsets)
            n = np.diff(offsets)
            full = n > 0
            values = signatures(hashes, offsets[:-1][full]) if full.any() else np.zeros((0, 2 * PERMUTATIONS), np.int32)
            width = np.where(full, 2 * PERMUTATIONS, 0)
            columns = [
                *(batch.column(c) for c in ("rank", "t1", "t2")),
                pa.array(sid.view(np.int64)),
                pa.array(second.view(np.int64)),
                pa.array(n.astype(np.int64)),
                lists(values.ravel(), np.concatenate([[0], np.cumsum(width)]), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "t1", "t2", "sid", "second", "n", "signature"])

    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("rank")
    schema = "rank bigint, t1 bigint, t2 bigint, sid bigint, second bigint, n bigint, signature array<int>"
    return _words(docs, rank, *text_marks(F.col("text"))).mapInArrow(rows, schema)


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, sid, count) of each set and band that it shares with another set."""
    keys = [F.xxhash64(F.lit(b), *[F.get("signature", F.lit(ROWS * b + r)) for r in range(ROWS)]) for b in range(BANDS)]
    dealt = nodes.select("sid", F.posexplode(F.array(*keys)).alias("band", "bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("count")).where("count > 1")
    return dealt.join(shared, "bucket")


def stars(met: DataFrame) -> DataFrame:
    """(a, b): each set of a bucket with the bucket's pivot. That is the set that meets most others over all its buckets: the one that a
    group of near copies lies around, with which most of them are linked."""
    meets = met.groupBy("sid").agg(F.sum("count").alias("meets"))
    pivots = met.join(meets, "sid").groupBy("bucket").agg(F.max_by("sid", F.struct("meets", "sid")).alias("pivot"))
    return met.join(pivots, "bucket").where("sid <> pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, shingles) of the wanted sets, from the texts of their first documents. A bit table of fixed size tells which texts may be
    among those before they are shuffled."""
    rows = durable(nodes.join(wanted, "sid").select("sid", F.col("row.rank").alias("rank"), "row.t1", "row.t2"))
    table = docs.sparkSession.sparkContext.broadcast(BitTable.of(rows.select(F.xxhash64("rank", "t1", "t2").alias("h")), "h", DOCUMENT_BITS))

    @F.pandas_udf("boolean")
    def may_be(h):
        return h.__class__(table.value.has(h.to_numpy().view(np.uint64)))

    rank = F.coalesce("doc_id", F.lit(LAST)).alias("rank")
    few = docs.select(rank, *text_marks(F.col("text")), "text").where(may_be(F.xxhash64("rank", "t1", "t2")))
    few = _words(few.join(rows, ["rank", "t1", "t2"]), "sid")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", 1 << 19):
            hashes, offsets = shingle_sets(*flat(batch.column("words")))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), lists(hashes.view(np.int64), offsets, pa.int64())], names=["sid", "shingles"])

    return few.mapInArrow(shingled, "sid bigint, shingles array<bigint>").dropDuplicates(["sid"])


def confirmed(pairs: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links by their full sets."""
    one, two = (full.select(F.col("sid").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).select("a", "b")


def across(open_buckets: DataFrame, nodes: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between the components that meet in a bucket. ``open_buckets``: (bucket, band, sid, comp, rest, n_rest, count), where ``rest``
    marks the sets outside the bucket's largest component."""
    numbers = {c: F.ceil(F.col(n) / BLOCK).cast("int") for c, n in (("i", "n_rest"), ("j", "count"))}
    at = {c: F.pmod(F.xxhash64(F.lit(c), "sid"), k).cast("int") for c, k in numbers.items()}
    each = {c: F.explode(F.sequence(F.lit(0), k - 1)) for c, k in numbers.items()}
    columns = ["bucket", "band", "sid", "comp", "rest"]
    asking = open_buckets.where("rest").select(*columns, F.lit(True).alias("asks"), at["i"].alias("i"), each["j"].alias("j"))
    asked = open_buckets.select(*columns, F.lit(False).alias("asks"), at["j"].alias("j"), each["i"].alias("i"))
    keys = ("bucket", "i", "j")
    dealt = asking.unionByName(asked).join(nodes.select("sid", "signature"), "sid").join(full, "sid")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "sid")
    least = int(FILTER * 2 * PERMUTATIONS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 512):
            table = table.combine_chunks()
            sid, comp, band = (table.column(c).to_numpy() for c in ("sid", "comp", "band"))
            asks, rest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "rest"))
            signature = flat(table.column("signature").chunk(0), "int32")[0].reshape(-1, 2 * PERMUTATIONS)
            values, offsets = flat(table.column("shingles").chunk(0))
            starts = np.append(np.flatnonzero(np.diff(_group_numbers(table, keys), prepend=-1)), table.num_rows)
            left, right = [], []
            for first, end in zip(starts[:-1], starts[1:], strict=True):
                rows = np.arange(first, end)
                p, q = rows[asks[rows]], rows[~asks[rows]]
                for x in p:
                    y = q[(comp[q] != comp[x]) & (~rest[q] | (sid[q] > sid[x]))]
                    agree = signature[y] == signature[x]
                    y = y[agree.sum(axis=1) >= least]
                    # A pair that shares several buckets is settled in that of its first band.
                    bands = (signature[y] == signature[x]).reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1)
                    y = y[bands == band[x]]
                    left.append(np.full(len(y), x))
                    right.append(y)
            if not left or not sum(map(len, left)):
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            linked = _linked(used, place[: len(a)], place[len(a) :], values, offsets, percent)
            label = _lowest(len(used), place[: len(a)][linked], place[len(a) :][linked])
            joined = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(comp[used[joined]]), pa.array(comp[used[label[joined]]])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _linked(used: np.ndarray, a: np.ndarray, b: np.ndarray, values: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """Mask of the pairs (places in ``used``) whose full sets are linked."""
    taken = [values[offsets[r] : offsets[r + 1]] for r in used]
    n = np.array([len(s) for s in taken])
    if len(a) * 4 < len(used) ** 2:
        shared = np.array([len(np.intersect1d(taken[x], taken[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    else:
        shared = _intersections(taken)[a, b].astype(np.int64)
    return 100 * shared >= percent * (n[a] + n[b] - shared)


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    members = durable(sets(docs))
    nodes = members.where("n > 0").groupBy("sid", "second").agg(F.min(F.struct("rank", "t1", "t2")).alias("row"), F.first("signature").alias("signature"))
    nodes = durable(nodes)
    met = durable(buckets(nodes))
    full = durable(full_sets(docs, nodes, met.select("sid").distinct()))

    first = durable(components(confirmed(stars(met), full, percent)).withColumnRenamed("id", "sid").withColumnRenamed("root", "comp"))

    # Two sets that are alone in a bucket have been compared already.
    several = met.where("count > 2").join(first, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    sizes = several.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.max("size").alias("most"), F.count("*").alias("comps")).where("comps > 1")
    open_ = several.join(open_, "bucket").withColumns({"rest": F.col("comp") != F.col("main"), "n_rest": F.col("count") - F.col("most")})
    links = durable(across(open_, nodes, full, percent).distinct())
    second = components(links).select(F.col("id").alias("comp"), "root")

    placed = nodes.select("sid", "second", F.col("row.rank").alias("rank")).join(first, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    placed = placed.join(second, "comp", "left").withColumn("root", F.coalesce("root", "comp"))
    smallest = placed.groupBy("root").agg(F.min("rank").alias("component"))
    named = placed.join(smallest, "root").select("sid", "second", "component")
    result = members.select("rank", "sid", "second", "n").join(named, ["sid", "second"], "left")
    given = lambda c: F.when(c != LAST, c)
    component = F.coalesce("component", "rank")
    return result.select(
        given(F.col("rank")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        given(component).alias("component_id"),
        (F.col("rank") == component).alias("kept"),
    )
