"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two lines decides where chunks end: after a line where it is smaller than at the lines beside it. So a
chunk has two lines or more (but at the ends of a text), a line put in or taken out changes the chunks beside it only, and a
passage of several lines has the same chunks wherever it stands.

``without_repeats`` takes out chunks: one of two lines or more that stands more than once in the table is kept where it comes
first (smallest doc_id, then place) and removed elsewhere, after its bytes were compared with those of the first.

``without_repeated_runs`` (the registered query) begins with the same chunks and goes on line by line: a repeated run may begin
or end inside a chunk, or be shorter than one. All pairs of adjacent lines that are not inside a removed chunk are matched with
where they stand first, their bytes compared, and both lines go where they stand again. So of every run of two lines or
more that stands earlier no line is left. Pairs inside removed chunks are not looked at again: none of them can be the first of its
kind, since the chunk's own first comes before. Two lines that overlap their own first (a line three times in a row) are not
removed for it. Single repeated lines stay, and so do two lines without any character but white space.

Only chunks and pairs whose hash may be repeated are shuffled with their bytes; a bit table of fixed size tells (it passes all where
a corpus has many more repeated hashes than its 2**23 bits; results are the same). DataFrame functions only.

A null text stays null; an empty one stays. A null doc_id comes after all others. Repeated rows with one doc_id and text keep
one copy's chunks each where nothing smaller has them: equal documents with equal ids are one document. All columns are kept. An
empty table gives no rows. A document all of whose chunks go keeps its row, with an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

LEAST_LINES = 2
#: The bit table has 2**WORD_BITS longs, 64 bits each.
WORD_BITS = 17
LAST = 2**63 - 1


def with_chunks(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``chunks``, those of the text in order: structs (lines, n), whose lines joined by line feeds give it again.

    A boundary follows line i if the hash of lines i - 1 and i is smaller than those of the lines before and after; the first line has
    none. Each step is a column of its own, as a lambda would work out again, for each line, whatever expression it looks into. (So
    would the filter that Spark puts below a plain explode; hence the outer one where chunks become rows. A text always has a chunk.)
    """
    lines = df.withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    hashed = lines.withColumn("_line", F.transform("_lines", lambda x: F.xxhash64(x)))
    hashed = hashed.withColumn("_hashes", F.transform("_line", lambda h, i: F.when(i > 0, F.xxhash64(h, F.get("_line", i - 1)))))

    def lowest(h: Column, i: Column) -> Column:
        before, after = F.get("_hashes", i - 1), F.get("_hashes", i + 1)
        return h.isNotNull() & (before.isNull() | (h < before)) & (after.isNull() | (h <= after))

    cut = F.transform("_hashes", lambda h, i: F.when(lowest(h, i) | (i == F.size("_hashes") - 1), i))
    ended = hashed.withColumn("_ends", F.filter(cut, lambda i: i.isNotNull()))
    spans = F.transform("_ends", lambda end, k: F.struct((F.coalesce(F.get("_ends", k - 1), F.lit(-1)) + 1).alias("start"), end.alias("end")))
    spanned = ended.withColumn("_spans", spans)
    made = F.transform(
        "_spans",
        lambda s: F.struct(
            F.array_join(F.slice("_lines", s["start"] + 1, s["end"] - s["start"] + 1), "\n").alias("lines"),
            (s["end"] - s["start"] + 1).alias("n"),
            s["start"].alias("start"),
        ),
    )
    return spanned.withColumn("chunks", made).drop("_lines", "_line", "_hashes", "_ends", "_spans")


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("rank")


def _key() -> Column:
    return F.xxhash64("doc_id", "text", F.isnull("doc_id")).alias("key")


def _exploded(docs: DataFrame) -> DataFrame:
    keyed = docs.select(_rank(), _key(), "text")
    rows = with_chunks(keyed, F.col("text")).select("rank", "key", F.posexplode_outer("chunks").alias("at", "chunk"))
    rows = rows.select("rank", "key", "at", "chunk.lines", "chunk.n", "chunk.start", F.xxhash64("chunk.lines").alias("h"))
    return rows.where((F.col("n") >= LEAST_LINES) & F.col("lines").rlike(r"\S"))


def _bit(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 64 - WORD_BITS).cast("int"), F.shiftrightunsigned(h, 64 - WORD_BITS - 6).bitwiseAND(F.lit(63)).cast("int")


def _bit_table(hashes: DataFrame) -> DataFrame:
    """(word, bits) of the hashes h: 2**WORD_BITS rows at most."""
    word, bit = _bit(F.col("h"))
    return hashes.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits"))


def _passing(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows whose hash h the bit table has (and few others)."""
    word, bit = _bit(F.col("h"))
    marked = rows.withColumn("word", word).withColumn("bit", bit)
    return marked.join(F.broadcast(table), "word").where(F.expr("getbit(bits, bit)") == 1).drop("word", "bit", "bits")


def _told(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, key) of the documents that are not in ``lost`` (key), and of those that may be: the first do not meet any others."""
    table = durable(_bit_table(lost.select(F.xxhash64("key").alias("h"))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    seen = docs.select(row, _key()).withColumn("h", F.xxhash64("key"))
    word, bit = _bit(F.col("h"))
    told = seen.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(table), "word", "left")
    hit = F.coalesce(F.expr("getbit(bits, bit)") == 1, F.lit(False))
    return told.where(~hit).select("row", "key"), told.where(hit).select("row", "key")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n").alias("_lines")


def _pair(i: Column) -> Column:
    """Line i and the one before it."""
    return F.concat(F.get("_lines", i - 1), F.lit("\n"), F.get("_lines", i))


def _between(places: str, end: Column) -> Column:
    """What stands between sorted places, from 1 up to ``end`` (exclusive)."""
    bounds = F.concat(F.array(F.lit(0)), places)
    after = F.concat(places, F.array(end))
    some = F.transform(bounds, lambda a, k: F.when(F.get(after, k) > a + 1, F.sequence(a + 1, F.get(after, k) - 1)))
    return F.flatten(F.filter(some, lambda x: x.isNotNull()))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(rank, key, ats): the second lines of the pairs of lines that each document loses."""
    docs = docs.select("doc_id", "text")
    removed = durable(repeated_chunks(docs))
    whole, hits = _told(docs, removed)
    hits = hits.join(removed.drop("rank"), "key", "left").select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "spans")
    # Pairs inside removed chunks, but blank ones; then all others, which go on line by line.
    spans = F.sort_array(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    inside = hits.select(_rank(), _key(), _lines(F.col("text")), spans.alias("spans"))
    inside = inside.withColumn("_inside", F.flatten(F.transform("spans", lambda s: F.sequence(s["start"] + 1, s["end"]))))
    inside = inside.withColumn("_ats", F.filter("_inside", lambda i: _pair(i).rlike(r"\S")))
    rest = inside.select("rank", "key", "_lines", _between("_inside", F.size("_lines")).alias("_ats"))
    every = whole.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).select(_rank(), _key(), _lines(F.col("text")))
    n = F.size("_lines") - 1
    every = every.withColumn("_ats", F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    pairs = every.unionByName(rest)
    pairs = pairs.withColumn("_pairs", F.transform("_ats", lambda i: F.struct(i.alias("at"), _pair(i).alias("lines"))))
    rows = pairs.select("rank", "key", F.explode_outer("_pairs").alias("p")).select("rank", "key", "p.at", "p.lines").where(F.col("lines").rlike(r"\S"))
    found = _repeated(rows.withColumn("h", F.xxhash64("lines")), overlap=True).groupBy("rank", "key").agg(F.collect_set("at").alias("ats"))
    lost = inside.where(F.size("_ats") > 0).select("rank", "key", F.col("_ats").alias("ats")).distinct().unionByName(found)
    return lost.groupBy("rank", "key").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(rank, key, ats, spans): the numbers of the chunks that each document loses, and their first and last lines."""
    span = F.struct("start", (F.col("start") + F.col("n") - 1).alias("end"))
    return _repeated(_exploded(docs)).groupBy("rank", "key").agg(F.collect_set("at").alias("ats"), F.collect_set(span).alias("spans"))


def _repeated(found: DataFrame, overlap: bool = False) -> DataFrame:
    """Rows of ``found`` (rank, key, at, lines, h and others) whose lines stand in an earlier one."""
    place = F.struct("rank", "key", "at")
    counted = found.groupBy("h").agg(F.count("*").alias("count"), F.min(place).alias("first")).where("count > 1")
    repeated = durable(counted.select("h", "first"))
    shared = _passing(found, durable(_bit_table(repeated)))
    first = F.col("f.first")
    same = (F.col("c.rank") == first["rank"]) & (F.col("c.key") == first["key"])
    is_first = same & (F.col("c.at") == first["at"])
    # Bytes of the first of each hash, then of all, which are compared with them. Equal hashes of other bytes are kept.
    firsts = shared.alias("c").join(repeated.alias("f"), "h").where(is_first).dropDuplicates(["h"]).select("h", F.col("lines").alias("original"), "first")
    others = shared.alias("c").join(firsts.alias("f"), "h").where(~is_first & (F.col("lines") == F.col("original")))
    if overlap:
        others = others.where(~(same & (F.col("c.at") == first["at"] + 1)))
    return others.select("c.*")


def _taken_out(docs: DataFrame, repeated: DataFrame, cut: Callable[[DataFrame, Column], tuple[DataFrame, Column, Column]], count: str | None) -> DataFrame:
    """``docs`` without what ``repeated`` (rank, key, ats) names. ``cut`` gives rows, kept parts and number of lines taken out."""
    columns = docs.columns
    lost = durable(repeated)
    whole, hits = _told(docs, lost)
    text = F.col("row.text")
    rest = [F.col(f"row.`{c}`").alias(c) for c in columns if c != "text"]

    def shaped(df: DataFrame, new: Column, taken: Column) -> DataFrame:
        out = df.select(*rest, new.alias("text"), *([taken.cast("long").alias(count)] if count else []))
        return out.select(*[F.col(f"`{c}`") for c in columns], *([F.col(f"`{count}`")] if count else []))

    parts, kept, taken = cut(hits.join(lost.select("key", "ats"), "key", "left"), text)
    changed = shaped(parts, F.when(F.col("ats").isNull(), text).otherwise(F.array_join(kept, "\n")), taken)
    return shaped(whole, text, F.lit(0)).unionByName(changed)


def without_repeats(docs: DataFrame, count: str | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated chunks taken out of ``text``; ``count`` names a column for the lines taken out.

    Documents that lose nothing do not meet the others: a bit table of those that do tells them apart where they are read.
    """
    def cut(df: DataFrame, text: Column) -> tuple[DataFrame, Column, Column]:
        parts = with_chunks(df, text).withColumn("parts", F.transform("chunks", lambda c, i: F.struct(c["lines"].alias("lines"), c["n"].alias("n"), F.coalesce(F.array_contains("ats", i), F.lit(False)).alias("gone"))))
        kept = F.transform(F.filter("parts", lambda c: ~c["gone"]), lambda c: c["lines"])
        return parts, kept, F.aggregate(F.filter("parts", lambda c: c["gone"]), F.lit(0), lambda a, c: a + c["n"])

    return _taken_out(docs, repeated_chunks(docs), cut, count)


def without_repeated_runs(docs: DataFrame, count: str | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated runs of two lines or more taken out of ``text``; ``count`` as above."""

    def cut(df: DataFrame, text: Column) -> tuple[DataFrame, Column, Column]:
        ats = F.sort_array(F.coalesce("ats", F.array().cast("array<int>")))
        split = df.withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n")).withColumn("_ats", ats)
        split = split.withColumn("_tos", F.concat("_ats", F.array(F.size("_lines") + 1)))
        # What stands between two pairs that go, one slice each: work in proportion to the lines.
        between = F.transform(
            F.concat(F.array(F.lit(-1)), "_ats"), lambda a, k: F.slice("_lines", a + 2, F.greatest(F.get("_tos", k) - a - 2, F.lit(0)))
        )
        kept = split.withColumn("_kept", F.flatten(between))
        return kept, F.col("_kept"), F.size("_lines") - F.size("_kept")

    return _taken_out(docs, repeated_runs(docs), cut, count)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines) and kept_sha256 (of the text that is left; of nothing for null) of each document."""
    return _digest(docs, without_repeats)


def run_digest(docs: DataFrame) -> DataFrame:
    """The same columns, with repeated runs of lines taken out."""
    return _digest(docs, without_repeated_runs)


def _digest(docs: DataFrame, taken_out: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    source = docs.select("doc_id", "text")
    done = taken_out(source.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")), "n_removed")
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
