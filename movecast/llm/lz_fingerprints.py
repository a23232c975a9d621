"""Lempel-Ziv phrase fingerprints: parse a text into dictionary phrases, hash the set of phrases, keep minimum hashes.

A text is read from the left; each phrase is the shortest piece not yet in the text's own dictionary and joins it. Texts that
compress alike share phrases, so the likeness of two fingerprints (the share of equal minima) estimates the Jaccard likeness of
their phrase sets. Equal texts have equal fingerprints. A null text counts as empty; an empty text has no phrases, is alike (1)
only to another empty text and not at all (0) to others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, U64, mix

#: Slots of a fingerprint, 16 bits each. The share of equal slots has a standard error of 0.044 at most.
SLOTS = 128
#: Rows of a run of consecutive documents, on average; runs are read as streams, never held.
ROWS_PER_RUN = 1000
MOST_RUNS = 20_000

_EDGES = np.arange(SLOTS, dtype=np.uint64) << U64(64 - SLOTS.bit_length() + 1)
#: Where a slot without phrases of its own looks for another's minimum: the same places for every text.
_PROBES = np.random.default_rng(20240607).integers(0, SLOTS, (SLOTS, 64))
EMPTY = np.zeros(SLOTS, np.uint16)


def parse(text: str, known: dict[str, None] | None = None, begun: str = "") -> tuple[dict[str, None], str]:
    """Dictionary of ``text`` after that of what came before (``known``, in which the phrase ``begun`` is unfinished), in order
    of its phrases; and the unfinished last phrase."""
    known = {} if known is None else known
    phrase = begun
    for c in text:
        phrase += c
        if phrase not in known:
            known[phrase] = None
            phrase = ""
    return known, phrase


def signature(text: str, known: dict[str, None]) -> np.ndarray:
    """Minimum hash in each slot over the phrases, which follow each other in ``text``; what is left at its end (a phrase
    that the dictionary has already) adds nothing to the set."""
    if not known:
        return EMPTY
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    up, down = POWERS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    bounds = np.zeros(len(known) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, known), np.int64, len(known)), out=bounds[1:])
    h = np.sort(mix((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]]))
    first = np.searchsorted(h, _EDGES)
    found = np.append(h, U64(0))[first]
    full = (first < len(h)) & (found >= _EDGES) & (found - _EDGES < _EDGES[1])
    if not full.all():
        slots = np.flatnonzero(~full)
        probes = np.concatenate([_PROBES[slots], np.full((len(slots), 1), np.flatnonzero(full)[0])], axis=1)
        source = probes[np.arange(len(slots)), full[probes].argmax(axis=1)]
        found[slots] = mix(found[source] + slots.astype(U64))
    return (found & U64(0xFFFF)).astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    return signature(text or "", parse(text or "")[0])


def both_fingerprints(text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts whose first ``shared`` characters are equal; those are parsed once."""
    known, begun = parse(text[:shared])
    other = known.copy()
    return signature(text, parse(text[shared:], known, begun)[0]), signature(edited, parse(edited[shared:], other, begun)[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a is EMPTY or b is EMPTY:
        return float(a is b)
    return float((a == b).mean())


def as_text(signature_: np.ndarray) -> str:
    return signature_.astype(">u2").tobytes().hex()


def runs(df: DataFrame, key: str, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Number the rows' runs: run k holds the keys over the k-th bound up to the next, whose row also goes, marked, to the
    run above it: in falling order it follows that run's last row. Columns ``run`` and ``guest`` are added.

    Bounds are keys found by an approximate quantile over all rows. Nulls count as the least key.
    """
    rank = F.coalesce(F.col(key), F.lit(-(2**63)))
    count = df.count()
    n = min(MOST_RUNS, max(1, count // rows_per_run))
    shares = [(k + 1) / n for k in range(n)]
    bounds = df.select(F.percentile_approx(rank, shares, 100_000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array([*bounds, *([df.agg(F.max(rank)).first()[0]] if count else [])], np.int64))
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """The row's run; of a bound's row also the run above."""
        x = ids.to_numpy(np.int64)
        own = np.searchsorted(bounds, x)
        edge = bounds[own] == x
        return pd.Series([[int(r), int((r + 1) % last)] if e else [int(r)] for r, e in zip(own, edge, strict=True)])

    kept = df.columns
    return df.select(*kept, F.posexplode(places(rank)).alias("guest", "run")).withColumn("guest", F.col("guest") > 0)


def next_pairs(df: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Rows of ``df`` (doc_id, text) in order: by run, then falling doc_id (nulls last, equal ids by text), the guest at the end."""
    placed = runs(df.select("doc_id", "text"), "doc_id", rows_per_run)
    order = [F.col("run"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    return placed.repartition("run").sortWithinPartitions(*order)


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with what follows it; only two texts are held at a time."""
    out: list[list] = []  # the last row lacks its likeness to the next document until that one's fingerprint is known
    held: tuple | None = None  # the document whose next one has yet to come

    def finish(doc: tuple, after: str) -> None:
        text = doc[1]
        cut = len(text) // 3
        shared = len(text) - cut
        edited = text[:shared] + after[:cut]
        own, changed = both_fingerprints(text, edited, shared)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        follow(own)
        out.append([doc[0], len(text), sha, own, changed, likeness(own, changed), None])

    def follow(own: np.ndarray) -> None:
        if out and out[-1][6] is None:
            out[-1][6] = likeness(out[-1][3], own)

    for batch in batches:
        for doc_id, text, run, guest in zip(*(batch.column(c) for c in ("doc_id", "text", "run", "guest")), strict=True):
            doc = (doc_id.as_py(), text.as_py() or "", run.as_py())
            if guest.as_py():  # follows the last row of its run and has no row here; more guests are later ones of equal id
                if held is not None:
                    finish(held, doc[1])
                    follow(fingerprint(doc[1]))
                held = None
                continue
            if held is not None:
                if held[2] != doc[2]:
                    raise RuntimeError("a run ended without the document that follows it")
                finish(held, doc[1])
            held = doc
            if len(out) > 512:
                yield _rows(out[:-1])
                del out[:-1]
    if held is not None:
        raise RuntimeError("a run ended without the document that follows it")
    if out:
        yield _rows(out)


def _rows(rows: list[list]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns[3], columns[4] = ([as_text(x) for x in columns[c]] for c in (3, 4))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:7], kinds, strict=True)], names=names)


def edit_digest(docs: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last third replaced by the beginning of the next document's
    text, in falling doc_id; the first document follows the last), and how alike they are; and how like the next document.

    Equal ids follow each other by text; rows with a null id come last. An empty table gives no rows; other columns are ignored.
    """
    pairs = next_pairs(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), rows_per_run)
    return pairs.mapInArrow(_digest, SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the column ``fingerprint`` (a column of that name is replaced). One pass, no shuffle."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(fingerprint(t)) for t in texts.where(texts.notna(), None)])

    return docs.withColumn("fingerprint", of(F.col("text")))
