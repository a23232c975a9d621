"""Quality classifier: an ordinal cumulative-link regression on graded ratings.

A document's words, their beginnings of four and five letters, and steps of some shares (capitals, signs, distinct words) are
hashed into one space of weights, shared by all grades; ordered thresholds cut the score into grades: P(grade >= k) is the
logistic function of score - threshold k. It gives an expected grade and, for selection, the probability of the top grade.

Grades come from the labels: 0 toxic, 1 poor, 2 good. Weights are fitted on at most ``SAMPLE`` labelled documents, those with the
least hash of their id; all documents are scored. Features are made by DataFrame functions and summed in numpy.

A null text counts as empty; it has the features of the shares only. Labels with a null in any column and labels of unknown
documents are left out; of several labels of one document the least grade counts. Without any label all documents are kept,
with probability 1. Rows with equal texts get equal scores; all columns are kept, and added ones replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, pieces

BITS = 18
#: Most labelled documents that the fit reads, whatever the table.
SAMPLE = 8_000
ROUNDS = 150
RATE = 0.05
L2 = 2e-3
#: A feature has a weight if at least this share of the sample, and three documents, have it.
LEAST_SHARE = 1 / 400
TAIL = 0.5
GRADES = 3


def features(df: DataFrame, text: Column, name: str = "features") -> DataFrame:
    """``df`` with the places of a text's features among the 2**BITS weights, each once."""
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << BITS)).cast("int")
    text = F.coalesce(text, F.lit(""))
    worded = df.withColumn("_words", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    hashed = F.transform("_words", lambda w: F.array(place(w), place(F.left(w, F.lit(4)), F.lit(4)), place(F.left(w, F.lit(5)), F.lit(5))))
    placed = worded.withColumn("_n", F.size("_words")).withColumn("_places", F.flatten(hashed)).withColumn("_distinct", F.array_distinct("_places"))
    step = lambda a, b: F.least(F.floor(10 * a / F.greatest(b, F.lit(1))), F.lit(10))
    shares = [
        step(F.regexp_count(text, F.lit(r"\p{Lu}")), F.length(text)),
        step(F.regexp_count(text, F.lit(r"[#$%&*|!]")), F.col("_n")),
        step(F.size("_distinct"), F.size("_places")),
    ]
    marks = F.array(*[place(F.lit(f"share {k}"), s) for k, s in enumerate(shares)])
    return placed.withColumn(name, F.array_distinct(F.concat("_distinct", marks))).drop("_words", "_n", "_places", "_distinct")


class Ordinal:
    """Weights and thresholds, as numpy arrays."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(places: np.ndarray, offsets: np.ndarray, grades: np.ndarray, grades_n: int = GRADES) -> Ordinal:
        """Adam on the log-likelihood with an L2 penalty. Rare features keep weight 0."""
        size = 1 << BITS
        often = np.bincount(places, minlength=size) >= max(3, LEAST_SHARE * len(grades))
        row = np.repeat(np.arange(len(grades)), np.diff(offsets))
        use = often[places]
        row, places = row[use], places[use]
        used, at = np.unique(places, return_inverse=True)
        n = len(grades)
        w = np.zeros(len(used))
        share = np.array([(grades >= k).mean() for k in range(1, grades_n)]).clip(1e-3, 1 - 1e-3)
        first = -np.log(share / (1 - share))
        gaps = np.append(first[0], np.log(np.maximum(np.diff(first), 1e-2)))  # thresholds: the first, and logs of their gaps
        m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
        for t in range(1, ROUNDS + 1):
            cuts = np.cumsum(np.append(gaps[0], np.exp(gaps[1:])))
            z = np.bincount(row, weights=w[at], minlength=n)
            p = 1 / (1 + np.exp(-(z[:, None] - cuts).clip(-35, 35)))  # P(grade >= k), falling in k
            full = np.column_stack([np.ones(n), p, np.zeros(n)])
            chance = (full[np.arange(n), grades] - full[np.arange(n), grades + 1]).clip(1e-9)
            slope = np.column_stack([np.zeros(n), p * (1 - p), np.zeros(n)])
            up, down = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
            dz = (up - down) / chance
            dcut = np.zeros((n, grades_n + 1))
            dcut[np.arange(n), grades] -= up / chance
            dcut[np.arange(n), grades + 1] += down / chance
            dcut = dcut[:, 1:-1].mean(axis=0)
            gw = np.bincount(at, weights=(dz / n)[row], minlength=len(w)) - L2 * w
            ggap = np.append(dcut.sum(), [dcut[k:].sum() * np.exp(gaps[k]) for k in range(1, len(gaps))])
            g = np.concatenate([gw, ggap])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, gaps = w + move[: len(w)], gaps + move[len(w) :]
        weights = np.zeros(size, np.float32)
        weights[used] = w
        return Ordinal(weights, np.cumsum(np.append(gaps[0], np.exp(gaps[1:]))))

    def tails(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each document."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
        z = sums[offsets[1:]] - sums[offsets[:-1]]
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds).clip(-35, 35)))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    whole = labels.select("doc_id", "quality", "toxic").dropna()
    return whole.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """A model fitted on at most ``sample`` labelled documents; None without any."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = features(texts, F.col("text")).groupBy("doc_id", "grade").agg(F.min("features").alias("features")).select("grade", "features").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    places, offsets = flat(rows["features"].combine_chunks(), "int32")
    return Ordinal.fit(places.astype(np.int64), offsets, rows["grade"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_good``, the probability of the top grade."""
    added = ("expected_grade", "p_good")
    kept = [c for c in docs.columns if c not in added]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(float(GRADES - 1)).alias(added[0]), F.lit(1.0).alias(added[1]))
    rows = features(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")), F.col("row.text"))
    table = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "features"):
            tails = table.value.tails(*flat(batch.column("features"), "int32"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=["row", *added])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, expected_grade double, p_good double"
    return rows.mapInArrow(judge, schema).select("row.*", *added)


def select_good(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose probability of the top grade is ``tail`` or more."""
    kept = docs.columns
    return score(docs, train(docs, labels)).where(F.col("p_good") >= tail).select(*[F.col(f"`{c}`") for c in kept])


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, p_good and keep of each document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), (F.col("p_good") >= TAIL).alias("keep"))
