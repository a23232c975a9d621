"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum of its centred scatter matrix and takes in one vector after the other: a vector moves the mean
and adds one centred rank-one term. The new eigenvalues are the roots of a secular equation; entries without weight and equal
eigenvalues are deflated first, and the eigenvectors follow from weights that fit the roots exactly, so they stay orthogonal.
Spectra of partitions are combined, eight at a time and round after round, by successive rank-one updates: one for each eigenpair
of the other and one for the distance of the means. What rounding has left is taken out by a distributed Rayleigh-Ritz step: the
covariance in the found basis is summed over all vectors, and its small eigenproblem gives the final pairs.

Entries c become x = floor(1024 c) + 100000, whose sums are exact. Nothing larger than a square matrix of the vectors' length
reaches the driver or a combining task.

Rows whose vector is null, or has null or non-finite entries, are left out; one that is shorter than the longest counts as having
null entries. Rows with a null or repeated vec_id, and repeated rows, are rows of their own. Components whose eigenvalue is zero
(below 1e-12 of the trace: constant or dependent entries, a single vector) cannot be whitened and are left out, so fewer than
eight may come, or none. A deviation beyond 64 bits is null. An empty table gives no rows. Equal eigenvalues: any basis of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, flat

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Spectra that one task combines.
FAN_IN = 8
#: Eigenvalues below this share of the trace count as zero.
ZERO = 1e-12
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', for ascending distinct d and z without zeros.

    Returns the roots and ``gaps[j, i] = root j - d[i]``, accurate also where the difference is tiny: each root is searched for as
    its distance from the nearer of the two entries of d around it, by a rational model with bisection as a fallback.
    """
    k = len(d)
    last = np.arange(k) == k - 1
    above = np.append(d[1:], d[-1] + rho * z2.sum())
    half = (above - d) / 2
    weight = rho * z2
    left = (1 + (weight / (d - (d + half)[:, None])).sum(axis=1) >= 0) | last
    origin = np.where(left, d, above)
    delta = d - origin[:, None]
    far = np.where(last, 2 * half, half)
    low, high = np.where(left, 0.0, -half), np.where(left, far, 0.0)
    mu = (low + high) / 2
    below, beyond = d - origin, above - origin
    upto = np.tri(k, dtype=bool)
    for _ in range(100):
        gap = delta - mu[:, None]
        term = weight / gap
        f = 1 + term.sum(axis=1)
        done = np.abs(f) <= 4 * k * EPS * (1 + np.abs(term).sum(axis=1))
        negative = f < 0
        low, high = np.where(negative, mu, low), np.where(negative, high, mu)
        if (done | (high - low <= 2 * EPS * np.abs(mu))).all():
            break
        slope = term / gap
        both = slope.sum(axis=1)
        psi = np.where(upto, slope, 0).sum(axis=1)
        a_, b_ = below - mu, beyond - mu
        c = f - a_ * psi - b_ * (both - psi)
        a = (a_ + b_) * f - a_ * b_ * both
        b = a_ * b_ * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        mu = np.where(done, mu, np.where((new > low) & (new < high), new, (low + high) / 2))
    return origin + mu, mu[:, None] - delta


def rotation(d: np.ndarray, z: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors for roots with these gaps: of the weights for which the roots are exact, not of ``z``."""
    k = len(d)
    denominator = np.ones((k, k))
    i, j = np.indices((k, k))
    inner = j < k - 1
    other = np.where(j < i, j, np.minimum(j + 1, k - 1))
    denominator[inner] = (d[other] - d[i])[inner]
    weights = np.sqrt(np.abs(np.prod(gaps.T / denominator, axis=1))) * np.where(z < 0, -1.0, 1.0)
    vectors = weights[:, None] / -gaps.T
    return vectors / np.sqrt((vectors * vectors).sum(axis=0))


class Spectrum:
    """Count and mean of vectors, and the eigenpairs of their centred scatter matrix (ascending; vectors are columns)."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def update(self, rho: float, v: np.ndarray) -> None:
        """Add ``rho v v'`` to the scatter matrix."""
        d, z = self.values, v @ self.vectors
        norm2 = float(z @ z)
        scale = max(float(d[-1]), rho * norm2)
        if not scale > 0:
            return
        rho, z = rho * norm2, z / np.sqrt(norm2)
        tol = 8 * EPS * scale
        live = np.flatnonzero(rho * np.abs(z) > tol)
        live = self._merge_equal(d, z, live, tol)
        if len(live):
            part = d[live]
            with np.errstate(all="ignore"):
                roots, gaps = secular_roots(part, z[live] ** 2, rho)
                turn = rotation(part, z[live], gaps)
            d[live] = roots
            self.vectors[:, live] = self.vectors[:, live] @ turn
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], self.vectors[:, order]

    def _merge_equal(self, d: np.ndarray, z: np.ndarray, live: np.ndarray, tol: float) -> np.ndarray:
        """Turn pairs of (nearly) equal eigenvalues so that only one of them has weight; what is left with weight."""
        if len(live) < 2:
            return live
        a, b = z[live[:-1]], z[live[1:]]
        if not (np.abs((d[live[1:]] - d[live[:-1]]) * a * b) <= tol * (a * a + b * b)).any():
            return live
        kept, p = [], live[0]
        for q in live[1:]:
            size = np.hypot(z[p], z[q])
            c, s = z[q] / size, -z[p] / size
            if abs((d[q] - d[p]) * c * s) <= tol:
                z[p], z[q] = 0.0, size
                one, two = self.vectors[:, p].copy(), self.vectors[:, q].copy()
                self.vectors[:, p], self.vectors[:, q] = c * one + s * two, c * two - s * one
                d[p], d[q] = d[p] * c * c + d[q] * s * s, d[p] * s * s + d[q] * c * c
            else:
                kept.append(p)
            p = q
        kept.append(p)
        kept = np.array(kept)
        order = np.argsort(d[kept], kind="stable")
        return kept[order]

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """Take in ``times`` copies of x."""
        step, n = x - self.mean, self.n
        if n:
            self.update(n * times / (n + times), step)
        self.n = n + times
        self.mean = self.mean + step * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        step, n = other.mean - self.mean, self.n
        if n:
            self.update(n * other.n / (n + other.n), step)
        for k in np.flatnonzero(other.values > 0):
            self.update(float(other.values[k]), other.vectors[:, k])
        self.n = n + other.n
        self.mean = self.mean + step * (other.n / self.n)

    def row(self, part: int, sums: np.ndarray) -> pa.RecordBatch:
        one = lambda v, kind: pa.array([v], kind)
        floats = pa.list_(pa.float64())
        columns = [one(part, pa.int64()), one(self.n, pa.int64()), one(sums, pa.list_(pa.int64())), one(self.mean, floats), one(self.values, floats), one(self.vectors.ravel(), floats)]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    @staticmethod
    def of(n: int, mean, values, vectors) -> Spectrum:
        out = Spectrum(len(mean))
        out.n, out.mean, out.values = n, np.array(mean), np.array(values)
        out.vectors = np.array(vectors).reshape(len(out.mean), -1)
        return out


_SPECTRUM = "part bigint, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"
_NAMES = [c.split()[0] for c in _SPECTRUM.split(", ")]


def _levels(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, width) of x = floor(1024 c) + 100000."""
    values, _ = flat(batch.column("embedding"), "float64")
    return (np.floor(SCALE * values) + SHIFT).astype(np.int64).reshape(-1, width)


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles) of the rows that take part, and their width."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("embedding").isNotNull()).where(F.forall("embedding", finite))
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return vectors.where(F.size("embedding") == width), width


def partial_spectra(vectors: DataFrame, width: int) -> DataFrame:
    """One spectrum for each partition that has vectors."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = Spectrum(width), np.zeros(width, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _levels(batch, width)
                sums += x.sum(axis=0)
                distinct, times = np.unique(x, axis=0, return_counts=True)
                for row, n in zip((distinct - SHIFT).astype(float), times.tolist(), strict=True):
                    spectrum.add(row, n)
        if spectrum.n:
            yield spectrum.row(TaskContext.get().partitionId(), sums)

    return vectors.select("embedding").mapInArrow(fit, _SPECTRUM)


def combined(spectra: DataFrame) -> tuple[Spectrum, np.ndarray] | None:
    """The spectrum of all vectors and their exact sums; None if there are none."""

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total, sums = Spectrum(len(rows[0]["mean"])), np.zeros(len(rows[0]["mean"]), np.int64)
        for r in rows:
            total.merge(Spectrum.of(r["n"], r["mean"], r["values"], r["vectors"]))
            sums += np.array(r["sums"], np.int64)
        return pa.Table.from_batches([total.row(rows[0]["part"] // FAN_IN, sums)])

    spectra = durable(spectra)
    while spectra.count() > 1:
        spectra = durable(spectra.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(combine, _SPECTRUM))
    row = spectra.first()
    return row and (Spectrum.of(row["n"], row["mean"], row["values"], row["vectors"]), np.array(row["sums"], np.int64))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S as exact integers, and x - S / n."""
    with np.errstate(over="ignore"):
        exact = n * x - sums
    return exact, exact / n


def summed_products(vectors: DataFrame, width: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the vectors in ``basis`` (columns), centred before multiplying; summed over partitions by Spark."""
    size = basis.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                g = _centred(_levels(batch, width), n, sums)[1] @ basis
                total += g.T @ g
                first += g.sum(axis=0)
        values = np.concatenate([total.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    parts = vectors.select("embedding").mapInArrow(multiply, "place int, value double")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size * size + size)
    out[rows["place"].to_numpy()] = rows["value"].to_numpy()
    mean = out[size * size :] / n
    return out[: size * size].reshape(size, size) / n - np.outer(mean, mean)


def refined(vectors: DataFrame, width: int, spectrum: Spectrum, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors (columns) and trace of the covariance, by a Rayleigh-Ritz step in the found basis."""
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    v = summed_products(vectors, width, spectrum.n, sums, basis)
    values, turn = np.linalg.eigh((v + v.T) / 2)
    return values[::-1], basis @ turn[:, ::-1], float(np.trace(v))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and leading component."""
    vectors, width = usable(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    found = combined(partial_spectra(vectors, width)) if width else None
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    spectrum, sums = found
    n = spectrum.n
    values, axes, trace = refined(vectors, width, spectrum, sums)
    m = int((values[:components] > ZERO * trace).sum())
    explained = values[:m] / trace if m else values[:0]
    scaled = axes[:, :m] / np.sqrt(values[:m])
    error = float(np.abs(summed_products(vectors, width, n, sums, scaled) - np.eye(m)).max()) if m else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if rows and m:
                exact, centred = _centred(_levels(batch, width), n, sums)
                with np.errstate(over="ignore"):
                    deviation = (exact * exact).sum(axis=1)
                beyond = (exact.astype(float) ** 2).sum(axis=1) >= 2.0**63 * (1 - 1e-9)
                owner = np.repeat(np.arange(rows), m)
                every = lambda v: pa.array(np.full(rows * m, v))
                columns = [
                    batch.column("vec_id").take(pa.array(owner)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                    every(np.int64(n)),
                    pa.array(deviation[owner], mask=beyond[owner]),
                    pa.array((centred @ scaled).ravel()),
                    pa.array(np.tile(explained, rows)),
                    every(error),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(project, schema)
