"""Embedding whitening by digit-slice GEMM: exact covariances of integer vectors, then their eigenvectors.

Centred integers are cut into limbs of a few bits, so that float64 matrix products of limbs are exact; the products are
recombined as big integers, merged over all tasks, and only the finished covariance becomes floating point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, finite, forget, kept, table

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Products of limbs have 2 * LIMB bits; sums over ROWS rows stay under 2^53. DIGIT: bits of the digits in which partial
#: sums leave a task.
LIMB, ROWS, DIGIT, DIGITS = 20, 4096, 32, 5
LARGEST = 1 << 40  # an entry's largest absolute value
FLAT = 1e-12  # a component with less of the largest component's variance has no direction


def shifted(df: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """vec_id and x, floor(scale * c) + shift of each entry c as long, of the rows whose vector is neither null nor holds null
    or non-finite entries; and the length of the longest. Shorter vectors count as ended with zeros."""
    good = df.filter(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    d = good.agg(F.max(F.size("c"))).first()[0] or 0
    x = F.transform("c", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + shift)
    return good.select("vec_id", F.concat(x, F.array_repeat(F.lit(shift).cast("long"), d - F.size("c"))).alias("x")), d


def longs(column: pa.Array, d: int) -> np.ndarray:
    """Lists of d longs as rows."""
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if np.abs(out).max(initial=0) >= LARGEST:
        raise OverflowError("entries beyond 2^40 are not supported")
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact; raises where it does not fit."""
    if n * (np.abs(x).max(initial=0) + float(np.abs(sums).max(initial=0)) / n) >= 2.0**62 and np.abs(n * (x.astype(float) - sums / n)).max(initial=0) >= 2.0**62:
        raise OverflowError("n * x - S does not fit a long")
    return x * np.int64(n) - sums  # what wraps on the way comes back


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as sum of limb i times 2^(LIMB * i), each a float64 matrix; the last limb has the sign."""
    out, rest = [], y
    while True:
        if np.abs(rest).max(initial=0) < 1 << LIMB:
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB


class Gram:
    """The exact sum of y'y over the rows given to add(), as big integers."""

    def __init__(self, d: int):
        self.total, self.sums, self.added = np.zeros((d, d), object), {}, 0

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), ROWS):
            parts = limbs(y[at : at + ROWS])
            for i, a in enumerate(parts):
                for j in range(i, len(parts)):
                    p = (a.T @ parts[j]).astype(np.int64)  # exact: below 2^53
                    self.sums[i + j] = self.sums.get(i + j, 0) + (p if i == j else p + p.T)
            self.added += 1
            if self.added % 64 == 0:  # sums of 64 blocks, up to 4 products each, stay below 2^62
                self.recombined()

    def recombined(self) -> np.ndarray:
        for place, p in self.sums.items():
            self.total += p.astype(object) << (LIMB * place)
        self.sums = {}
        return self.total


def digits(value: int) -> list[int]:
    """DIGITS digits, the last with the sign; sums of them fit longs for two billion tasks."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


@dataclass
class Whitening:
    """n fitted vectors with per-dimension sums; unit eigenvectors (columns) and values of their covariance by falling value,
    its trace, and the largest entry by which the whitened vectors' covariance differs from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def scale(self) -> np.ndarray:
        """Eigenvectors over the roots of their values; zero where a component has no direction."""
        good = self.values > FLAT * max(self.values.max(initial=0), 0)
        return np.where(good, self.vectors / np.sqrt(np.where(good, self.values, 1)), 0)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct x of vectors. The driver gets d * d numbers, whatever the rows."""
    spark = vectors.sparkSession
    distinct, path = kept(vectors.select("x").distinct(), "whitening")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, np.int64)
        for b in batches:
            n, s = n + b.num_rows, s + longs(b.column(0), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.int64()))], ["n", "s"])

    found = distinct.mapInArrow(totals, "n long, s array<long>").agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(d)]).first()
    n, sums = found[0] or 0, np.array([x or 0 for x in found[1:]], np.int64)
    if not n or not d:
        forget(spark, path)
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gram(d)
        for b in batches:
            g.add(centred(longs(b.column(0), d), n, sums))
        m, (i, j) = g.recombined(), np.triu_indices(d)
        parts = zip(*(digits(int(m[a, b])) for a, b in zip(i, j, strict=True)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(p, pa.int64()) for p in parts]], ["i", "j", *[f"p{k}" for k in range(DIGITS)]])

    names = [f"p{k}" for k in range(DIGITS)]
    merged = distinct.mapInArrow(products, "i int, j int, " + ", ".join(f"{p} long" for p in names)).groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in names]).collect()
    v, trace = np.zeros((d, d)), 0
    for r in merged:
        whole = sum(r[p] << (DIGIT * k) for k, p in enumerate(names))
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = whole / n**3  # of integers: correctly rounded
        trace += whole if r["i"] == r["j"] else 0
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    made = Whitening(n, sums, values, axes, trace / n**3)
    w, m = made.scale(), len(values)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p = np.zeros(m), np.zeros((m, m))
        for b in batches:
            z = (centred(longs(b.column(0), d), n, sums) / n) @ w
            s, p = s + z.sum(axis=0), p + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m + m * m), pa.int32()), pa.array(np.r_[s, p.ravel()])], ["i", "s"])

    sums_of = np.zeros(m + m * m)
    for r in distinct.mapInArrow(spread, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums_of[r["i"]] = r["s"]
    forget(spark, path)
    mean = sums_of[:m] / n
    has = np.diag(np.any(w != 0, axis=0).astype(float))
    made.identity_error = float(np.abs(sums_of[m:].reshape(m, m) / n - np.outer(mean, mean) - has).max(initial=0))
    return made


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row for each row of df (vec_id,
    embedding) whose vector is whole, and each of its components.

    Rows whose vector is null or holds null or non-finite entries are left out; repeated rows come out repeated but are
    fitted once, and so do rows with a null vec_id. Vectors of unequal length count as ended with zeros. A component in
    which the fitted vectors do not differ (fewer vectors than components, equal vectors) has null for whitened, and so
    has explained if none differ. No rows: no rows. Entries beyond 2^40, or a deviation beyond a long, raise an error.
    Further columns are ignored. Components whose variances are equal may be any basis of their plane.
    """
    bounded(df.sparkSession)
    given, d = shifted(df, scale, shift)
    got = fit(given, d, components)
    n, sums, w, m = got.n, got.sums, got.scale(), len(got.values)
    flat = ~np.any(w != 0, axis=0)
    shares = (got.values / got.trace).tolist() if got.trace else [None] * m
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            if not rows or not m:
                continue
            y = centred(longs(b.column(1), d), n, sums)
            if float(np.abs(y).max()) ** 2 * d >= 2.0**62:
                exact = (y.astype(object) ** 2).sum(axis=1).tolist()
                if max(exact) >= 1 << 63:
                    raise OverflowError("a deviation does not fit a long")
                deviation = np.array(exact, np.int64)
            else:
                deviation = (y * y).sum(axis=1)
            z = (y / n) @ w
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(rows), m))), pa.array(np.tile(np.arange(1, m + 1), rows), pa.int32()), pa.array(np.full(rows * m, n)), pa.array(np.repeat(deviation, m)),
                    pa.array(z.ravel(), mask=np.tile(flat, rows)), pa.array(shares * rows, pa.float64()), pa.array(np.full(rows * m, got.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return given.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
