"""What the operators of this subpackage share: reading tables, shared scratch tables, words and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches of a session that says nothing else: texts can be long, and a task and its worker hold a batch each.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt anew where the scan has fewer tasks than the session has cores (a small file is one task)."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither
    is set a session in one process (tests) gets a folder of its own; a cluster must name one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not have.isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = have.get()
    return root.rstrip("/")


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written once as Parquet to the shared folder and read again, and where: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return kept(df, label)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded(spark: SparkSession) -> None:
    """Where the session leaves the size of Arrow batches to Spark it gets BATCH; a set value stays."""
    for key, value in BATCH.items():
        if spark.conf.get(key, "1") != spark.conf.get(key, "2"):  # answered by the defaults given here
            spark.conf.set(key, value)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def finite(column: str) -> Column:
    """Whether a vector is neither null nor holds null or non-finite entries."""
    x = F.col(column).cast("array<double>")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def text_size(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a column's texts."""
    return docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def carried(names: list[str], own: Iterable[str]) -> list[str]:
    """names without those that own has, whatever their case."""
    ours = {n.lower() for n in own}
    return [n for n in names if n.lower() not in ours]


def with_text(docs: DataFrame, carry: list[str], *more: Column) -> DataFrame:
    """What a task sends to its worker: carry, more and the text as __text. The text goes once, also where it is carried."""
    bounded(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in carry if c != "text"], *more, F.col("text").cast("string").alias("__text"))


def carried_fields(docs: DataFrame, carry: list[str]) -> list[T.StructField]:
    return [T.StructField("text", T.StringType()) if c == "text" else docs.schema[c] for c in carry]


def carried_columns(batch: pa.RecordBatch | pa.Table, carry: list[str]) -> list:
    """The columns of carry of a batch of with_text()."""
    return [batch.column("__text" if c == "text" else c) for c in carry]


def texts_of(batch: pa.RecordBatch, column: str = "__text") -> list[bytes]:
    """A batch's texts as bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def rows(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows: bounds what a Python worker holds beside a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


#: Odd multipliers of the polynomial hashes of windows and words.
BASE, LETTER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of LETTER and of its inverse, as many as were needed


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((LETTER, pow(LETTER, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) byte of each word."""
    edge = np.flatnonzero(np.diff(_BLANK[np.frombuffer(data, np.uint8)], prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, piece: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of every word of a text; equal words have equal hashes in every text. Sums of bytes times powers are
    taken for all words at once, for pieces of a long text that end between words."""
    starts, ends = word_spans(data)
    letters, out, i = np.frombuffer(data, np.uint8), [], 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + piece, "right")))
        up, down = _powers(int(ends[j - 1]) - at + 1)
        n = int(ends[j - 1]) - at
        sums = np.r_[np.uint64(0), np.cumsum((letters[at : at + n].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)]
        s, e = starts[i:j] - at, ends[i:j] - at
        out.append((sums[e] - sums[s]) * down[s])
        i = j
    h = np.concatenate(out) if out else np.empty(0, np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of k consecutive word hashes; equal windows have equal hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, m = h[:n].copy(), np.uint64(BASE)
    for i in range(1, k):
        out *= m
        out += h[i : n + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n words that windows of k words beginning at starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge)[:n] > 0
