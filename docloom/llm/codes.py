"""Vector code compression: product codebooks by exact Lloyd rounds over partition-local heaps.

Each part of a vector has an upper bound of its distance to its entry and a lower bound of that to any other; the heap
of its entry is keyed by lower minus upper, plus the drift that the entry had gathered when the bounds were taken. After a round
only parts whose key the entry's cumulative drift has reached are popped and held against all entries again.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, finite, forget, kept, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 16384  # vectors that share heaps: so many are in a worker's memory
LARGEST = 1 << 28  # a component's largest absolute value
GROUP = 4096  # parts that are held against all entries at once


def integers(df: DataFrame, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """id, label, v (floor(scale * x) of each component x) of the rows whose vector is neither null nor holds null or
    non-finite components; and the length of v, a multiple of parts: shorter vectors end in zeros."""
    good = df.filter(finite("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col("embedding").cast("array<double>").alias("c"))
    longest = good.agg(F.max(F.size("c"))).first()[0] or 1
    d = -(-longest // parts) * parts
    v = F.transform("c", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return good.select("id", "label", F.concat(v, F.array_repeat(F.lit(0).cast("long"), d - F.size("c"))).alias("v")), d


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of book."""
    most = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 2.0**52:  # all sums are integers that float64 holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if 4 * most * most * x.shape[1] >= 2.0**62:
        raise OverflowError("distances may not fit a long")
    return np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)


class Heaps:
    """Of one part position of one block: the entry of each part, and a heap of (key, part) for each entry. Heaps come and go
    as arrays; one whose top holds is left an array."""

    def __init__(self, entry: np.ndarray, keys: np.ndarray, order: np.ndarray, starts: np.ndarray):
        self.entry, self.keys, self.order, self.starts, self.open = entry, keys, order, starts, {}

    @classmethod
    def empty(cls, n: int, k: int) -> Heaps:
        return cls(np.full(n, -1, np.int16), np.empty(0), np.empty(0, np.int32), np.zeros(k + 1, np.int32))

    def of(self, c: int) -> list:
        if c not in self.open:
            a, b = self.starts[c], self.starts[c + 1]
            self.open[c] = list(zip(self.keys[a:b].tolist(), self.order[a:b].tolist(), strict=True))
        return self.open[c]

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pops the parts whose key their entry's cumulative drift has reached."""
        out = []
        for c in range(len(drift)):
            a, b = self.starts[c], self.starts[c + 1]
            if a < b and self.keys[a] <= drift[c]:
                heap = self.of(c)
                while heap and heap[0][0] <= drift[c]:
                    out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, part: np.ndarray, entry: np.ndarray, key: np.ndarray) -> None:
        self.entry[part] = entry
        for p, c, x in zip(part.tolist(), entry.tolist(), key.tolist(), strict=True):
            heapq.heappush(self.of(c), (x, p))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, order = [], []
        for c in range(len(self.starts) - 1):
            a, b = self.starts[c], self.starts[c + 1]
            heap = self.open.get(c)
            keys.append(self.keys[a:b] if heap is None else np.array([x for x, _ in heap], np.float64))
            order.append(self.order[a:b] if heap is None else np.array([p for _, p in heap], np.int32))
        starts = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        return self.entry, np.concatenate(keys), np.concatenate(order), starts


def rescan(x: np.ndarray, part: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower) and its key: by how much the second is farther, less what rounding
    may take, plus the drift of the entry so far."""
    entry, key = np.empty(len(part), np.int64), np.empty(len(part))
    for at in range(0, len(part), GROUP):
        d = distances(x[part[at : at + GROUP]], book)
        rows, best = np.arange(len(d)), d.argmin(axis=1)
        upper = np.sqrt(d[rows, best])
        d[rows, best] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(axis=1)) if d.shape[1] > 1 else np.full(len(d), np.inf)
        slack = lower - upper
        entry[at : at + GROUP], key[at : at + GROUP] = best, slack - np.where(slack < np.inf, (lower + upper) * 1e-12 + 1e-9, 0) + drift[best]
    return entry, key


def sums_by(entry: np.ndarray, x: np.ndarray, sign: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, s = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    np.add.at(n, entry, sign)
    np.add.at(s, entry, sign * x)
    return n, s


_DELTA = pa.list_(pa.struct([("pos", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def state_type(label: T.DataType) -> T.StructType:
    """A block: its vectors' ids, labels and components (packed), the heaps of each part position, and by how much its
    round changed the sums of entries."""
    binary = [T.StructField(n, T.BinaryType()) for n in ("v", "entry", "keys", "heap", "starts")]
    delta = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))]))
    return T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("width", T.IntegerType()), *binary, T.StructField("delta", delta), T.StructField("scanned", T.LongType())])


def blocks(vectors: DataFrame, d: int, block: int) -> DataFrame:
    """The vectors in blocks, each one row; nothing is assigned yet."""
    kind = state_type(vectors.schema["label"].dataType)

    def out(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).combine_chunks()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["v"].chunks]).reshape(-1, d)
        most = np.abs(v).max(initial=0)
        if most >= LARGEST:
            raise OverflowError("components beyond 2^28 are not supported")
        v = v.astype(np.int16 if most < 1 << 15 else np.int32)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a)
        blank = pa.array([b""], pa.binary())
        return pa.RecordBatch.from_arrays([one(t["id"]), one(t["label"]), pa.array([v.itemsize], pa.int32()), pa.array([v.tobytes()], pa.binary()), *[blank] * 4, pa.array([[]], _DELTA), pa.array([0], pa.int64())], kind.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for b in batches:
            have, n = [*have, pa.table(b)], n + b.num_rows
            while n >= block:
                every = pa.concat_tables(have)
                yield out([every.slice(0, block)])
                have, n = [every.slice(block)], n - block
        if n:
            yield out(have)

    return vectors.mapInArrow(run, kind)


def assigned(row: dict, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, list[Heaps], list, int]:
    """One block's vectors, its heaps after a round, the changes of sums and how many parts were held against all entries."""
    parts, k, w = book.shape
    v = np.frombuffer(row["v"], f"i{row['width']}").reshape(-1, parts * w)
    n, delta, scanned, out = len(v), [], 0, []
    first = not row["entry"]
    if not first:
        entries = np.frombuffer(row["entry"], np.int16).reshape(parts, n)
        keys, order = np.frombuffer(row["keys"], np.float64).reshape(parts, n), np.frombuffer(row["heap"], np.int32).reshape(parts, n)
        starts = np.frombuffer(row["starts"], np.int32).reshape(parts, k + 1)
    for p in range(parts):
        x = v[:, p * w : (p + 1) * w].astype(np.int64)
        heaps = Heaps.empty(n, k) if first else Heaps(entries[p].copy(), keys[p], order[p], starts[p])
        again = np.arange(n) if first else heaps.violated(drift[p])
        old = heaps.entry[again].astype(np.int64)
        entry, key = rescan(x, again, book[p], drift[p])
        heaps.push(again, entry, key)
        scanned += len(again)
        moved = entry != old
        count, total = sums_by(entry[moved], x[again[moved]], 1, k)
        if not first:
            less, gone = sums_by(old[moved], x[again[moved]], -1, k)
            count, total = count + less, total + gone
        changed = np.flatnonzero((count != 0) | (total != 0).any(axis=1))
        delta += [{"pos": p, "entry": int(c), "n": int(count[c]), "s": total[c].tolist()} for c in changed]
        out.append(heaps)
    return v, out, delta, scanned


def advanced(state: DataFrame, book: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after a round of assignments."""
    kind = state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                row = {c: one.column(c)[0].as_py() for c in ("v", "width", "entry", "keys", "heap", "starts")}
                _, heaps, delta, scanned = assigned(row, book, drift)
                packed = [pa.array([b"".join(np.ascontiguousarray(x).tobytes() for x in xs)], pa.binary()) for xs in zip(*(h.arrays() for h in heaps), strict=True)]
                yield pa.RecordBatch.from_arrays([one.column("ids"), one.column("labels"), one.column("width"), one.column("v"), *packed, pa.array([delta], _DELTA), pa.array([scanned], pa.int64())], kind.names)

    return state.mapInArrow(run, kind)


def coded(state: DataFrame, book: np.ndarray, drift: np.ndarray, label: T.StructField) -> DataFrame:
    """id, label, code and error of every vector, after a last round of assignments."""
    parts, _, w = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                row = {c: one.column(c)[0].as_py() for c in ("v", "width", "entry", "keys", "heap", "starts")}
                v, heaps, _, _ = assigned(row, book, drift)
                entries = np.stack([h.entry for h in heaps], axis=1)
                error = sum(((v[:, p * w : (p + 1) * w].astype(np.int64) - book[p][entries[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                code = entries.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array([code[i : i + 2 * parts] for i in range(0, len(code), 2 * parts)], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return state.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label.dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def first_book(vectors: DataFrame, parts: int, entries: int, d: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (null last, ties by vector), as many as there are up to entries."""
    rows = vectors.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, parts, d // parts).transpose(1, 0, 2)


def compress(df: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK, scanned: list | None = None) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each row of df (vec_id, embedding, label) whose vector
    is whole.

    code has two hex digits for each part (so entries is 256 at most), error is the sum of the parts' squared distances,
    label_error the sum of errors over rows of the same label. Rows whose vector is null or holds null or non-finite
    components are left out; repeated rows, null ids and null labels (together) are rows like any other. Shorter vectors
    and lengths that parts does not divide count as ended with zeros. Fewer rows than entries: as many entries. No rows:
    no rows. Components beyond 2^28 and sums beyond a long raise an error. Further columns are ignored. The driver gets
    the entries' sums only. scanned gets, for each round but the last, the parts held against all entries and all parts.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    bounded(df.sparkSession)
    spark = df.sparkSession
    vectors, d = integers(df, label, parts, scale)
    book = first_book(vectors, parts, entries, d)
    field = vectors.schema["label"]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", field.dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    if not book.shape[1]:
        return spark.createDataFrame([], schema)
    (_, k, w), drift = book.shape, np.zeros(book.shape[:2])
    count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
    state, path = kept(blocks(vectors, d, block), "codes")
    for _ in range(rounds):
        state, new = kept(advanced(state, book, drift), "codes")
        forget(spark, path)
        path = new
        each = state.select(F.explode("delta").alias("t")).groupBy("t.pos", "t.entry").agg(F.sum("t.n").alias("n"), F.array(*[F.sum(F.col("t.s")[i]) for i in range(w)]).alias("s"))
        for r in each.collect():  # one row for each entry at most
            count[r["pos"], r["entry"]] += r["n"]
            total[r["pos"], r["entry"]] += np.array(r["s"], np.int64)
        if scanned is not None:
            scanned.append(tuple(state.agg(F.sum("scanned"), F.sum(F.size("ids")) * parts).first()))
        moved = np.where(count[:, :, None] > 0, np.floor_divide(total, np.maximum(count, 1)[:, :, None]), book)
        step = np.sqrt(((moved - book).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        ranked = np.sort(step, axis=1)
        other = np.where(step == ranked[:, -1:], ranked[:, -2:-1] if k > 1 else 0, ranked[:, -1:])
        other = np.where((step == ranked[:, -1:]).sum(axis=1, keepdims=True) > 1, ranked[:, -1:], other)
        drift, book = drift + step + other, moved
    done, last = kept(coded(state, book, drift, field), "coded")
    forget(spark, path)
    sums, _ = kept(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    """Round after round as one step each."""
    w = "(d // 4)"
    out = [
        f"WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) AS d FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, p, v[p * {w} + 1:(p + 1) * {w}] AS x FROM v, range({PARTS}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= {ENTRIES})",
    ]
    near = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, x.p, x, arg_min({{'e': e, 's': s}}, {{'s': s, 'e': e}}) AS m FROM (SELECT r, x.p, x, e, CAST({near} AS BIGINT) AS s FROM x JOIN b{i} b ON b.p = x.p) x GROUP BY r, x.p, x)")
        if i < ROUNDS:
            out.append(f"m{i} AS MATERIALIZED (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c FROM (SELECT p, m.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, unnest(range(1, len(x) + 1)) u(j) GROUP BY ALL) GROUP BY ALL)")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))")
    last = ROUNDS
    out.append(f"o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.s) AS BIGINT) AS error FROM a{last} GROUP BY r)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})")
    return ", ".join(out) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"


SQL = _sql()
