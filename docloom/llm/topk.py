"""Exact top-k inner-product search: columnar branch-and-bound over blocks of queries and candidates.

Every query is first held against one sample of the candidates; the k-th best score there is a bound that the query takes
with it into every cell (a block of queries and a block of candidates), so cells profit from what another one found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, stored, table

K, SCALE, EVERY = 20, 64, 20
#: Rows of a cell: so many queries are held against so many candidates in one task; a candidate is sent once for each
#: block of queries. Candidates of the sample that gives the first bounds.
QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSION_BLOCK, SAMPLE = 2048, 8192, 8, 4096
GROUP = 128  # queries whose partial sums are in memory at once
DENSE = 0.25  # share of pairs alive above which a dimension block is summed for all pairs


def quantised(df: DataFrame) -> DataFrame:
    """vec_id, v: floor(SCALE * x) of each component as long, and n: the rows that have both. Rows with a null id or vector,
    or a null or non-finite component, are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    ints = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def check_range(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether sums of products are exact in floating point; raises if they may not even fit a long."""
    most = lambda m: np.abs(m.astype(np.float64)).max(axis=0, initial=0)
    big = float((most(q) * most(c)).sum())
    if big >= 2.0**62:
        raise OverflowError("scores may not fit a long")
    return big < 2.0**52


def search(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, least: np.ndarray | None = None, times: np.ndarray | None = None, dropped: dict | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query number, candidate number and score of each query's k best candidates, ties to the smaller id; a candidate that
    stands for several rows (times) comes as often, up to k; one of the rows with the query's id and vector is its own and
    is left out. least: scores that k candidates of each query are known to reach.

    Candidates lie dimension by dimension (those of largest mass first). After each block of dimensions a pair's score
    is within partial sum +- the product of what is left of both norms; pairs whose upper bound is under the k-th largest
    lower bound of their query, or under its least, are dropped and the rest compacted. dropped gets the share of pairs
    that each block of dimensions still had to be summed for."""
    d = q.shape[1]
    times = np.ones(len(c), np.int64) if times is None else times
    kind = np.float64 if check_range(q, c) else np.int64
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, columns = q[:, order].astype(kind), np.ascontiguousarray(c[:, order].T.astype(kind))
    edges = [*range(0, d, DIMENSION_BLOCK), d] if d else [0]
    left = lambda m, axis: [np.sqrt(np.maximum((m.astype(np.float64)[(slice(None),) * axis + (slice(e, None),)] ** 2).sum(axis=axis), 0)) for e in edges]
    q_left, c_left = left(q, 1), left(columns, 0)
    out = []
    for at in range(0, len(q), GROUP):
        part = q[at : at + GROUP]
        floor = np.full(len(part), -np.inf) if least is None else least[at : at + GROUP].astype(np.float64)
        own = q_ids[at : at + GROUP][:, None] == c_ids[None, :]  # of those with the query's id the ones with its vector
        same = np.nonzero(own)
        own[same] = (part[same[0]] == columns[:, same[1]].T).all(axis=1) & (times[same[1]] < 2)
        sums, pairs = np.zeros((len(part), len(c)), kind), None
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if dropped is not None:
                dropped.setdefault(a, []).append(1.0 if pairs is None else len(pairs[0]) / max(1, sums_size))
            if pairs is None:
                sums += part[:, a:b] @ columns[a:b]
                if b == d:
                    break
                room = q_left[i + 1][at : at + GROUP, None] * c_left[i + 1][None, :] * (1 + 1e-9) + 1e-6
                low = np.where(own, -np.inf, sums - room)
                cut = np.maximum(floor, np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else -np.inf)
                alive = (sums + room >= cut[:, None]) & ~own
                if alive.mean() <= DENSE:
                    sums_size = alive.size
                    pairs = np.nonzero(alive)
                    sums = sums[pairs]
            else:
                r, s = pairs
                for j in range(a, b):
                    sums += part[r, j] * columns[j, s]
                if b < d:
                    room = q_left[i + 1][at + r] * c_left[i + 1][s] * (1 + 1e-9) + 1e-6
                    cut = np.maximum(floor, kth_by_row(r, sums - room, len(part), k))
                    alive = sums + room >= cut[r]
                    pairs, sums = (r[alive], s[alive]), sums[alive]
        if pairs is None:
            ranked = np.where(own, -np.inf, sums) if kind is np.float64 else np.where(own, np.iinfo(np.int64).min, sums)
            cut = np.partition(ranked, len(c) - k, axis=1)[:, len(c) - k, None] if len(c) > 4 * k else ranked.min(axis=1, initial=0, keepdims=True)
            pairs = np.nonzero((ranked >= cut) & (ranked >= floor[:, None]) & ~own)
            sums = sums[pairs]
        r, s = pairs
        many = np.minimum(times[s], k + 1)
        if (many > 1).any():  # rows that share id and vector; one of the query's own rows goes
            many = many - ((q_ids[at + r] == c_ids[s]) & (part[r] == columns[:, s].T).all(axis=1))
            r, s, sums = (np.repeat(x, many) for x in (r, s, sums))
        by = np.lexsort((c_ids[s], -sums, r))
        r, s, sums = r[by], s[by], sums[by]
        first = np.searchsorted(r, r)  # where the row's query begins
        best = np.arange(len(r)) - first < k
        out.append((at + r[best], s[best], sums[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def kth_by_row(r: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest of each row's values; -inf for rows with fewer."""
    by = np.lexsort((-values, r))
    first = np.searchsorted(r[by], np.arange(n))
    size = np.bincount(r, minlength=n)
    out = np.full(n, -np.inf)
    out[size >= k] = values[by][first[size >= k] + k - 1]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every query row, all rows of vectors (vec_id, v, n)
    being candidates but the query's own. Rows that share an id are rows of their own: each is a candidate, and each
    query row has a list. No vectors or no queries: no rows. Vectors of unequal length count as ended with zeros. Scores
    that may not fit a long raise an error."""
    bounded(vectors.sparkSession)
    vectors = stored(vectors, "vectors")
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("d")).first()
    n_q, n_c, d = -(-sizes["q"] // query_block) or 1, -(-sizes["n"] // candidate_block) or 1, sizes["d"] or 0
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q")
    drawn = F.pmod(F.xxhash64("vec_id", "v", F.lit("sample")), F.lit(max(1, sizes["n"] // sample))) == 0

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        return left["vec_id"].to_numpy(), matrix(left["v"], d), right["id"].to_numpy(), matrix(right["own"], d)

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        least = np.full(left.num_rows, np.iinfo(np.int64).min)
        if left.num_rows and right.num_rows:
            r, _, score = search(*sides(left, right), k, times=right["times"].to_numpy())
            last = np.flatnonzero(np.bincount(r, minlength=left.num_rows) >= k)
            least[last] = score[np.searchsorted(r, last, "right") - 1]
        return pa.table({"vec_id": left["vec_id"], "v": left["v"], "n": left["n"], "q": left["q"], "least": pa.array(least)})

    asked = vectors.filter(is_query).select("vec_id", "v", "n", block(n_q, "q").alias("q"))
    other = (F.col("vec_id").alias("id"), F.col("v").alias("own"), F.col("n").alias("times"))
    shown = vectors.filter(drawn).select(*other, every)
    known = asked.groupBy("q").cogroup(shown.groupBy("q")).applyInArrow(bound, "vec_id long, v array<long>, n long, q int, least long")
    queries = stored(known.withColumn("number", F.monotonically_increasing_id()), "queries")  # written, so numbers stay

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        r, s, score = (np.empty(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            r, s, score = search(*sides(left, right), k, left["least"].to_numpy(), right["times"].to_numpy())
        return pa.table({"number": left["number"].to_numpy()[r], "query_id": left["vec_id"].to_numpy()[r], "n": left["n"].to_numpy()[r], "vec_id": right["id"].to_numpy()[s], "score": score})

    left = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"))
    right = vectors.select(*other, every, block(n_c, "c").alias("c"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(cell, "number long, query_id long, n long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0) DESC, vec_id) AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
