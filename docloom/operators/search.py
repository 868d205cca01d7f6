"""Vector, lexical and hybrid search, trust scoring and result columns, for one query or many at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata, rules, text, vectors

RRF_K, WEIGHTS = 60, (0.7, 0.3)
VECTOR_TOP, LEXICAL_TOP, HYBRID_TOP, EXPANSION, MIN_SIMILARITY = 5, 30, 10, 3, 0.5
QUERY_BLOCK, CHUNK_BLOCK = 512, 16384


def check_top(k: float) -> int:
    if not (isinstance(k, (int, float)) and math.isfinite(k) and k > 0):
        raise ValueError("top k must be a positive number")
    return int(k)


# --- vector leg ---


def vector_search(chunks: DataFrame, query: list[float], top: int = VECTOR_TOP, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """chunks (chunk_id, embedding, …) with similarity, the `top` nearest of at least min_similarity. Null embeddings take no
    part; a zero vector is like nothing. The query is a literal, so the plan is one scan and a top-k."""
    if not query or not all(math.isfinite(x) for x in query):
        raise ValueError("a query vector needs finite numbers")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.filter(F.col("embedding").isNotNull()).withColumn("similarity", vectors.cosine(F.col("embedding"), q)).drop("embedding")
    return scored.filter(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), "chunk_id").limit(check_top(top))


def vector_search_batch(chunks: DataFrame, queries: DataFrame, top: int = VECTOR_TOP, min_similarity: float = MIN_SIMILARITY, exclude_self: bool = False, within: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, similarity, rank for every row of queries (query_id, embedding) against chunks (chunk_id long,
    embedding), or those that agree with it in the columns `within`. Blocks of queries meet blocks of chunks, each pair of
    blocks one matrix product that keeps its best `top` of each query; the best of all blocks are then ranked: an exact
    product, for which every chunk goes once to each block of queries. Similarities are rounded to 12 digits before they are
    ranked."""
    top, g = check_top(top), [f"__g{i}" for i in range(len(within))]
    good = lambda df, i: df.filter(vectors.valid(F.col("embedding"))).select(F.col(i).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), *[F.col(w).alias(x) for w, x in zip(within, g, strict=True)])
    c, q = good(chunks, "chunk_id"), good(queries, "query_id")
    if g:  # chunks that no query asks for stay where they are
        c = c.join(q.select(*g).distinct(), g, "left_semi")
    n_c, n_q = (max(1, -(-df.count() // size)) for df, size in ((c, CHUNK_BLOCK), (q, QUERY_BLOCK)))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = q.select("id", "v", *g, block(n_q, 1).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"))
    right = c.select("id", "v", *g, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), block(n_c, 2).alias("c"))

    def cell(a, b):
        out = {"query_id": [np.empty(0, np.int64)], "chunk_id": [np.empty(0, np.int64)], "similarity": [np.empty(0)]}
        if a.num_rows and b.num_rows:
            left, right = _by_dimension(a), _by_dimension(b)
            for d, (qi, qm) in left.items():
                if d not in right:
                    continue
                ci, cm = right[d]
                sim = np.round(qm @ cm.T, 12)
                sim[(sim < min_similarity) | ((ci == qi[:, None]) & exclude_self)] = -np.inf
                if len(ci) > top:  # more than `top` only where the last place is tied
                    i, j = np.nonzero((sim >= np.partition(sim, len(ci) - top, axis=1)[:, len(ci) - top, None]) & (sim > -np.inf))
                else:
                    i, j = np.nonzero(sim > -np.inf)
                score = sim[i, j]
                by = np.lexsort((ci[j], -score, i))
                i, j, score = i[by], j[by], score[by]
                best = np.arange(len(i)) - np.searchsorted(i, i) < top
                out["query_id"].append(qi[i[best]])
                out["chunk_id"].append(ci[j[best]])
                out["similarity"].append(score[best])
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    found = left.groupBy(*g, "q", "c").cogroup(right.groupBy(*g, "q", "c")).applyInArrow(cell, "query_id long, chunk_id long, similarity double")
    return ranked(found, "similarity", top)


def _by_dimension(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> ids and vectors made of length one; zero vectors stay zero."""
    v = t["v"].combine_chunks()
    v = v if isinstance(v, pa.ListArray) else pa.concat_arrays(v.chunks)
    ids, flat, starts = t["id"].to_numpy(), v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
    sizes, out = np.diff(starts), {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        m = flat[starts[at][:, None] + np.arange(d)]
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[d] = ids[at], np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    return out


def ranked(df: DataFrame, score: str, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= top)


# --- lexical leg ---


def starts(prefix: str, field: str | None = None):
    """A test, for higher-order functions, of tokens or a field of theirs."""
    return lambda x: (x[field] if field else x).startswith(prefix)


def holding(chunks: DataFrame, wanted: list[str]) -> DataFrame:
    """The chunks whose lower-case text holds every term somewhere: a cheap test that all matches pass before they are cut
    into tokens."""
    low, held = F.lower("text"), F.lit(True)
    for w in wanted:
        held = held & F.contains(low, F.lit(w))
    return chunks.filter(held)


def lexical_search(chunks: DataFrame, query: str, top: int = LEXICAL_TOP) -> DataFrame:
    """chunk_id, tf, score, rank of chunks (chunk_id, text) that have, for every term of the query, a token that starts with
    it. tf: tokens that start with some term; score: tf over the largest of those returned (not Okapi BM25)."""
    wanted = [t.lower() for t in text.query_terms(query)]
    tokens = holding(chunks, wanted).select("chunk_id", text.terms(F.col("text")).alias("t"))
    match = F.lit(True)
    for w in wanted:
        match = match & F.exists("t", starts(w))
    some = lambda x: F.array_max(F.array(*[x.startswith(w) for w in wanted]))
    hit = tokens.filter(match).select("chunk_id", F.size(F.filter("t", some)).cast("long").alias("tf"))
    return max_normalised(hit.orderBy(F.desc("tf"), "chunk_id").limit(check_top(top)), "tf")


def max_normalised(top: DataFrame, raw: str) -> DataFrame:
    """score (raw over the largest raw of the rows; 0 stays 0) and rank of the rows of one query."""
    w = Window.orderBy(F.desc(raw), "chunk_id")
    largest = F.max(raw).over(Window.partitionBy())
    return top.withColumn("score", F.col(raw) / F.when(largest == 0, 1).otherwise(largest)).withColumn("rank", F.row_number().over(w))


def term_index(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, positions (from 1): an inverted index, to be written sorted by term."""
    flat = chunks.select("chunk_id", F.posexplode(text.terms(F.col("text"))).alias("pos", "term"))
    return flat.groupBy("term", "chunk_id").agg(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"))


def cover_density(positions: list[list[int]], weight: float = 0.1) -> float:
    """Sum over the minimal stretches that hold every term of weight over one plus the words of it that match none.
    positions: of each term."""
    if not positions or not all(positions):
        return 0.0
    marks = sorted({(p, i) for i, ps in enumerate(positions) for p in ps})
    total, start = 0.0, 0
    while start < len(marks):
        need, end = set(range(len(positions))), start
        while end < len(marks) and need:
            need.discard(marks[end][1])
            end += 1
        if need:
            break
        need, begin = set(range(len(positions))), end
        while need:
            begin -= 1
            need.discard(marks[begin][1])
        inside = len({p for p, _ in marks[begin:end]})
        total += weight / (1 + marks[end - 1][0] - marks[begin][0] + 1 - inside)
        start = begin + 1
    return total


def cover_density_search(chunks: DataFrame, query: str, top: int = LEXICAL_TOP) -> DataFrame:
    """As lexical_search, ranked by cover density; only the matching chunks' positions reach Python."""
    wanted = [t.lower() for t in text.query_terms(query)]
    tokens = holding(chunks, wanted).select("chunk_id", text.terms(F.col("text")).alias("t"))
    numbered = F.transform("t", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    where = F.array(*[F.transform(F.filter(numbered, starts(w, "x")), lambda s: s["i"]) for w in wanted])
    hits = tokens.select("chunk_id", where.alias("w")).filter(F.forall("w", lambda p: F.size(p) > 0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "density": [cover_density([list(p) for p in w]) for w in b["w"]]})

    schema = f"chunk_id {dict(hits.dtypes)['chunk_id']}, density double"
    return max_normalised(hits.mapInPandas(score, schema).orderBy(F.desc("density"), "chunk_id").limit(check_top(top)), "density")


# --- fusion ---


def resolve_weights(vector: float | None = None, lexical: float | None = None, defaults: tuple[float, float] = WEIGHTS) -> tuple[float, float]:
    """Given or default weights made to sum to one; the defaults if their sum is no positive number."""
    v, x = (defaults[0] if vector is None else vector), (defaults[1] if lexical is None else lexical)
    total = v + x
    return (v / total, x / total) if math.isfinite(total) and total > 0 else defaults


def fuse(vector: DataFrame, lexical: DataFrame, top: int, weights: tuple[float, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists (query_id, chunk_id, rank and similarity or score): fused_score,
    vector_score, lexical_score, source and fused_rank of the best `top` of each query."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("rv"), F.col("similarity").alias("sv"))
    x = lexical.select("query_id", "chunk_id", F.col("rank").alias("rl"), F.col("score").alias("sl"))
    both = v.join(x, ["query_id", "chunk_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    source = F.when(F.col("rl").isNull(), "vector").when(F.col("rv").isNull(), "bm25").otherwise("both")
    scored = both.select(
        "query_id", "chunk_id", "rv", "rl", (part(weights[0], "rv") + part(weights[1], "rl")).alias("fused_score"), F.coalesce("sv", F.lit(0.0)).alias("vector_score"),
        F.coalesce("sl", F.lit(0.0)).alias("lexical_score"), source.alias("source"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.asc_nulls_last("rv"), F.asc_nulls_last("rl"), "chunk_id")
    return scored.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= top).drop("rv", "rl")


def hybrid(chunks: DataFrame, query: str, vector: list[float], top: int = HYBRID_TOP, min_similarity: float = MIN_SIMILARITY, weights: tuple[float, float] = WEIGHTS, lexical: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Both legs over three times `top` candidates, fused. Raises if the query has no usable term. lexical: the other leg, of
    so many rows (query_id 0, chunk_id, rank, score); by default plain words without stems."""
    wide = EXPANSION * check_top(top)
    text.query_terms(query)
    v = vector_search(chunks.select("chunk_id", "embedding"), vector, wide, min_similarity)
    v = v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id"))).withColumn("query_id", F.lit(0).cast("long"))
    leg = lexical_search(chunks, query, wide).withColumn("query_id", F.lit(0).cast("long")) if lexical is None else lexical(wide)
    return fuse(v, leg, top, weights)


# --- trust, results, counters ---


def trusted(results: DataFrame, quality: Column, verified: Column, as_of: Column, scores: tuple[str, ...] = ("similarity", "fused_score")) -> DataFrame:
    """trust_weight, recency_weight, and scores times both."""
    weighed = results.withColumn("trust_weight", rules.quality_weight(quality)).withColumn("recency_weight", rules.recency_weight(verified, as_of))
    return weighed.withColumns({s: F.col(s) * F.col("trust_weight") * F.col("recency_weight") for s in scores if s in results.columns})


def cited(results: DataFrame) -> DataFrame:
    """citation_page (a number or text of the metadata) and citation_section (heading, else section, if text); NaN similarity
    as 0. metadata is a map of text, or JSON text, whose values have types."""
    if dict(results.dtypes)["metadata"] == "string":
        typed = lambda k, *kinds: F.when(metadata.json_type(F.col("metadata"), k).isin(*kinds), metadata.json_text(F.col("metadata"), k))
        found = F.coalesce(metadata.json_type(F.col("metadata"), "heading"), F.lit("null"))
        page, section = typed("page", "string", "number"), F.when(found != "null", typed("heading", "string")).otherwise(typed("section", "string"))
    else:
        key = lambda k: F.try_element_at("metadata", F.lit(k))
        page, section = key("page"), F.coalesce(key("heading"), key("section"))
    return results.withColumns({"citation_page": page, "citation_section": section, "similarity": F.nanvl("similarity", F.lit(0.0))})


def counters(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(
        F.count_if(F.col("source").isin("vector", "both")).alias("vector_count"), F.count_if(F.col("source").isin("bm25", "both")).alias("bm25_count"), F.count("*").alias("fused_count")
    )


def as_json(results: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON string for each row: what the search interface answers."""
    return results.select(F.to_json(F.struct(*columns)).alias("json"))
