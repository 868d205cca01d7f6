"""Reranking with pluggable scorers, window sizes, the fallback chain, and the evaluation's feature reranker."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes, in a worker, a function from pairs of query and text to scores.
Scorer = Callable[[], Callable[[list[tuple[str, str]]], list]]
REGISTRY: dict[str, Scorer] = {}
MOST, DEFAULT_OUT, BATCH = 50, 15, 8


def register(name: str, scorer: Scorer) -> None:
    REGISTRY[name] = scorer


def choose_provider(explicit: str | None = None, override: str | None = None, configured: str | None = None, key: bool = True) -> str:
    """Explicit, else override, else configured, else none; a remote one without a key falls to the local one."""
    name = next((p.strip().lower() for p in (explicit, override, configured) if p and p.strip().lower() in ("cohere", "bge", "none")), "none")
    return "bge" if name == "cohere" and not key else name


def window_sizes(top: int | None = None, candidates: int | None = None, rerank_top: int | None = None) -> tuple[int, int, int]:
    """Candidates reranked, hybrid results fetched, results returned."""
    cap = min(max(candidates if candidates is not None else MOST, 1), MOST)
    fetched = max(cap, top if top is not None else 10)
    out = min(max(rerank_top if rerank_top is not None else top if top is not None else DEFAULT_OUT, 1), fetched)
    return cap, fetched, out


def number(score) -> float:
    """A score given as a number, a list with one, or a mapping with score or value; 0 for all else."""
    if isinstance(score, dict):
        score = score.get("score", score.get("value", 0))
    if isinstance(score, (list, tuple)):
        return number(score[0]) if score else 0.0
    try:
        value = float(score)
    except (TypeError, ValueError):
        return 0.0
    return value if value == value and abs(value) != float("inf") else 0.0


def by_position(found: list, n: int) -> list[float | None]:
    """Scores of n candidates as a scorer gives them: one for each, in order, or entries with an index; candidates that no
    entry names have none."""
    if not any(isinstance(f, dict) and "index" in f for f in found):
        return [number(f) for f in found]
    out: list[float | None] = [None] * n
    for f in found:
        if isinstance(f, dict) and type(f.get("index")) is int and 0 <= f["index"] < n:
            out[f["index"]] = number(f.get("score", f.get("relevance_score", 0)))
    return out


def scored_by(chain: list[tuple[str, Callable]], ready: dict[str, Callable], pairs: list[tuple[str, str]]) -> tuple[list[float | None] | None, str]:
    """Scores of all pairs of one query by the first scorer that answers every call, and its name; None and none if none
    does. ready keeps what was made."""
    for name, make in chain:
        try:
            run = ready.get(name) or ready.setdefault(name, make())
            return [s for at in range(0, len(pairs), BATCH) for s in by_position(run(pairs[at : at + BATCH]), len(pairs[at : at + BATCH]))], name
        except Exception:
            ready.pop(name, None)
    return None, "none"


def rerank(candidates: DataFrame, provider: str, top: int = DEFAULT_OUT, cap: int = MOST) -> DataFrame:
    """candidates (query_id, pos, query, text, similarity) with rerank_score, rerank_provider, original_similarity and
    rerank_rank; similarity becomes the rerank score. pos is the place before reranking and breaks ties. A scorer that fails
    at any of a query's candidates hands the whole query over to the local one, and that to passing the similarities through
    in their order, so that a query's scores are of one provider; none passes through at once. A scorer that names
    candidates by index drops those it doesn't name. A query's candidates, `cap` at most, are in one task."""
    given = candidates.filter(F.col("pos") <= cap)
    chain = [(p, REGISTRY[p]) for p in dict.fromkeys((provider, "bge")) if provider != "none" and p in REGISTRY]
    if chain:
        schema = T.StructType([*given.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("rerank_provider", T.StringType()), T.StructField("rerank_rank", T.IntegerType())])
        ready: dict[str, Callable] = {}  # travels empty; a task's queries share what it makes

        def score(group: pa.Table) -> pa.Table:
            scores, used = scored_by(chain, ready, list(zip(group["query"].to_pylist(), group["text"].to_pylist(), strict=True)))
            places = group["pos"].to_pylist()
            if scores is None:
                scores, order = group["similarity"].cast(pa.float64()).to_pylist(), sorted(range(len(places)), key=places.__getitem__)
            else:
                order = sorted((i for i, s in enumerate(scores) if s is not None), key=lambda i: (-scores[i], places[i]))
            order = order[:top]
            more = pa.array([scores[i] for i in order], pa.float64()), pa.array([used] * len(order), pa.string()), pa.array(range(1, len(order) + 1), pa.int32())
            out = group.take(pa.array(order, pa.int64()))
            for name, column in zip(schema.names[-3:], more, strict=True):
                out = out.append_column(name, column)
            return out

        placed = given.groupBy("query_id").applyInArrow(score, schema)
    else:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
        placed = given.withColumns({"rerank_score": F.col("similarity"), "rerank_provider": F.lit("none"), "rerank_rank": rank}).filter(F.col("rerank_rank") <= top)
    return placed.withColumn("original_similarity", F.col("similarity")).withColumn("similarity", F.col("rerank_score"))


def whole_word_count(text: Column, token: str) -> Column:
    """Matches between ASCII word boundaries."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9_])\Q{token}\E(?![a-z0-9_])"))


def feature_scores(candidates: DataFrame, tokens: list[str], boosts: DataFrame) -> DataFrame:
    """candidates (doc_id, content, topics, score) with score plus: .8 for each whole-word match of tokens of three letters
    or more; 1.2, and .4 with .05 for each document of the topic, for each topic among the tokens; the weights that boosts
    (doc_id, token, weight) gives the tokens; and four times the share of words matched by tokens of four letters or more."""
    words = F.size(F.split(F.lower("content"), r"\s+"))
    hits = lambda least: sum((whole_word_count(F.col("content"), t) for t in tokens if len(t) >= least), F.lit(0))
    given = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    peers = candidates.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("peers"))
    asked = candidates.select("doc_id", F.explode(F.array_intersect("topics", given)).alias("topic")).join(peers, "topic").groupBy("doc_id").agg(F.sum(1.2 + 0.4 + 0.05 * F.col("peers")).alias("by_topic"))
    weights = boosts.filter(F.array_contains(given, F.col("token"))).groupBy("doc_id").agg(F.sum("weight").alias("by_token"))
    full = candidates.join(asked, "doc_id", "left").join(weights, "doc_id", "left")
    total = F.col("score") + 0.8 * hits(3) + F.coalesce("by_topic", F.lit(0.0)) + F.coalesce("by_token", F.lit(0.0)) + 4.0 * hits(4) / words
    return full.withColumn("score", total).drop("by_topic", "by_token")
