"""Competing approaches among results: clusters, consensus, conflicts and a recommendation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import ascii_tokens, jaccard, shortened, squeezed

MOST_CLUSTERS, ROUNDS, STILL = 3, 10, 1e-4
SNIPPET, SUMMARY, STATEMENT, EMBEDDED = 420, 360, 400, 600
LOW, HIGH, PAIRS = 0.2, 0.7, 6
PENALTY = {"high": 0.3, "medium": 0.15, "low": 0.05}

# --- clusters ---


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine; 0 for empty, unequal or zero vectors."""
    if not len(a) or len(a) != len(b):
        return 0.0
    size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / size if size else 0.0


def cluster(vectors: list[np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    """Each vector's cluster and the centroids: a third as many clusters as vectors, one to three; the first vectors start
    them; the most similar centroid takes a vector (the first of equals); means until they move less than STILL or ten
    rounds are over. On standing still the centroids are those of the round before; an emptied cluster has none."""
    n = len(vectors)
    k = max(1, min(MOST_CLUSTERS, n // 3 or 1))
    centroids, own = [np.array(v, float) for v in vectors[:k]], [0] * n
    for _ in range(ROUNDS):
        own = [int(np.argmax([similarity(v, c) for c in centroids])) for v in vectors]
        members = [[v for v, o in zip(vectors, own, strict=True) if o == j] for j in range(k)]
        moved = [np.mean(m, axis=0) if m else np.empty(0) for m in members]
        if all(len(a) == len(b) and (not len(a) or np.abs(a - b).max() < STILL) for a, b in zip(moved, centroids, strict=True)):
            break
        centroids = moved
    return own, centroids


def clustered(results: DataFrame) -> DataFrame:
    """results (query_id, pos, embedding) with approach (from 0, empty clusters closed up) and centroid_similarity. A query
    has as many results as a search returns, so a group fits a worker. After an empty cluster the centroid looked up is
    that of the closed-up number; .7 if that is none."""
    schema = f"query_id {dict(results.dtypes)['query_id']}, pos {dict(results.dtypes)['pos']}, approach int, centroid_similarity double"

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        vectors = [np.array(v, float) for v in group["embedding"]]
        own, centroids = cluster(vectors)
        number = {c: i for i, c in enumerate(sorted(set(own)))}
        rows = []
        for pos, v, o in zip(group["pos"], vectors, own, strict=True):
            c = centroids[number[o]]
            rows.append((key[0], pos, number[o], min(1.0, max(0.0, similarity(v, c))) if len(c) else 0.7))
        return pd.DataFrame(rows, columns=["query_id", "pos", "approach", "centroid_similarity"])

    placed = results.select("query_id", "pos", "embedding").groupBy("query_id").applyInPandas(run, schema)
    return results.join(placed, ["query_id", "pos"])


# --- approaches ---


def lower_quality(quality: Column) -> Column:
    return rules.quality_weight(F.lower(quality))


def first_text(values: list[Column]) -> Column:
    """The first that is longer than three characters."""
    return F.coalesce(*[F.when(F.length(F.trim(v)) > 3, F.trim(v)) for v in values])


def consensus(sources: Column, quality: Column, centroid: Column, fresh: Column) -> Column:
    """1 for a single source; else .4 quality, .4 similarity and .2 freshness, within 0 and 1."""
    return F.when(sources == 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * quality + 0.4 * centroid + 0.2 * fresh)))


def approaches(members: DataFrame, as_of: Column) -> DataFrame:
    """One row for each query_id and approach of members (pos, text, title, url, quality, verified, published, topic, method,
    query, centroid_similarity): topic, method, summary, consensus_score and sources, in the order of pos."""
    day = F.coalesce("verified", "published")
    kept = members.withColumns({"__q": lower_quality(F.col("quality")), "__f": rules.freshness(day, as_of), "__t": first_text([F.col("topic")]), "__m": first_text([F.col("method")])})
    item = F.struct(
        "pos", F.col("title"), F.col("url"), shortened(squeezed(F.col("text")), SNIPPET).alias("statement"), F.col("quality"), day.cast("string").alias("date"), F.col("__t"), F.col("__m"), squeezed(F.col("text")).alias("__text"), F.col("query"),
    )
    whole = kept.groupBy("query_id", "approach").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"), F.avg("__q").alias("q"), F.avg("centroid_similarity").alias("s"), F.avg("__f").alias("f")
    )
    first = lambda name: F.try_element_at(F.filter(F.transform("items", lambda x: x[name]), lambda x: x.isNotNull()), F.lit(1))
    texts = F.slice(F.filter(F.transform("items", lambda x: x["__text"]), lambda t: F.length(t) > 0), 1, 2)
    sources = F.transform("items", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["statement"].alias("statement"), x["quality"].alias("quality"), x["date"].alias("date")))
    topic = F.coalesce(first("__t"), first("title"), first("query"))
    return whole.select(
        "query_id", "approach", topic.alias("topic"), F.coalesce(first("__m"), first("title"), topic).alias("method"), shortened(F.array_join(texts, " "), SUMMARY).alias("summary"),
        consensus(F.col("n"), F.col("q"), F.col("s"), F.col("f")).alias("consensus_score"), sources.alias("sources"),
    )


# --- conflicts ---


def conflict_pairs(found: DataFrame, low: float = LOW, high: float = HIGH, most: int = PAIRS) -> DataFrame:
    """Pairs of a query's approaches (a before b) whose summaries' token sets overlap by low to high; those of the largest
    overlap plus difference of consensus (.5 where unknown), up to six. A query has up to three approaches."""
    side = lambda p: found.select("query_id", F.col("approach").alias(p), ascii_tokens(F.col("summary")).alias(f"{p}_tokens"), F.coalesce("consensus_score", F.lit(0.5)).alias(f"{p}_score"))
    both = side("a").join(side("b"), "query_id").filter("a < b").withColumn("overlap", jaccard(F.col("a_tokens"), F.col("b_tokens")))
    near = both.filter(F.col("overlap").between(low, high)).withColumn("weight", F.col("overlap") + F.abs(F.col("a_score") - F.col("b_score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "a", "b"))
    return near.withColumn("pair_rank", rank).filter(F.col("pair_rank") <= min(most, PAIRS)).select("query_id", "a", "b", "overlap", "weight", "pair_rank")


def parse_verdict(answer: str | None) -> dict | None:
    """A judge's answer: the JSON between the first { and the last }; None unless it says contradiction."""
    try:
        found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
    except (ValueError, AttributeError, TypeError):
        return None
    if not isinstance(found, dict) or found.get("contradiction") is not True:
        return None
    severity, confidence = found.get("severity"), found.get("confidence")
    known = isinstance(confidence, (int, float)) and not isinstance(confidence, bool) and confidence == confidence
    return {"severity": severity if severity in PENALTY else "medium", "difference": str(found.get("difference") or ""), "recommendation": str(found.get("recommendation") or ""), "confidence": min(1.0, max(0.0, float(confidence))) if known else 0.6}


def judge(pairs: DataFrame, found: DataFrame, make_judge: Callable[[], Callable[[dict, dict], str]]) -> DataFrame:
    """Conflicts that a judge finds among pairs: topic, both first sources, severity, difference, recommendation, confidence.
    A judge that raises finds none."""
    first = F.struct(F.col("topic"), F.col("summary"), F.col("sources")[0]["title"].alias("title"), F.col("sources")[0]["url"].alias("url"), F.when(F.length("summary") <= STATEMENT, F.col("summary")).otherwise(F.col("sources")[0]["statement"]).alias("statement"))
    side = lambda p: found.select("query_id", F.col("approach").alias(p), first.alias(f"{p}_source"))
    given = pairs.join(side("a"), ["query_id", "a"]).join(side("b"), ["query_id", "b"]).select("query_id", "pair_rank", "a_source", "b_source")
    schema = f"query_id {dict(pairs.dtypes)['query_id']}, pair_rank int, topic string, a_title string, a_url string, b_title string, b_url string, severity string, difference string, recommendation string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_judge()
        for b in batches:
            rows = []
            for q, r, x, y in b.itertuples(index=False):
                x, y = (s if isinstance(s, dict) else s.asDict() for s in (x, y))
                try:
                    v = parse_verdict(ask(x, y))
                except Exception:
                    v = None
                if v:
                    rows.append((q, r, x["topic"], x["title"], x["url"], y["title"], y["url"], v["severity"], v["difference"], v["recommendation"], v["confidence"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return given.mapInPandas(run, schema)


def recommended(found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Each query's approach with the highest consensus less the penalty of the first conflict that names one of its
    sources by title or URL; the first of equals."""
    named = conflicts.select("query_id", "pair_rank", "severity", F.explode(F.array("a_title", "a_url", "b_title", "b_url")).alias("name")).filter("name is not null")
    sources = found.select("query_id", "approach", F.explode("sources").alias("s")).select("query_id", "approach", F.explode(F.array("s.title", "s.url")).alias("name")).filter("name is not null").distinct()
    cost = F.coalesce(*[F.when(F.col("severity") == s, p) for s, p in PENALTY.items()], F.lit(0.0))
    hit = sources.join(named, ["query_id", "name"]).groupBy("query_id", "approach").agg(F.min_by(cost, "pair_rank").alias("penalty"))
    scored = found.join(hit, ["query_id", "approach"], "left").withColumn("score", F.col("consensus_score") - F.coalesce("penalty", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "approach"))
    return scored.withColumn("r", rank).filter("r = 1").drop("r", "penalty")
