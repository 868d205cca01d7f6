"""Registered queries of reranking, citations, approaches, conflicts and gains, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import approaches as groups
from .operators import evaluate, rerank, search
from .queries import _BATCH, _CHUNKS, _FUSED, _ROLES, _SET, _TOKENS, AS_OF, TERMS, batch, chunks, documents, first_vector, judged, query, role_approaches, vector_chunks
from .session import load

# --- search ---


@query(_FUSED.replace("CAST(0.7 AS DOUBLE)", "CAST(0.25 AS DOUBLE)").replace("CAST(0.3 AS DOUBLE)", "CAST(0.75 AS DOUBLE)") + " SELECT chunk_id, round(fused_score, 12) AS fused_score, source, fused_rank FROM r WHERE fused_rank <= 10")
def weighted_fusion(spark, sf):
    """Weights of 1 and 3, made to sum to one."""
    found = search.hybrid(vector_chunks(spark, sf), TERMS, first_vector(spark, sf), 10, 0.0, search.resolve_weights(1, 3))
    return found.select("chunk_id", F.round("fused_score", 12).alias("fused_score"), "source", "fused_rank")


@query(
    f"WITH m AS (SELECT chunk_id, list_filter(list_transform(t, lambda x, i: {{'i': i, 'k': CASE WHEN starts_with(x, 'the') THEN 1 WHEN starts_with(x, 'an') THEN 2 END}}), lambda y: y.k IS NOT NULL) AS w FROM (SELECT chunk_id, {_TOKENS} AS t FROM {_CHUNKS})),"
    " d AS (SELECT chunk_id, list_sum(list_transform(range(1, len(w)), lambda j: CASE WHEN w[j].k <> w[j + 1].k THEN 0.1::DOUBLE / (w[j + 1].i - w[j].i) ELSE 0 END)) AS density FROM m WHERE len(list_distinct(list_transform(w, lambda y: y.k))) = 2),"
    " top AS (SELECT chunk_id, round(density, 9) AS density FROM d ORDER BY round(density, 9) DESC, chunk_id LIMIT 30) SELECT chunk_id, density FROM top"
)
def lexical_cover_density(spark, sf):
    """Of two terms the minimal covers are neighbouring matches of either."""
    found = search.cover_density_search(chunks(spark, sf), TERMS, 100_000_000)
    return found.select("chunk_id", F.round("density", 9).alias("density")).orderBy(F.desc("density"), "chunk_id").limit(30)


_META = "CASE doc_id % 4 WHEN 0 THEN {'page': doc_id, 'heading': lang}::JSON WHEN 1 THEN {'page': 'p' || doc_id, 'section': source}::JSON WHEN 2 THEN {'page': [1, 2], 'heading': 5, 'section': source}::JSON END"


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'p' || doc_id END AS citation_page, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN source END AS citation_section,"
    " CASE WHEN doc_id % 2 = 0 THEN 0.0::DOUBLE ELSE 0.5 END AS similarity FROM documents"
)
def citations(spark, sf):
    """Numbers and texts are pages, lists are not; a heading that is no text leaves no section, whatever the section says."""
    i, none = F.col("doc_id"), F.lit(None)
    meta = F.when(i % 4 == 0, F.to_json(F.struct(i.alias("page"), F.col("lang").alias("heading")))).when(i % 4 == 1, F.to_json(F.struct(F.concat(F.lit("p"), i).alias("page"), F.col("source").alias("section"))))
    meta = meta.when(i % 4 == 2, F.to_json(F.struct(F.array(F.lit(1), F.lit(2)).alias("page"), F.lit(5).alias("heading"), F.col("source").alias("section")))).otherwise(none.cast("string"))
    given = load(spark, sf, "documents").withColumns({"metadata": meta, "similarity": F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(0.5)})
    return search.cited(given).select("doc_id", "citation_page", "citation_section", "similarity")


# --- rerank ---


def _by_length():
    """A scorer: the text's length, folded."""
    return lambda pairs: [{"score": len(t) % 97 / 97} for _, t in pairs]


def _broken():
    raise RuntimeError("no such service")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = batch(spark, sf, 10).join(load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return found.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.lit("q").alias("query"), "text", "similarity")


_RERANKED = f"WITH {_BATCH}, s AS (SELECT query_id, chunk_id, rank, similarity, (length(text) % 97) / 97.0::DOUBLE AS score FROM br JOIN documents ON doc_id = chunk_id WHERE rank <= 10), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rerank_rank FROM s)"


@query(f"{_RERANKED} SELECT query_id, chunk_id, round(score, 9) AS similarity, round(similarity, 9) AS original_similarity, rerank_rank, 'bge' AS rerank_provider FROM o WHERE rerank_rank <= 5")
def reranked(spark, sf):
    """The local scorer."""
    rerank.register("bge", _by_length)
    found = rerank.rerank(_candidates(spark, sf), "bge", 5)
    return found.select("query_id", "chunk_id", F.round("similarity", 9).alias("similarity"), F.round("original_similarity", 9).alias("original_similarity"), "rerank_rank", "rerank_provider")


@query(f"{_RERANKED} SELECT query_id, chunk_id, rerank_rank, 'bge' AS rerank_provider FROM o WHERE rerank_rank <= 3")
def rerank_fallback(spark, sf):
    """A remote scorer that fails hands over to the local one."""
    rerank.register("bge", _by_length)
    rerank.register("cohere", _broken)
    return rerank.rerank(_candidates(spark, sf), rerank.choose_provider("cohere"), 3).select("query_id", "chunk_id", "rerank_rank", "rerank_provider")


def _partly():
    """Fails at some candidates, names the others by index."""

    def run(pairs):
        if any(len(t) % 97 < 3 for _, t in pairs):
            raise RuntimeError("no answer")
        return [{"index": i, "relevance_score": 1 - len(t) % 89 / 89} for i, (_, t) in enumerate(pairs)]

    return run


def _seldom():
    def run(pairs):
        if any(len(t) % 53 == 0 for _, t in pairs):
            raise RuntimeError("out of memory")
        return _by_length()(pairs)

    return run


@query(
    f"WITH {_BATCH}, c AS (SELECT query_id, chunk_id, rank, similarity, length(text) AS n FROM br JOIN documents ON doc_id = chunk_id WHERE rank <= 10), p AS (SELECT *, CASE WHEN NOT bool_or(n % 97 < 3) OVER q THEN 'cohere' WHEN NOT bool_or(n % 53 = 0) OVER q THEN 'bge' ELSE 'none' END AS rerank_provider FROM c WINDOW q AS (PARTITION BY query_id)),"
    " s AS (SELECT *, CASE rerank_provider WHEN 'cohere' THEN 1 - (n % 89) / 89.0::DOUBLE WHEN 'bge' THEN (n % 97) / 97.0::DOUBLE ELSE similarity END AS score FROM p),"
    " o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rerank_provider <> 'none' THEN score END DESC, rank) AS INTEGER) AS rerank_rank FROM s) SELECT query_id, chunk_id, round(score, 9) AS score, rerank_rank, rerank_provider FROM o WHERE rerank_rank <= 5"
)
def rerank_partly_failing(spark, sf):
    """Scorers that fail at some candidates: every query's scores are of one provider, whichever answered for all of them."""
    rerank.register("cohere", _partly)
    rerank.register("bge", _seldom)
    try:
        found = rerank.rerank(_candidates(spark, sf), "cohere", 5)
    finally:
        rerank.register("bge", _by_length)
    return found.select("query_id", "chunk_id", F.round("rerank_score", 9).alias("score"), "rerank_rank", "rerank_provider")


# --- approaches ---


@query(f"SELECT chunk_id, list_transform(range(1, 17), lambda i: CASE WHEN i <= length(text) THEN round((unicode(substr(text, i, 1)) % 255) / 255.0::DOUBLE, 9) ELSE 0 END) AS v FROM {_CHUNKS}")
def character_vectors(spark, sf):
    return chunks(spark, sf).select("chunk_id", F.transform(vectors.character_vector(F.substring("text", 1, groups.EMBEDDED)), lambda x: F.round(x, 9)).alias("v"))


_PAIRS = (
    f"a AS (SELECT query_id, approach, approach * 0.25 AS score, {_SET} AS t FROM {_ROLES}), p AS (SELECT x.query_id, x.approach AS a, y.approach AS b, len(list_intersect(x.t, y.t)) * 1.0::DOUBLE / len(list_distinct(list_concat(x.t, y.t))) AS o, abs(x.score - y.score) AS d"
    " FROM a x JOIN a y ON x.query_id = y.query_id AND x.approach < y.approach WHERE len(x.t) > 0 AND len(y.t) > 0),"
    " w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o + d DESC, a, b) AS pair_rank FROM p WHERE o BETWEEN 0.1 AND 0.9)"
)
_SEVERITY = "CASE (query_id + a + b) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END"


def _sourced(spark: SparkSession, sf: str) -> DataFrame:
    """Approaches of the roles of conversations, each with one source named after it."""
    name = F.concat_ws("-", "query_id", "approach")
    source = F.struct(name.alias("title"), F.lit(None).cast("string").alias("url"), F.substring("summary", 1, 20).alias("statement"), F.lit("verified").alias("quality"), F.lit(None).cast("string").alias("date"))
    return role_approaches(spark, sf).withColumns({"topic": name, "method": name, "sources": F.array(source)})


def _judge():
    """A judge that finds every pair contradictory; how much it says by the numbers in their titles."""

    def ask(a: dict, b: dict) -> str:
        (q, x), (_, y) = (s["title"].split("-") for s in (a, b))
        kind = (int(q) + int(x) + int(y)) % 4
        said = {"contradiction": True, "severity": {0: "high", 1: "low"}.get(kind), "difference": a["statement"][:5], "confidence": kind * 0.5}
        return f"Well: {json.dumps(said)} so."

    return ask


def _conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = _sourced(spark, sf)
    return groups.judge(groups.conflict_pairs(found, 0.1, 0.9), found, _judge)


@query(
    f"WITH {_PAIRS} SELECT w.query_id, CAST(pair_rank AS INTEGER) AS pair_rank, w.query_id || '-' || a AS a_title, w.query_id || '-' || b AS b_title, {_SEVERITY.replace('query_id', 'w.query_id')} AS severity, substr(r.summary, 1, 5) AS difference, least(1.0, (w.query_id + a + b) % 4 * 0.5)::DOUBLE AS confidence"
    f" FROM w JOIN {_ROLES} r ON r.query_id = w.query_id AND r.approach = a WHERE pair_rank <= 6"
)
def judged_conflicts(spark, sf):
    """Summaries of up to 400 characters are the statement itself, so the difference quotes them."""
    return _conflicts(spark, sf).select("query_id", "pair_rank", "a_title", "b_title", "severity", "difference", "confidence")


@query(
    f"WITH {_PAIRS}, n AS (SELECT query_id, unnest([a, b]) AS approach, pair_rank, {_SEVERITY} AS severity FROM w WHERE pair_rank <= 6), h AS (SELECT query_id, approach, arg_min(CASE severity WHEN 'high' THEN 0.3 WHEN 'medium' THEN 0.15 ELSE 0.05 END, pair_rank) AS penalty FROM n GROUP BY ALL),"
    " s AS (SELECT a.query_id, a.approach, round(score - coalesce(penalty, 0), 9) AS score FROM a LEFT JOIN h ON h.query_id = a.query_id AND h.approach = a.approach)"
    " SELECT query_id, CAST(approach AS INTEGER) AS approach, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, approach) AS r FROM s) WHERE r = 1"
)
def recommended(spark, sf):
    found = groups.recommended(_sourced(spark, sf), _conflicts(spark, sf))
    return found.select("query_id", "approach", F.round("score", 9).alias("score"))


def _clusters_sql() -> str:
    """Cosine k-means of each query's 15 best results as one step after another."""
    cos = "coalesce(list_cosine_similarity(v, c), 0)"
    out = [
        f"WITH {_BATCH}, x AS (SELECT query_id, rank AS pos, CAST(e.embedding AS DOUBLE[]) AS v FROM br JOIN embeddings e ON e.vec_id = chunk_id JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 15)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY query_id) AS m FROM x)",
        "c0 AS (SELECT query_id, CAST(n - 1 AS INTEGER) AS k, v AS c, false AS done FROM o WHERE n <= greatest(1, least(3, CASE WHEN m // 3 = 0 THEN 1 ELSE m // 3 END)))",
    ]
    for i in range(groups.ROUNDS):
        out.append(f"a{i} AS (SELECT query_id, pos, v, arg_max({{'k': k}}, {{'s': {cos}, 'k': -k}}).k AS k FROM o JOIN c{i} USING (query_id) GROUP BY query_id, pos, v)")
        out.append(f"m{i} AS (SELECT query_id, k, list(y ORDER BY j) AS c FROM (SELECT query_id, k, j, avg(v[j]) AS y FROM a{i}, range(1, 65) t(j) GROUP BY query_id, k, j) GROUP BY query_id, k)")
        out.append(f"d{i} AS (SELECT c{i}.query_id, c{i}.done OR bool_and(m.c IS NOT NULL AND list_max(list_transform(range(1, 65), lambda j: abs(m.c[j] - c{i}.c[j]))) < 1e-4) OVER (PARTITION BY c{i}.query_id) AS done, c{i}.k, c{i}.c AS old, m.c AS new FROM c{i} LEFT JOIN m{i} m ON m.query_id = c{i}.query_id AND m.k = c{i}.k)")
        out.append(f"c{i + 1} AS (SELECT query_id, k, CASE WHEN done THEN old ELSE new END AS c, done FROM d{i})")
    last = groups.ROUNDS
    out.append(f"s AS (SELECT a.query_id, a.pos, a.k, greatest(0, least(1, coalesce(list_cosine_similarity(a.v, c.c), 0))) AS similarity FROM a{last - 1} a JOIN c{last} c ON c.query_id = a.query_id AND c.k = a.k)")
    out.append("z AS (SELECT query_id, pos, similarity, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY k) - 1 AS INTEGER) AS approach FROM s)")
    return ", ".join(out)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector query's best results with their vectors and texts."""
    e = load(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return batch(spark, sf, 15).join(e.select("chunk_id", "embedding"), "chunk_id").join(docs, "chunk_id").withColumnRenamed("rank", "pos")


@query(f"{_clusters_sql()} SELECT query_id, pos, approach, round(similarity, 6) AS centroid_similarity FROM z")
def clusters(spark, sf):
    """Which approach each of a query's best results belongs to, and how near it is to the approach's mean."""
    return groups.clustered(_results(spark, sf)).select("query_id", "pos", "approach", F.round("centroid_similarity", 6).alias("centroid_similarity"))


@query(
    f"{_clusters_sql()}, y AS (SELECT z.query_id, approach, z.pos, z.similarity, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM z JOIN br ON br.query_id = z.query_id AND br.rank = z.pos JOIN documents d ON d.doc_id = br.chunk_id),"
    " g AS (SELECT query_id, approach, arg_min(source, pos) AS topic, count(*) AS n_sources, avg(similarity) AS s, list(t ORDER BY pos) FILTER (length(t) > 0) AS texts FROM y GROUP BY ALL)"
    " SELECT query_id, approach, topic, topic AS method, substr(array_to_string(texts[1:2], ' '), 1, 360) AS summary, round(CASE WHEN n_sources = 1 THEN 1.0 ELSE greatest(0, least(1, 0.4 * 0.85 + 0.4 * s + 0.2)) END, 6)::DOUBLE AS consensus_score, CAST(n_sources AS INTEGER) AS n_sources FROM g"
)
def approaches(spark, sf):
    """Clusters of each vector query's best results."""
    none = F.lit(None).cast("string")
    full = _results(spark, sf).withColumns({"title": F.col("source"), "url": none, "quality": F.lit("verified"), "verified": F.lit(AS_OF.date()), "published": F.lit(None).cast("date"), "topic": none, "method": none, "query": F.lit("q")})
    found = groups.approaches(groups.clustered(full), F.lit(AS_OF).cast("timestamp"))
    return found.select("query_id", "approach", "topic", "method", "summary", F.round("consensus_score", 6).alias("consensus_score"), F.size("sources").alias("n_sources"))


# --- evaluation ---

_GAINS = f"WITH {_BATCH}, g AS (SELECT query_id, avg(CAST(relevant AS INTEGER)) FILTER (rank <= 5) - avg(CAST(relevant AS INTEGER)) FILTER (rank <= 10) AS delta FROM br WHERE rank <= 10 GROUP BY query_id)"


def _gains(spark: SparkSession, sf: str) -> DataFrame:
    ranked = judged(spark, sf)
    both = evaluate.precision_at(ranked, 5).join(evaluate.precision_at(ranked, 10), "query_id")
    return both.select("query_id", F.round(F.col("p_at_5") - F.col("p_at_10"), 9).alias("delta"))


@query(f"{_GAINS} SELECT query_id, round(delta, 9) AS delta FROM g ORDER BY round(delta, 9) DESC, query_id LIMIT 5")
def best_gains(spark, sf):
    return evaluate.best_gains(_gains(spark, sf))


@query(f"{_GAINS} SELECT query_id, round(delta, 9) AS delta FROM g WHERE round(delta, 9) <= 0.001 ORDER BY query_id LIMIT 5")
def queries_without_gain(spark, sf):
    return evaluate.without_gain(_gains(spark, sf))


@query("SELECT source AS topic, CAST(doc_id % 1 AS INTEGER) AS part, list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR)) AS ids FROM documents GROUP BY ALL")
def topic_lists(spark, sf):
    return evaluate.topic_index(documents(spark, sf).select("id", F.array("collection_id").alias("topics")))
