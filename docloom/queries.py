"""Registered queries over the test tables, each with its SQL where SQL can say it.

The tables stand for the model: documents (a collection is a source), conversations (chunks: conversation and turn),
embeddings (vectors of documents of the same number), events (usage), pages, benchmark (queries), labels (quality).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import present, rules, text, urls, vectors
from .operators import approaches as groups
from .operators import catalog, cost, evaluate, rerank, search
from .session import load
from .sources import files, web
from .streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF, NOW = datetime(2024, 1, 20, 12), "TIMESTAMP '2024-01-20 12:00:00'"
TERMS = "the an"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- the model over the test tables ---

_PROVIDERS = ("openai", "voyage", "cohere", "anthropic")
_USAGE = f"""(SELECT event_id AS usage_id, CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'voyage' WHEN 2 THEN 'cohere' ELSE 'anthropic' END AS provider,
  event_type AS operation, CAST(round(value * 100) AS BIGINT) AS tokens_used, CAST(value / 100 AS DECIMAL(10,4)) AS cost_usd, ts AS created_at FROM events)"""
_QUALITY = "CASE WHEN quality = 1 AND toxic = 0 THEN 'official' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'community' END"
_CHUNKS = "(SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS doc_id, CAST(turn AS INTEGER) AS chunk_index, text, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_count, role FROM conversations)"
_DAY = "CAST(DATE '2024-01-15' - CAST(doc_id % 1000 AS INTEGER) AS DATE)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    key = lambda k, v: [F.lit(k), v]
    meta = F.create_map(*key("language", F.col("lang")), *key("doc_type", F.when(F.col("doc_id") % 7 == 0, "code_sample").otherwise("tutorial")), *key("embedding_provider", F.when(F.col("doc_id") % 3 == 0, "voyage").otherwise("ollama")))
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("collection_id"), F.substring("text", 1, 30).alias("title"), "text", F.when(F.col("doc_id") % 5 == 0, "error").when(F.col("doc_id") % 2 == 0, "complete").otherwise("pending").alias("status"),
        F.when(F.col("doc_id") % 5 == 0, "no text").alias("error_message"), meta.alias("metadata"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("created_at"),
        F.when(F.col("doc_id") % 2 == 0, F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(0, 0, 0, doc_id)")).alias("processed_at"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/f/"), F.col("doc_id"), F.lit(".md"))).alias("file_path"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"), "doc_id",
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "text", text.token_estimate(F.col("text")).cast("int").alias("token_count"), "role")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    provider = F.element_at(F.array(*map(F.lit, _PROVIDERS)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("usage_id"), provider.alias("provider"), F.col("event_type").alias("operation"), F.round(F.col("value") * 100).cast("long").alias("tokens_used"), (F.col("value") / 100).cast("decimal(10,4)").alias("cost_usd"), F.col("ts").alias("created_at"))


def quality_of_labels() -> Column:
    return F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "official").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "community")


def rated_documents(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_sub(F.lit("2024-01-15").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    return load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id", quality_of_labels().alias("q")), "doc_id", "left").withColumn("day", day)


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(load(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"])


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return e.join(load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source"), "chunk_id")


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_VECTOR = f"""v AS (SELECT e.vec_id AS chunk_id, {_COSINE} AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND {_COSINE} >= 0.0)"""
_TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_START = lambda w: f"starts_with(w, '{w}')"
_MATCH = lambda table, id_: f"""m AS (SELECT {id_} AS chunk_id, CAST(len(list_filter(t, lambda w: {_START("the")} OR {_START("an")})) AS BIGINT) AS tf FROM (SELECT *, {_TOKENS} AS t FROM {table})
  WHERE len(list_filter(t, lambda w: {_START("the")})) > 0 AND len(list_filter(t, lambda w: {_START("an")})) > 0), l AS (SELECT * FROM m ORDER BY tf DESC, chunk_id LIMIT 30)"""  # noqa: E731
_FUSED = f"""WITH {_VECTOR}, vt AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rv FROM v ORDER BY similarity DESC, chunk_id LIMIT 30),
 {_MATCH("(SELECT doc_id, text FROM documents JOIN embeddings ON vec_id = doc_id)", "doc_id")}, lt AS (SELECT *, row_number() OVER (ORDER BY tf DESC, chunk_id) AS rl, tf * 1.0 / max(tf) OVER () AS score FROM l),
 f AS (SELECT coalesce(vt.chunk_id, lt.chunk_id) AS chunk_id, coalesce(CAST(0.7 AS DOUBLE) / (60 + rv), 0) + coalesce(CAST(0.3 AS DOUBLE) / (60 + rl), 0) AS fused_score, coalesce(similarity, 0) AS vector_score, CAST(coalesce(score, 0) AS DOUBLE) AS lexical_score,
  CASE WHEN rl IS NULL THEN 'vector' WHEN rv IS NULL THEN 'bm25' ELSE 'both' END AS source, rv, rl FROM vt FULL OUTER JOIN lt ON vt.chunk_id = lt.chunk_id),
 r AS (SELECT *, CAST(row_number() OVER (ORDER BY fused_score DESC, rv NULLS LAST, rl NULLS LAST, chunk_id) AS INTEGER) AS fused_rank FROM f)"""

# --- search ---


@query(f"WITH {_VECTOR} SELECT chunk_id, d.source AS collection, round(similarity, 9) AS similarity FROM v JOIN documents d ON d.doc_id = chunk_id ORDER BY v.similarity DESC, chunk_id LIMIT 5")
def vector_topk(spark, sf):
    found = search.vector_search(load(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id").join(load(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection")), "chunk_id"), first_vector(spark, sf), 5, 0.0)
    return found.select("chunk_id", "collection", F.round("similarity", 9).alias("similarity"))


_BATCH = """b AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label = q.label AS relevant, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS similarity
 FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), br AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM b WHERE similarity >= 0.0)"""


def batch(spark: SparkSession, sf: str, top: int) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return search.vector_search_batch(e.withColumnRenamed("vec_id", "chunk_id"), e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), top, 0.0, exclude_self=True)


@query(f"WITH {_BATCH} SELECT query_id, chunk_id, round(similarity, 9) AS similarity, rank FROM br WHERE rank <= 10")
def vector_topk_batch(spark, sf):
    return batch(spark, sf, 10).select("query_id", "chunk_id", F.round("similarity", 9).alias("similarity"), "rank")


@query(f"WITH {_MATCH(_CHUNKS, 'chunk_id')} SELECT chunk_id, tf, round(tf * 1.0 / max(tf) OVER (), 9) AS score, CAST(row_number() OVER (ORDER BY tf DESC, chunk_id) AS INTEGER) AS rank FROM l")
def lexical_prefix_match(spark, sf):
    return search.lexical_search(chunks(spark, sf), TERMS).withColumn("score", F.round("score", 9))


@query(f"SELECT term, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_positions FROM (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest({_TOKENS}) AS term FROM {_CHUNKS}) GROUP BY ALL) GROUP BY term")
def term_index(spark, sf):
    return search.term_index(chunks(spark, sf)).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum(F.size("positions")).cast("long").alias("n_positions"))


def fused(spark: SparkSession, sf: str, top: int = 10) -> DataFrame:
    return search.hybrid(vector_chunks(spark, sf), TERMS, first_vector(spark, sf), top, 0.0)


@query(f"{_FUSED} SELECT chunk_id, round(fused_score, 12) AS fused_score, round(vector_score, 9) AS vector_score, round(lexical_score, 9) AS lexical_score, source, fused_rank FROM r WHERE fused_rank <= 10")
def rrf_fusion(spark, sf):
    return fused(spark, sf).select("chunk_id", F.round("fused_score", 12).alias("fused_score"), F.round("vector_score", 9).alias("vector_score"), F.round("lexical_score", 9).alias("lexical_score"), "source", "fused_rank")


_TRUST = "CASE q WHEN 'official' THEN 1.0 WHEN 'verified' THEN 0.85 WHEN 'community' THEN 0.6 ELSE 0.5 END"
_MONTHS = "((2024 - year(day)) * 12 + 1 - month(day) - CASE WHEN 20 < day(day) THEN 1 ELSE 0 END)"
_RECENCY = f"CASE WHEN {_MONTHS} < 6 THEN 1.0 WHEN {_MONTHS} < 12 THEN 0.9 ELSE 0.7 END"
_RATED = f"(SELECT d.doc_id, d.source, d.lang, d.n_chars, {_QUALITY} AS q, {_DAY.replace('doc_id', 'd.doc_id')} AS day FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query(f"{_FUSED} SELECT chunk_id, CAST({_TRUST} AS DOUBLE) AS trust_weight, CAST({_RECENCY} AS DOUBLE) AS recency_weight, round(fused_score * CAST({_TRUST} AS DOUBLE) * CAST({_RECENCY} AS DOUBLE), 12) AS fused_score FROM r JOIN {_RATED} x ON x.doc_id = chunk_id WHERE fused_rank <= 10")
def hybrid_trust(spark, sf):
    """The flagship: both legs, fused, weighed by trust and recency."""
    rated = rated_documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "q", "day")
    joined = rated.join(F.broadcast(fused(spark, sf)), "chunk_id")  # ten rows
    found = search.trusted(joined, F.col("q"), F.col("day"), F.lit(AS_OF).cast("timestamp"))
    return found.select("chunk_id", "trust_weight", "recency_weight", F.round("fused_score", 12).alias("fused_score"))


@query(f"{_FUSED} SELECT count(*) FILTER (source IN ('vector', 'both')) AS vector_count, count(*) FILTER (source IN ('bm25', 'both')) AS bm25_count, count(*) AS fused_count FROM r WHERE fused_rank <= 10")
def search_counters(spark, sf):
    return search.counters(fused(spark, sf).withColumn("query_id", F.lit(0))).drop("query_id")


@query(f"{_FUSED} SELECT chunk_id, round(vector_score, 9) AS rerank_score, 'none' AS rerank_provider, CAST(row_number() OVER (ORDER BY fused_rank) AS INTEGER) AS rerank_rank FROM r WHERE fused_rank <= 5")
def rerank_passthrough(spark, sf):
    given = fused(spark, sf).select(F.lit(0).alias("query_id"), "chunk_id", F.col("fused_rank").alias("pos"), F.lit(TERMS).alias("query"), F.lit("").alias("text"), F.col("vector_score").alias("similarity"))
    return rerank.rerank(given, "none", 5).select("chunk_id", F.round("rerank_score", 9).alias("rerank_score"), "rerank_provider", "rerank_rank")


@query(f"SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'with', ''))) / 4 AS BIGINT) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'with') ORDER BY score DESC, doc_id LIMIT 50")
def term_occurrences(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.occurrences(F.col("text"), ["the", "an", "with"]).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


_HITS = lambda w: f"len(regexp_extract_all(lower(text), '\\b{w}\\b'))"


@query(
    f"SELECT d.doc_id, round(0.8 * ({_HITS('the')} + {_HITS('with')} + {_HITS('und')}) + CASE WHEN lang = 'en' THEN 1.6 + 0.05 * count(*) OVER (PARTITION BY lang) ELSE 0 END + coalesce(CASE WHEN quality = 1 THEN 0.5 END, 0)"
    f" + 4.0 * {_HITS('with')} / len(string_split_regex(lower(text), '\\s+')), 6) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def feature_rerank(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.array("lang").alias("topics"), F.lit(0.0).alias("score"))
    boosts = load(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("with").alias("token"), F.lit(0.5).alias("weight"))
    return rerank.feature_scores(docs, ["the", "with", "und", "en"], boosts).select("doc_id", F.round("score", 6).alias("score"))


# --- catalogue ---


@query("SELECT source AS id, count(*) AS doc_count FROM documents GROUP BY source UNION ALL SELECT 'empty', 0")
def collections_with_counts(spark, sf):
    d = documents(spark, sf)
    cols = d.groupBy(F.col("collection_id").alias("id")).agg(F.max("created_at").alias("created_at")).union(spark.createDataFrame([("empty", AS_OF)], "id string, created_at timestamp_ntz"))
    return catalog.collections_with_counts(cols, d).select("id", "doc_count")


@query(f"SELECT d.doc_id, count(c.chunk_id) AS chunk_count, CAST(sum(c.token_count) AS BIGINT) AS token_count FROM documents d LEFT JOIN {_CHUNKS} c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def documents_with_chunk_stats(spark, sf):
    return catalog.chunk_stats(documents(spark, sf).withColumn("id", F.col("doc_id")), chunks(spark, sf)).select("doc_id", "chunk_count", "token_count")


@query(f"SELECT d.doc_id, count(c.chunk_id) AS chunk_count, CAST(sum(c.token_count) AS BIGINT) AS token_count FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0 ORDER BY doc_id DESC LIMIT 50) d LEFT JOIN {_CHUNKS} c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def list_documents(spark, sf):
    return catalog.list_documents(documents(spark, sf).withColumn("id", F.col("doc_id")), chunks(spark, sf), status="complete").select("doc_id", "chunk_count", "token_count")


@query(f"SELECT '7' AS id, 'pending' AS status, count(*) AS chunk_count, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM {_CHUNKS} WHERE doc_id = 7")
def document_status(spark, sf):
    return catalog.document_status(documents(spark, sf), chunks(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string")), "7").select("id", "status", "chunk_count", "total_tokens")


@query(
    "SELECT source AS collection_id, CASE WHEN doc_id % 3 = 0 THEN 'voyage' ELSE 'ollama' END AS embedding_provider, CASE WHEN doc_id % 7 = 0 THEN 'code_sample' ELSE 'tutorial' END AS doc_type, lang AS language FROM"
    " (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 2 = 0 THEN -doc_id END DESC NULLS LAST, doc_id DESC) AS n FROM documents) WHERE n = 1"
)
def latest_doc_hint(spark, sf):
    return catalog.embedding_hints(documents(spark, sf))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_chunks FROM conversations WHERE turn < 3 GROUP BY conv_id")
def first_chunks(spark, sf):
    return catalog.first_chunks(chunks(spark, sf), 3)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 20")
def conversation_history_window(spark, sf):
    return catalog.recent_turns(load(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conversation_usage(spark, sf):
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


@query(f"SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN text || '!' ELSE text END AS text, token_count FROM {_CHUNKS} UNION ALL SELECT -1 - doc_id, 'new', 1 FROM documents")
def upsert_chunks(spark, sf):
    old = chunks(spark, sf).drop("role")
    changed = old.filter("chunk_index % 2 = 0").withColumns({"text": F.concat("text", F.lit("!")), "chunk_id": F.lit(0).cast("long")})
    added = load(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("chunk_id"), (-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("new").alias("text"), F.lit(1).alias("token_count"))
    return catalog.upsert(old, changed.unionByName(added), ["doc_id", "chunk_index"], ["chunk_id"]).select("chunk_id", "text", "token_count")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'complete' WHEN doc_id % 5 = 0 THEN 'error' ELSE 'complete' END AS status, CASE WHEN doc_id % 2 = 1 THEN {NOW} WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-02-01' - to_seconds(doc_id) END AS processed_at FROM documents")
def status_update(spark, sf):
    return catalog.set_status(documents(spark, sf), F.col("doc_id") % 2 == 1, "complete", F.lit(AS_OF).cast("timestamp_ntz")).select("doc_id", "status", "processed_at")


@query("SELECT doc_id, 'guide' AS doc_type, lang AS language, 'x' AS extra FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'code_sample' ELSE 'tutorial' END, lang, NULL FROM documents WHERE doc_id % 2 = 1")
def metadata_merge(spark, sf):
    more = F.create_map(F.lit("doc_type"), F.lit("guide"), F.lit("extra"), F.lit("x"))
    value = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return catalog.merge_metadata(documents(spark, sf), F.col("doc_id") % 2 == 0, more).select("doc_id", value("doc_type"), value("language"), value("extra"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'pending' END AS status, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'no text' END AS error_message FROM documents")
def restart_ingest(spark, sf):
    return catalog.restart(documents(spark, sf), F.lit(True), F.lit(AS_OF).cast("timestamp_ntz")).select("doc_id", "status", "error_message")


@query(f"SELECT chunk_id FROM {_CHUNKS} WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def delete_cascade(spark, sf):
    d = documents(spark, sf).withColumn("id", F.col("doc_id"))
    cols = d.select(F.col("collection_id").alias("id")).distinct()
    return catalog.delete_collection(cols, d, chunks(spark, sf), spark.createDataFrame([("src1",), ("src2",)], "id string"))[2].select("chunk_id")


@query("SELECT source AS id FROM documents GROUP BY source UNION SELECT 'seed'")
def insert_absent(spark, sf):
    cols = documents(spark, sf).select(F.col("collection_id").alias("id")).distinct()
    return catalog.insert_absent(cols, spark.createDataFrame([("seed",), ("src1",), ("seed",)], "id string"), ["id"])


# --- cost ---


@query(f"SELECT CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS spend FROM {_USAGE} WHERE created_at >= date_trunc('month', {NOW})")
def monthly_spend(spark, sf):
    return cost.spend_since_month(usage(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")).select(F.col("spend").cast("double").alias("spend"))


@query(f"SELECT CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS spend FROM {_USAGE} WHERE created_at >= TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-21'")
def daily_spend(spark, sf):
    return cost.spend_of_day(usage(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")).select(F.col("spend").cast("double").alias("spend"))


_BREAKDOWN = f"SELECT provider, operation, count(*) AS request_count, CAST(sum(tokens_used) AS BIGINT) AS total_tokens, CAST(sum(cost_usd) AS DOUBLE) AS total_cost, round(CAST(sum(cost_usd) AS DOUBLE) / count(*), 6) AS avg_cost_per_request FROM {_USAGE} WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND {NOW} GROUP BY provider, operation"


def _breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return cost.breakdown(usage(spark, sf), F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz"), F.lit(AS_OF).cast("timestamp_ntz"))


@query(_BREAKDOWN)
def cost_breakdown(spark, sf):
    return _breakdown(spark, sf).select("provider", "operation", "request_count", "total_tokens", F.col("total_cost").cast("double").alias("total_cost"), F.round(F.col("total_cost").cast("double") / F.col("request_count"), 6).alias("avg_cost_per_request"))


@query(f"SELECT provider, operation, CAST(floor(total_cost / sum(total_cost) OVER () * 100 + 0.5) AS INTEGER) AS percentage FROM ({_BREAKDOWN})")
def cost_share(spark, sf):
    return cost.share(_breakdown(spark, sf).withColumn("total_cost", F.col("total_cost").cast("double"))).select("provider", "operation", "percentage")


@query(f"SELECT round(s, 4) AS current_spend, CAST(200 AS DOUBLE) AS budget, round(s / 200 * 100, 6) AS percentage, round(greatest(0, 200 - s), 4) AS remaining, CASE WHEN s >= 200 THEN 'limit_reached' WHEN s > 160 THEN 'warning' END AS state FROM (SELECT CAST(sum(cost_usd) AS DOUBLE) AS s FROM {_USAGE} WHERE created_at >= TIMESTAMP '2024-01-01')")
def budget_status(spark, sf):
    found = cost.summary(cost.spend_since_month(usage(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")), 200)
    return found.select(F.round("current_spend", 4).alias("current_spend"), "budget", F.round("percentage", 6).alias("percentage"), F.round("remaining", 4).alias("remaining"), "state")


@query(f"SELECT usage_id, round(CASE provider WHEN 'openai' THEN tokens_used / 1000 * 0.00013 WHEN 'voyage' THEN tokens_used / 1000 * 0.00012 WHEN 'cohere' THEN CASE WHEN operation = 'click' THEN 0.001 ELSE tokens_used / 1000 * 0.001 END ELSE tokens_used / 1000 * 0.00025 END, 9) AS price FROM {_USAGE}")
def usage_price(spark, sf):
    u = usage(spark, sf).withColumn("operation", F.when(F.col("operation") == "click", "rerank").otherwise(F.col("operation")))
    return u.select("usage_id", F.round(rules.price(F.col("provider"), F.lit(None).cast("string"), F.col("operation"), F.col("tokens_used")), 9).alias("price"))


@query(f"SELECT date_trunc('day', created_at) AS window_start, provider, operation, count(*) AS request_count, CAST(sum(cost_usd) AS DOUBLE) AS total_cost FROM {_USAGE} GROUP BY ALL")
def usage_windows(spark, sf):
    return flows.usage_windows(usage(spark, sf)).withColumns({"total_cost": F.col("total_cost").cast("double"), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query(f"SELECT usage_id FROM {_USAGE} WHERE operation = 'error' ORDER BY created_at DESC LIMIT 50")
def recent_alerts(spark, sf):
    return cost.recent_alerts(usage(spark, sf).filter("operation = 'error'").select("usage_id", F.col("created_at").alias("triggered_at"), F.col("operation").alias("alert_type")), 99).select("usage_id")


# --- ingest ---

_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN {_TRIM} = '' THEN 0 ELSE len(string_split_regex({_TRIM}, '\\s+')) END AS words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(len(string_split_regex(text, '\\s+')) * 0.75) AS BIGINT) AS billed FROM documents")
def token_estimates(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", text.word_count(t).alias("words"), text.token_estimate(t).alias("tokens"), text.billed_tokens(t).alias("billed"))


@query("SELECT doc_id, CASE WHEN length(h) <= 120 AND regexp_matches(h, '^[#A-Z]') THEN h END AS heading FROM (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS h FROM documents)")
def chunk_headings(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.heading(F.col("text")).alias("heading"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'voyage' WHEN doc_id % 4 = 2 THEN 'openai' WHEN contains(text, '//') OR regexp_matches(text, '(?m)^\\s*(import|export)\\s+|^\\s*(class|interface|enum)\\s+\\w+') THEN 'voyage' ELSE 'ollama' END AS provider FROM documents")
def provider_routing(spark, sf):
    context = F.when(F.col("doc_id") % 4 == 1, "code").when(F.col("doc_id") % 4 == 2, "personal")
    return load(spark, sf, "documents").select("doc_id", rules.provider(F.col("text"), context, F.lit(None).cast("string")).alias("provider"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'build_plan' WHEN page_id % 3 = 0 THEN 'code_sample' WHEN contains(url, 'github.com') THEN 'repo' ELSE 'tutorial' END AS doc_type FROM pages")
def document_types(spark, sf):
    kind = rules.document_type(F.when(F.col("page_id") % 5 == 0, "build_plan"), F.when(F.col("page_id") % 3 == 0, "A.PY").otherwise("a.md"), F.lit(None).cast("string"), F.col("url"))
    return load(spark, sf, "pages").select("page_id", kind.alias("doc_type"))


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'official' WHEN page_id % 3 = 0 THEN 'verified' ELSE 'community' END AS source_quality FROM pages")
def source_quality_infer(spark, sf):
    stars = F.when(F.col("page_id") % 3 == 0, 5000).otherwise(2)
    return load(spark, sf, "pages").select("page_id", rules.source_quality(F.when(F.col("page_id") % 7 == 0, "official"), F.col("url"), stars, F.lit("verified")).alias("source_quality"))


_FRESH = "CASE WHEN day > DATE '2023-07-20' THEN 1.0 WHEN m <= 12 THEN 0.85 WHEN m <= 24 THEN 0.7 ELSE 0.5 END"


@query(f"SELECT doc_id, CAST({_TRUST} AS DOUBLE) AS trust, CAST({_RECENCY} AS DOUBLE) AS recency, CAST({_FRESH} AS DOUBLE) AS freshness FROM (SELECT *, (2024 - year(day)) * 12 + 1 - month(day) AS m FROM {_RATED})")
def trust_and_recency(spark, sf):
    now = F.lit(AS_OF.date())
    return rated_documents(spark, sf).select("doc_id", rules.quality_weight(F.col("q")).alias("trust"), rules.recency_weight(F.col("day"), now).alias("recency"), rules.freshness(F.col("day"), now).alias("freshness"))


@query("SELECT page_id, CASE WHEN e = '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS content_type, CASE WHEN e = '' THEN '.bin' ELSE e END AS extension FROM (SELECT page_id, regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '[^.](\\.[^.]*)$', 1) AS e FROM pages)")
def content_types(spark, sf):
    kind = urls.content_type(F.col("url"), F.lit(None).cast("string"))
    return load(spark, sf, "pages").select("page_id", kind.alias("content_type"), urls.file_extension(kind, F.col("url")).alias("extension"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'markdown' ELSE 'text' END AS extractor FROM documents")
def extract_dispatch(spark, sf):
    types = F.element_at(F.array(*map(F.lit, ("application/pdf", "application/msword", "text/markdown", "text/html"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, sf, "documents").select("doc_id", files.extractor(types).alias("extractor"))


# --- web ---


@query(
    "SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q IS NULL OR q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url FROM"
    " (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)"
)
def url_normalize(spark, sf):
    return load(spark, sf, "pages").select("page_id", urls.normalised(F.col("url")).alias("url"))


@query("SELECT page_id, page_id % 3 <> 0 AS is_public FROM pages")
def public_url(spark, sf):
    private = F.element_at(F.array(*map(F.lit, ("http://localhost/a", "https://10.1.2.3/", "http://172.20.0.1:80/x", "http://192.168.1.1", "http://[::1]/", "http://[fe80::1]/", "ftp://a.org/x", "no url"))), (F.col("page_id") % 8 + 1).cast("int"))
    return load(spark, sf, "pages").select("page_id", urls.is_public(F.when(F.col("page_id") % 3 == 0, private).otherwise(F.col("url"))).alias("is_public"))


@query()
def page_markdown(spark, sf):
    return web.pages_to_markdown(load(spark, sf, "pages"), ["page_id"])


# --- approaches ---

_ROLES = "(SELECT conv_id AS query_id, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS approach, substr(string_agg(text, ' ' ORDER BY turn), 1, 360) AS summary FROM conversations GROUP BY ALL)"
_SET = "list_distinct(list_filter(string_split_regex(lower(summary), '[^a-z0-9]+'), lambda w: w <> ''))"


def role_approaches(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    items = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id"), role.alias("approach")).agg(F.substring(F.array_join(F.transform(items, lambda x: x["text"]), " "), 1, 360).alias("summary")).withColumn("consensus_score", F.col("approach") * 0.25)


@query(
    f"WITH a AS (SELECT query_id, approach, {_SET} AS t FROM {_ROLES}), p AS (SELECT x.query_id, x.approach AS a, y.approach AS b, len(list_intersect(x.t, y.t)) * 1.0 / len(list_distinct(list_concat(x.t, y.t))) AS o, abs(x.approach - y.approach) * 0.25 AS d"
    " FROM a x JOIN a y ON x.query_id = y.query_id AND x.approach < y.approach WHERE len(x.t) > 0 AND len(y.t) > 0) SELECT query_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(o, 9) AS overlap, round(o + d, 9) AS weight FROM p WHERE o BETWEEN 0.1 AND 0.9"
)
def jaccard_pairs(spark, sf):
    return groups.conflict_pairs(role_approaches(spark, sf), 0.1, 0.9).select("query_id", "a", "b", F.round("overlap", 9).alias("overlap"), F.round("weight", 9).alias("weight"))


@query(f"SELECT source, n, round(CASE WHEN n = 1 THEN 1.0 ELSE least(1.0, greatest(0.0, 0.4 * q + 0.4 * s + 0.2 * f)) END, 9) AS consensus_score FROM (SELECT source, count(*) AS n, avg({_TRUST}) AS q, avg((n_chars % 100) / 100.0) AS s, avg({_FRESH}) AS f FROM (SELECT *, (2024 - year(day)) * 12 + 1 - month(day) AS m FROM {_RATED}) GROUP BY source)")
def consensus_score(spark, sf):
    r = rated_documents(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.avg(groups.lower_quality(F.col("q"))).alias("q"), F.avg((F.col("n_chars") % 100) / 100).alias("s"), F.avg(rules.freshness(F.col("day"), F.lit(AS_OF.date()))).alias("f"))
    return r.select("source", "n", F.round(groups.consensus(F.col("n"), F.col("q"), F.col("s"), F.col("f")), 9).alias("consensus_score"))


# --- evaluation ---


def judged(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    found = batch(spark, sf, 10)
    return found.join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("l")), "chunk_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("relevant", F.col("l") == F.col("ql"))


@query(f"WITH {_BATCH} SELECT query_id, round(avg(CAST(relevant AS INTEGER)), 9) AS p_at_5 FROM br WHERE rank <= 5 GROUP BY query_id")
def precision_at_k(spark, sf):
    return evaluate.precision_at(judged(spark, sf), 5).withColumn("p_at_5", F.round("p_at_5", 9))


@query(f"WITH {_BATCH} SELECT round(avg(rr), 9) AS mrr FROM (SELECT query_id, coalesce(1.0 / min(rank) FILTER (relevant), 0) AS rr FROM br WHERE rank <= 10 GROUP BY query_id)")
def mrr(spark, sf):
    return evaluate.mean_reciprocal_rank(judged(spark, sf)).withColumn("mrr", F.round("mrr", 9))


@query("SELECT s[1 + CAST(floor((len(s) - 1) * 0.5) AS BIGINT)] AS p50, s[1 + CAST(floor((len(s) - 1) * 0.95) AS BIGINT)] AS p95, s[1 + CAST(floor((len(s) - 1) * 0.99) AS BIGINT)] AS p99 FROM (SELECT list_sort(list(value)) AS s FROM events)")
def latency_percentile_lower(spark, sf):
    return evaluate.lower_percentiles(load(spark, sf, "events"), "value")


@query("SELECT event_type, round(CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0.0 ELSE 100.0 END ELSE (b - a) / a * 100 END, 6) AS delta FROM (SELECT event_type, CAST(count(*) FILTER (event_id % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (event_id % 2 = 1) AS DOUBLE) AS b FROM events GROUP BY event_type)")
def percentage_delta(spark, sf):
    c = load(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 2 == 0).cast("double").alias("a"), F.count_if(F.col("event_id") % 2 == 1).cast("double").alias("b"))
    return c.select("event_type", F.round(evaluate.percentage_delta(F.col("a"), F.col("b")), 6).alias("delta"))


@query("SELECT topic, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, unnest([lang, source]) AS topic FROM documents) GROUP BY topic")
def topic_index(spark, sf):
    found = evaluate.topic_index(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("topics")))
    return found.select("topic", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"))


# --- presentation ---


@query(
    "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f', n_chars * 1.0) || ' B' ELSE printf('%.1f', floor(n_chars / 1024.0 * 10 + 0.5) / 10) || ' KB' END AS size, CAST(floor((doc_id % 101) / 100.0 * 5 + 0.5) AS INTEGER) AS stars,"
    " CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'MD' ELSE 'TXT' END AS type FROM documents"
)
def presentation(spark, sf):
    types = F.element_at(F.array(*map(F.lit, ("application/pdf", "application/msword", "text/markdown", "text/plain"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, sf, "documents").select("doc_id", present.file_size(F.col("n_chars")).alias("size"), present.stars((F.col("doc_id") % 101) / 100).alias("stars"), present.type_label(types).alias("type"))


@query("SELECT doc_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM documents JOIN embeddings ON vec_id = doc_id")
def vector_norms(spark, sf):
    return vector_chunks(spark, sf).select(F.col("chunk_id").alias("doc_id"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(f"{_FUSED} SELECT '{{\"chunk_id\":' || chunk_id || ',\"source\":\"' || source || '\"}}' AS json FROM r WHERE fused_rank <= 10")
def results_as_json(spark, sf):
    return search.as_json(fused(spark, sf), ["chunk_id", "source"])


from . import queries_facade, queries_fulltext, queries_ranking, queries_stores  # noqa: E402, F401  they register their queries
