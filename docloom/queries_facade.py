"""Registered queries of whole searches, embedding with failures, and files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embed, rerank
from .plans import search as plan
from .plans.config import Config
from .queries import _CHUNKS, _TOKENS, _VECTOR, TERMS, chunks, first_vector, query, vector_chunks
from .session import load, scratch
from .sources import files

# --- whole searches ---

_SEARCHED = f"""WITH {_VECTOR}, vt AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rv FROM v ORDER BY similarity DESC, chunk_id LIMIT 30),
 m AS (SELECT doc_id AS chunk_id, list_filter(list_transform(t, lambda x, i: {{'i': i, 'k': CASE WHEN starts_with(x, 'the') THEN 1 WHEN starts_with(x, 'an') THEN 2 END}}), lambda y: y.k IS NOT NULL) AS w FROM (SELECT doc_id, {_TOKENS} AS t FROM documents JOIN embeddings ON vec_id = doc_id)),
 d AS (SELECT chunk_id, list_sum(list_transform(range(1, len(w)), lambda j: CASE WHEN w[j].k <> w[j + 1].k THEN 0.1::DOUBLE / (w[j + 1].i - w[j].i) ELSE 0 END)) AS density FROM m WHERE len(list_distinct(list_transform(w, lambda y: y.k))) = 2),
 l AS (SELECT *, row_number() OVER (ORDER BY round(density, 9) DESC, chunk_id) AS rl FROM d), lt AS (SELECT *, density / max(density) OVER () AS score FROM l WHERE rl <= 30),
 f AS (SELECT coalesce(vt.chunk_id, lt.chunk_id) AS chunk_id, coalesce(0.7::DOUBLE / (60 + rv), 0) + coalesce(0.3::DOUBLE / (60 + rl), 0) AS fused_score, coalesce(similarity, 0) AS vector_score, coalesce(score, 0) AS lexical_score,
  CASE WHEN rl IS NULL THEN 'vector' WHEN rv IS NULL THEN 'bm25' ELSE 'both' END AS source, rv, rl FROM vt FULL OUTER JOIN lt ON vt.chunk_id = lt.chunk_id),
 r AS (SELECT *, CAST(row_number() OVER (ORDER BY fused_score DESC, rv NULLS LAST, rl NULLS LAST, chunk_id) AS INTEGER) AS fused_rank FROM f),
 x AS (SELECT r.*, substr(text, 1, 30) AS doc_title, length(text) AS n FROM r JOIN documents ON doc_id = chunk_id WHERE fused_rank <= 10)"""


def _by_size():
    """A scorer: the text's length, folded."""
    return lambda pairs: [{"score": len(t) % 97 / 97} for _, t in pairs]


def _searched(spark: SparkSession, sf: str, **more) -> DataFrame:
    """A search over all documents that have a vector; plain words, so that the SQL can say what they match."""
    pool, none = vector_chunks(spark, sf), F.create_map().cast("map<string,string>")
    id_ = F.col("chunk_id").cast("string")
    docs = pool.select(id_.alias("id"), F.col("source").alias("collection_id"), F.substring("text", 1, 30).alias("title"), F.lit(None).cast("string").alias("source_url"), none.alias("metadata"))
    rows = pool.select(F.col("chunk_id").alias("id"), id_.alias("doc_id"), "text", "embedding", none.alias("metadata"))
    return plan.search_rag(rows, docs, TERMS, top=10, min_similarity=0.0, vector=first_vector(spark, sf), **more)


@query(f"{_SEARCHED} SELECT chunk_id, doc_title, round(vector_score, 9) AS vector_score, round(lexical_score, 9) AS lexical_score, round(fused_score, 12) AS similarity, source, CAST(row_number() OVER (ORDER BY fused_score DESC, chunk_id) AS INTEGER) AS rank FROM x")
def search_results(spark, sf):
    """The configured mode is hybrid; the fused score is the similarity that results are ranked by."""
    found = _searched(spark, sf, config=Config(search_mode="hybrid", fts_language="simple"))
    return found.select("chunk_id", "doc_title", F.round("vector_score", 9).alias("vector_score"), F.round("lexical_score", 9).alias("lexical_score"), F.round("similarity", 12).alias("similarity"), "source", "rank")


@query(f"{_SEARCHED}, y AS (SELECT *, row_number() OVER (ORDER BY fused_score DESC, chunk_id) AS pos FROM x), z AS (SELECT *, (n % 97) / 97.0::DOUBLE AS s, row_number() OVER (ORDER BY n % 97 DESC, pos) AS k FROM y WHERE pos <= 8) SELECT chunk_id, round(s, 9) AS similarity, 'bge' AS rerank_provider, CAST(row_number() OVER (ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM z WHERE k <= 5")
def search_reranked(spark, sf):
    """Reranking makes the search hybrid whatever is asked; a remote provider without a key falls to the local one; of ten
    results eight are reranked and five returned."""
    rerank.register("bge", _by_size)
    config = Config(search_mode="vector", fts_language="simple", reranker="cohere", reranker_key=False, max_candidates=8)
    found = _searched(spark, sf, mode="vector", reranking=True, rerank_top=5, config=config)
    return found.select("chunk_id", F.round("similarity", 9).alias("similarity"), "rerank_provider", "rank")


# --- embedding ---


def _counting():
    """Length, letters e and spaces of a text: vectors that SQL can say too."""
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


def _flaky():
    """Fails at every second call."""
    calls, count = [0], _counting()

    def run(texts: list[str]) -> list:
        calls[0] += 1
        if calls[0] % 2:
            raise RuntimeError("busy")
        return count(texts)

    return run


def _no_numbers():
    return lambda texts: [[1.0, float("nan"), 0.0] for _ in texts]


@query(
    f"SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'voyage' ELSE 'ollama' END AS embedding_provider, doc_id % 2 = 1 AS used_fallback, length(text)::DOUBLE AS x, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS y, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS z FROM {_CHUNKS}"
)
def embedded_vectors(spark, sf):
    """Whole vectors: one provider answers; the other's are no numbers, so the local one, which fails at every first try,
    takes over and is tried again."""
    own = {"voyage": _counting, "openai": _no_numbers, embed.LOCAL: _flaky}
    before = {name: embed.REGISTRY[name] for name in own}
    for name, maker in own.items():
        embed.register(name, maker)
    try:
        given = chunks(spark, sf).withColumn("provider", F.when(F.col("doc_id") % 2 == 0, "voyage").otherwise("openai"))
        made = embed.embed(given, ["chunk_id"], delay=0)
    finally:
        for name, maker in before.items():
            embed.register(name, maker)
    return made.select("chunk_id", "embedding_provider", "used_fallback", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])


# --- files ---


@query("SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, 'text/plain' AS content_type FROM documents GROUP BY source")
def files_read(spark, sf):
    """Every document's text in files of its collection, read back as files."""
    path = scratch(spark, "files")
    load(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(path)
    found = files.read_files(spark, path, "*.txt").withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    return found.groupBy("source").agg(F.sum(F.octet_length("content").cast("long")).alias("n_bytes"), F.max("content_type").alias("content_type"))


@query("SELECT source AS collection, count(*) AS n_documents FROM documents WHERE source <> 'src1' GROUP BY source")
def files_deleted(spark, sf):
    """The stored files of a collection go; deleting them again finds none."""
    path, d = scratch(spark, "files"), load(spark, sf, "documents")
    files.store_documents(d.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("doc"), F.lit(".txt").alias("extension"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), path)
    there = [files.delete_file(spark, f"{path}/collection=src1") for _ in range(2)]
    if there[1]:
        raise AssertionError("deleted twice")
    return spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("n_documents"))
