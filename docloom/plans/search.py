"""Search from query to answer, and the comparison of approaches among its results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stems, text, vectors
from ..operators import approaches as groups
from ..operators import embed, fulltext, rerank, search
from ..session import stored
from .config import Config

MODES = ("vector", "hybrid")


def resolve_mode(asked: str | None, config: Config, reranking: bool) -> str:
    if reranking:
        return "hybrid"
    mode = asked or config.search_mode
    return mode if mode in MODES else "vector"


def embed_query(query: str, provider: str) -> list[float]:
    """The query's vector from a registered provider, on the driver."""
    return embed.checked(embed.with_retries(embed.REGISTRY[provider](), [query], delay=0)[0])


def lexical_leg(pool: DataFrame, query: str, collection: str | None, top: int, language: str, index: str | None) -> DataFrame:
    """Best chunks by cover density, from a scan of pool or from an index. An index of several collections that doesn't carry
    them can't answer for one of them."""
    if index is None:
        return fulltext.scan_search(pool, query, language, top)
    spark = pool.sparkSession
    text.query_terms(query)
    asked = spark.createDataFrame([(0, query, collection)], "query_id long, query string, collection_id string")
    carry = fulltext.settings(spark, index)["carry"]
    if collection is not None and carry != ["collection_id"] or collection is None and carry:
        raise ValueError("the index does not fit the search's collection")
    return fulltext.search_index(spark, index, asked, top)


def search_rag(
    chunks: DataFrame, documents: DataFrame, query: str, collection: str | None = None, top: int | None = None, min_similarity: float = search.MIN_SIMILARITY, mode: str | None = None, reranking: bool = False,
    rerank_top: int | None = None, vector: list[float] | None = None, provider: str = "ollama", config: Config | None = None,
    language: str | None = None, index: str | None = None,
) -> DataFrame:
    """The best chunks for a query. chunks: id, doc_id, text, embedding, metadata; documents: id, collection_id, title,
    source_url, metadata. The lexical leg stems by language (asked, else configured, else English), or reads a stored index
    of the chunks that may carry collection_id. Comes with the scores of every step, rank, and the document's title and URL. The search itself
    sees ids, vectors and tokens; texts and documents are joined to the few results."""
    query, config = query.strip(), config or Config()
    if not query:
        raise ValueError("query must not be empty")
    if not 0 <= min_similarity <= 1:
        raise ValueError("min_similarity must be from 0 to 1")
    if top is not None and not 1 <= top <= 50:
        raise ValueError("top must be from 1 to 50")
    mode = resolve_mode(mode, config, reranking)
    mine = chunks if collection is None else chunks.join(documents.filter(F.col("collection_id") == collection).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    pool = mine.select(F.col("id").alias("chunk_id"), "text", "embedding")
    vector = embed_query(query, provider) if vector is None else vector
    out = top if top is not None else (search.VECTOR_TOP if mode == "vector" else search.HYBRID_TOP)
    if mode == "vector":
        found = search.vector_search(pool.select("chunk_id", "embedding"), vector, out, min_similarity)
        found = found.select("chunk_id", F.col("similarity").alias("vector_score"), F.lit(0.0).alias("lexical_score"), F.col("similarity").alias("fused_score"), F.lit("vector").alias("source"))
    else:
        cap, fetched, kept = rerank.window_sizes(top, config.max_candidates, rerank_top) if reranking else (0, out, out)
        weights = search.resolve_weights(config.vector_weight, config.lexical_weight)
        leg = lambda wide: lexical_leg(pool, query, collection, wide, stems.resolve_language(language, config.fts_language), index)
        found = search.hybrid(pool, query, vector, fetched, min_similarity, weights, leg).drop("query_id", "fused_rank")
    docs = documents.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), "source_url", F.col("metadata").alias("doc_metadata"))
    rows = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "text", "metadata")
    full = rows.join(F.broadcast(found), "chunk_id").join(docs, "doc_id", "left").withColumn("similarity", F.col("fused_score"))  # found: up to 50 rows
    if reranking:
        name = rerank.choose_provider(None, config.reranker_override, config.reranker, config.reranker_key)
        given = full.withColumns({"query_id": F.lit(0).cast("long"), "query": F.lit(query)})
        placed = search.ranked(given.withColumn("__s", F.col("fused_score")), "__s", fetched).drop("__s").withColumnRenamed("rank", "pos")
        full = rerank.rerank(placed, name, kept, cap).withColumn("fused_score", F.col("rerank_score")).drop("query_id", "query", "pos", "rerank_rank")
    if config.trust_scoring:
        source = F.col("metadata" if config.trust_on == "chunk" else "doc_metadata")
        value = lambda k: F.try_element_at(source, F.lit(k))
        as_of = F.lit(config.as_of or datetime.now(UTC)).cast("timestamp")
        full = search.trusted(full, value("source_quality"), F.try_to_timestamp(value("last_verified")), as_of)
    scored = search.cited(full).withColumn("query_id", F.lit(0).cast("long"))
    return search.ranked(scored, "similarity", 50).drop("query_id").orderBy("rank")


def snippet_vectors(results: DataFrame, provider: str = "ollama") -> DataFrame:
    """results (text) with embedding, of the first 600 characters of each text. Where neither the provider nor the local one
    answers, all get vectors of their characters, so that they can still be told apart."""
    given = results.drop("embedding").withColumns({"__snippet": F.substring("text", 1, groups.EMBEDDED), "__provider": F.lit(provider)})
    carry = [c for c in given.columns if c != "__provider"]
    try:
        made = embed.embed(given, carry, "__snippet", "__provider")
        made.write.format("noop").mode("overwrite").save()  # a search's results: a few rows
        return made.select(*[c for c in carry if c != "__snippet"], F.col("embedding").cast("array<double>").alias("embedding"))
    except Exception:
        return given.withColumn("embedding", vectors.character_vector(F.col("__snippet"))).drop("__snippet", "__provider")


def compare(results: DataFrame, query: str, as_of: datetime, config: Config, make_judge: Callable | None = None, most: int = 15) -> dict[str, DataFrame]:
    """approaches, conflicts and recommended of a query's results (query_id, pos, text, title, url, quality, verified,
    published, topic, method, embedding)."""
    if not config.comparison:
        raise PermissionError("comparison is switched off")
    used = results.filter(F.col("pos") <= most).withColumn("query", F.lit(query))
    found = stored(groups.approaches(groups.clustered(used), F.lit(as_of).cast("timestamp")), "approaches")
    none = results.sparkSession.createDataFrame([], "query_id long, pair_rank int, topic string, a_title string, a_url string, b_title string, b_url string, severity string, difference string, recommendation string, confidence double")
    conflicts = stored(groups.judge(groups.conflict_pairs(found), found, make_judge), "conflicts") if config.contradictions and make_judge is not None else none  # a judge is asked once
    return {"approaches": found, "conflicts": conflicts, "recommended": groups.recommended(found, conflicts)}
