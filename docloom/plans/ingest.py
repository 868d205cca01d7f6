"""Ingest: files or texts to chunks with embeddings and metadata; every document ends complete or in error."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import chunk, embed
from .config import Config


def context_of(metadata: Column, file_path: Column, content_type: Column) -> tuple[Column, Column]:
    """Content context (code, personal, docs) and language of documents, from metadata, else from path and type."""
    key = lambda k: F.try_element_at(metadata, F.lit(k))
    path, type_ = F.lower(F.coalesce(file_path, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    by_path = F.when(path.rlike(r"\.dart$"), "dart").when(path.rlike(r"\.tsx?$"), "typescript").when(path.rlike(r"\.jsx?$"), "javascript").when(path.rlike(r"\.ya?ml$"), "yaml").when(path.rlike(r"\.(md|markdown)$"), "markdown")
    code = path.rlike(rules.CODE_FILES) | type_.rlike("application/javascript|text/x|code")
    context = F.coalesce(rules.metadata_context(key("doc_type"), key("framework"), key("language")), F.when(code, "code").otherwise("docs"))
    return context, F.coalesce(key("language"), by_path)


def document_metadata(doc: DataFrame, default_quality: str | None = None, default_tags: tuple[str, ...] = ()) -> DataFrame:
    """documents (metadata, source_url, file_path, …) with source_quality, doc_type and tags settled and put into the
    metadata; tags are the defaults before the explicit ones, joined by commas."""
    key = lambda k: F.try_element_at("metadata", F.lit(k))
    quality = rules.source_quality(key("source_quality"), F.col("source_url"), key("stars").cast("int"), F.lit(default_quality))
    kind = rules.document_type(key("doc_type"), F.col("file_path"), key("content_category"), F.col("source_url"))
    tags = F.array_join(F.concat(F.array(*[F.lit(t) for t in default_tags]).cast("array<string>"), F.filter(F.split(F.coalesce(key("tags"), F.lit("")), ","), lambda t: t != "")), ",")
    new = F.map_from_arrays(F.array(F.lit("source_quality"), F.lit("doc_type"), F.lit("tags")), F.array(quality, kind, tags))
    left = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("source_quality", "doc_type", "tags"))
    return doc.withColumn("metadata", F.map_concat(left, F.map_filter(new, lambda k, v: (k != "tags") | (v != "")))).withColumns({"source_quality": quality})


def ingest(documents: DataFrame, config: Config | None = None, max_size: int = chunk.MAX_SIZE, overlap: int = chunk.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Chunks and outcomes of documents (id, text, error, metadata, file_path, content_type). Chunks: doc_id, chunk_index,
    text, heading, offsets, token_count, embedding, embedding_model and metadata with the provider's traits. Outcomes: id,
    status (complete, or error where extraction failed) and error_message. A document without text is complete without
    chunks."""
    c = config or Config()
    good = documents.filter(F.col("error").isNull())
    context, language = context_of(F.col("metadata"), F.col("file_path"), F.col("content_type"))
    pieces = chunk.chunk_documents(good.select(F.col("id").alias("doc_id"), "text", context.alias("context"), language.alias("language")), ["doc_id", "context", "language"], max_size, overlap)
    routed = pieces.withColumn("provider", rules.provider(F.col("text"), F.col("context"), F.col("language"), c.code_provider, c.writing_provider, c.docs_provider))
    made = embed.embed(routed, ["doc_id", "chunk_index", "text", "heading", "start_offset", "end_offset", "token_count"])
    names = ["heading", "start_offset", "end_offset", "embedding_provider", "embedding_dimensions"]
    traits = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names])), lambda _, v: v.isNotNull())
    outcomes = documents.select("id", F.when(F.col("error").isNull(), "complete").otherwise("error").alias("status"), F.col("error").alias("error_message"))
    return made.withColumn("metadata", traits), outcomes


STEPS = ("extracting", "chunking", "embedding", "complete")


def status_log(outcomes: DataFrame, chunks: DataFrame, as_of: datetime) -> DataFrame:
    """id, step, status, at: the states each document went through; embedding only with chunks, error in place of the rest."""
    counts = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    full = outcomes.join(counts, "id", "left")
    states = F.when(F.col("status") == "error", F.array(F.lit("extracting"), F.lit("error"))).when(F.col("n") > 0, F.array(*map(F.lit, STEPS))).otherwise(F.array(*[F.lit(s) for s in STEPS if s != "embedding"]))
    return full.select("id", F.posexplode(states).alias("step", "status")).withColumn("at", F.lit(as_of).cast("timestamp"))
