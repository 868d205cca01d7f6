"""Collections, documents and chunks: lookups, listings, and writes as new versions of a table.

Plain Parquet has no UPDATE, DELETE or MERGE: writes are functions from a table to its next version, to be written by
`sources.files.replace`. Everything that reads the clock takes as_of.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as typed
from ..schema import SEED_COLLECTIONS, STATUSES

# --- reads ---


def newest_first(df: DataFrame, collection: str | None = None) -> DataFrame:
    """Rows by created_at, newest first, of all or of one collection."""
    found = df if collection is None else df.filter(F.col("collection_id") == collection)
    return found.orderBy(F.desc("created_at"), "id")


def by_id(df: DataFrame, id_: str) -> DataFrame:
    return df.filter(F.col("id") == id_)


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.filter(F.col("doc_id") == doc_id).orderBy("chunk_index")


def collections_with_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Every collection with the number of its documents, newest first; documents are counted before the join."""
    counts = documents.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("doc_count"))
    return collections.join(counts, "id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long"))).orderBy(F.desc("created_at"), "id")


def chunk_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_count (0 for none) and token_count (null for none) of every document."""
    stats = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("token_count"))
    return documents.join(stats, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))


def list_documents(documents: DataFrame, chunks: DataFrame, collection: str | None = None, status: str = "all", limit: int = 50) -> DataFrame:
    """Documents with chunk statistics, newest first; limit within 1 to 200; any status but "all" filters."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    if status != "all" and status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    found = documents if status == "all" else documents.filter(F.col("status") == status)
    found = found if collection is None else found.filter(F.col("collection_id") == collection)
    top = found.orderBy(F.desc("created_at"), "id").limit(limit)
    return chunk_stats(top, chunks.join(top.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")).orderBy(F.desc("created_at"), "id")


def document_status(documents: DataFrame, chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunk_stats(by_id(documents, doc_id), chunks.filter(F.col("doc_id") == doc_id)).withColumnRenamed("token_count", "total_tokens")


def embedding_hints(documents: DataFrame) -> DataFrame:
    """For each collection embedding_provider, doc_type and language of its newest document: the last processed, of those
    not processed the last created."""
    newest = F.struct(F.coalesce(F.col("processed_at"), F.lit(datetime(1, 1, 1))), F.col("created_at"), F.col("id"))
    key = lambda k: F.max_by(F.try_element_at("metadata", F.lit(k)), newest).alias(k)
    return documents.groupBy("collection_id").agg(key("embedding_provider"), key("doc_type"), key("language"))


def first_chunks(chunks: DataFrame, most: int = 10) -> DataFrame:
    """Each document's first chunks (1 to 25 of them) joined by a blank line."""
    if not 1 <= most <= 25:
        raise ValueError("most must be from 1 to 25")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.filter(F.col("chunk_index") < most).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("n_chunks"))


def recent_turns(turns: DataFrame, most: int = 20) -> DataFrame:
    """Each conversation's last turns, oldest first."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", last).filter(F.col("back") <= most).drop("back")


# --- writes ---


def blank_to_null(c: Column) -> Column:
    """Empty strings and zeros are stored as null."""
    return F.when(c.cast("string").isin("", "0"), None).otherwise(c)


def insert_document(documents: DataFrame, row: dict, as_of: datetime) -> DataFrame:
    values = {"status": "pending", "metadata": {}, "created_at": as_of, "updated_at": as_of} | {k: (v or None) if k in ("file_path", "content_type", "file_size", "source_url") else v for k, v in row.items()}
    made = documents.sparkSession.createDataFrame([tuple(values.get(f.name) for f in documents.schema)], documents.schema)
    return documents.unionByName(made)


def insert_absent(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key df doesn't have, one for each key, after df's."""
    return df.unionByName(new.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def seed_rows(spark, as_of: datetime) -> DataFrame:
    rows = [(i, f"Collection {n}", None, as_of, as_of) for n, i in enumerate(SEED_COLLECTIONS, 1)]
    return spark.createDataFrame(rows, "id string, name string, description string, created_at timestamp, updated_at timestamp")


def set_status(documents: DataFrame, ids: Column, status: str, as_of: Column, error: str | None = None, file_path: str | None = None) -> DataFrame:
    """status, error_message and updated_at where ids holds; processed_at only when complete; file_path only if given."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    new = {"status": F.lit(status), "error_message": F.lit(error), "updated_at": as_of, "file_path": F.coalesce(F.lit(file_path), F.col("file_path"))}
    new["processed_at"] = as_of if status == "complete" else F.col("processed_at")
    kinds = dict(documents.dtypes)
    return documents.withColumns({k: F.when(ids, v.cast(kinds[k])).otherwise(F.col(k)) for k, v in new.items()})


def merge_metadata(documents: DataFrame, ids: Column, more: Column) -> DataFrame:
    """A shallow merge; the right side wins. Needs no map setting: keys of the right side are dropped from the left first.
    Metadata is a map of text, or a variant whose values keep their types (more is then a variant)."""
    if dict(documents.dtypes)["metadata"] == "variant":
        return documents.withColumn("metadata", F.when(ids, typed.merged(F.col("metadata"), more)).otherwise(F.col("metadata")))
    left = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return documents.withColumn("metadata", F.when(ids, F.map_concat(left, more)).otherwise(F.col("metadata")))


def overwrite_metadata(documents: DataFrame, ids: Column, value: Column) -> DataFrame:
    return documents.withColumn("metadata", F.when(ids, value).otherwise(F.col("metadata")))


def restart(documents: DataFrame, ids: Column, as_of: Column) -> DataFrame:
    """Back to pending, where a file path is known."""
    go = ids & F.col("file_path").isNotNull()
    kinds = dict(documents.dtypes)
    new = {"status": F.lit("pending"), "error_message": F.lit(None), "processed_at": F.lit(None), "updated_at": as_of}
    return documents.withColumns({k: F.when(go, v.cast(kinds[k])).otherwise(F.col(k)) for k, v in new.items()})


def upsert(df: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows of new replace those of df with the same key but for the columns of keep; others are added. One row for each
    key comes out; new has one for each key. One join on the key, no window."""
    old = df.select(*keys, F.struct(*[F.col(c) for c in df.columns]).alias("__old"))
    fresh = new.select(*keys, F.struct(*[F.col(c) for c in df.columns]).alias("__new"))
    both = old.join(fresh, keys, "full_outer")
    value = lambda c: F.when(F.col("__new").isNull(), F.col(f"__old.{c}")).when(F.col("__old").isNotNull() & F.lit(c in keep), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}"))
    return both.select(*[value(c).alias(c) for c in df.columns])


def delete_collection(collections: DataFrame, documents: DataFrame, chunks: DataFrame, ids: DataFrame, usage: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the collections of ids (column id) and what hangs on them. A collection that usage names
    can't go."""
    if usage is not None and not usage.select(F.col("collection_id").alias("id")).join(ids, "id", "left_semi").isEmpty():
        raise ValueError("usage rows refer to the collection")
    gone = documents.join(ids.select(F.col("id").alias("collection_id")), "collection_id", "left_semi").select("id")
    return (collections.join(ids.select("id"), "id", "left_anti"), *delete_documents(documents, chunks, gone))


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return documents.join(ids.select("id"), "id", "left_anti").select(*documents.columns), chunks.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*chunks.columns)
