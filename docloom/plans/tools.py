"""The named tools of the application over a folder of tables: what agents and services call."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import catalog, cost, search
from ..sources.commits import Change, Snapshot, Store
from . import requests
from . import search as search_plan
from .config import Config
from .ingest import document_metadata, ingest


class Library:
    """Collections, documents, chunks and usage as tables below a root folder. Every call reads one state of all tables and
    makes at most one commit, so what hangs together changes together."""

    TABLES = {"collections": schema.COLLECTIONS, "documents": schema.DOCUMENTS, "chunks": schema.CHUNKS, "usage": schema.API_USAGE, "alerts": schema.BUDGET_ALERTS}

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.store = Store(spark, self.root, self.TABLES, {"chunks": "doc_id"})

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame:
        return self.store.read(name, at)

    def load(self, **tables: DataFrame) -> None:
        """Rows for several tables in one commit."""
        self.store.append(**tables)

    def _now(self) -> datetime:
        return self.config.as_of or datetime.now(UTC).replace(tzinfo=None)

    # collections

    def create_collection(self, name: str, description: str | None = None) -> str:
        if not name.strip():
            raise ValueError("a collection needs a name")
        now, id_ = self._now(), str(uuid.uuid4())
        self.store.append(collections=self.spark.createDataFrame([(id_, name, description or None, now, now)], schema.COLLECTIONS))
        return id_

    def list_collections(self) -> DataFrame:
        at = self.store.snapshot()
        return catalog.collections_with_counts(self.table("collections", at), self.table("documents", at))

    def delete_collection(self, id_: str) -> None:
        """The collection, its documents and their chunks go in one commit. One that usage rows name can't go."""
        ids = self.spark.createDataFrame([(id_,)], "id string")

        def make(at: Snapshot) -> dict[str, Change]:
            if not self.table("usage", at).filter(F.col("collection_id") == id_).isEmpty():
                raise ValueError("usage rows refer to the collection")
            gone = self.table("documents", at).filter(F.col("collection_id") == id_).select("id")
            return {"collections": self.store.without("collections", at, ids, "id"), "documents": self.store.without("documents", at, gone, "id"), "chunks": self.store.without("chunks", at, gone.withColumnRenamed("id", "doc_id"), "doc_id")}

        self.store.transact(make)

    # documents

    def add_document(self, collection: str, title: str, text: str, **more) -> str:
        """Stores, chunks and embeds one text."""
        doc_id = str(uuid.uuid4())
        row = {"id": doc_id, "collection_id": collection, "title": title, **more}
        full = catalog.insert_document(self.spark.createDataFrame([], schema.DOCUMENTS), row, self._now())
        full = document_metadata(full)
        made, outcomes = ingest(full.withColumns({"text": F.lit(text), "error": F.lit(None).cast("string")}), self.config)
        chunks = made.select(F.xxhash64("doc_id", "chunk_index").alias("id"), "doc_id", "chunk_index", "text", "token_count", "embedding", "embedding_model", "metadata", F.lit(self._now()).cast("timestamp").alias("created_at"))
        done = full.join(outcomes.select("id", F.col("status").alias("__s")), "id").withColumns({"status": F.col("__s"), "processed_at": F.lit(self._now()).cast("timestamp")}).drop("__s")
        self.store.append(chunks=chunks, documents=done.select(*schema.DOCUMENTS.names))
        return doc_id

    def fetch_web_content(self, pages: DataFrame, url: str, collection: str) -> str:
        """Adds a stored page (url, html) as Markdown."""
        from ..functions import urls
        from ..sources import web

        if not self.spark.range(1).select(urls.is_public(F.lit(url))).first()[0]:
            raise ValueError("not a public URL")
        row = pages.filter(F.col("url") == url).select("html").first()
        if row is None:
            raise LookupError(url)
        title = self.spark.range(1).select(urls.title(F.lit(url))).first()[0]
        return self.add_document(collection, title, web.to_markdown(row["html"]), source_url=url, content_type="text/markdown")

    def list_documents(self, collection: str | None = None, status: str = "all", limit: int = 50) -> DataFrame:
        at = self.store.snapshot()
        return catalog.list_documents(self.table("documents", at), self.table("chunks", at), collection, status, limit)

    def get_document_status(self, doc_id: str) -> DataFrame:
        at = self.store.snapshot()
        return catalog.document_status(self.table("documents", at), self.table("chunks", at), doc_id)

    def delete_document(self, doc_id: str) -> None:
        ids = self.spark.createDataFrame([(doc_id,)], "id string")

        def make(at: Snapshot) -> dict[str, Change]:
            if catalog.by_id(self.table("documents", at), doc_id).isEmpty():
                raise LookupError(f"DOCUMENT_NOT_FOUND: {doc_id}")
            return {"documents": self.store.without("documents", at, ids, "id"), "chunks": self.store.without("chunks", at, ids.withColumnRenamed("id", "doc_id"), "doc_id")}

        self.store.transact(make)

    def restart_ingest(self, doc_id: str) -> None:
        mine, now = F.col("id") == doc_id, F.lit(self._now()).cast("timestamp")
        self.store.transact(lambda at: {"documents": self.store.updated("documents", at, mine, lambda rows: catalog.restart(rows, mine, now))})

    def summarize_document(self, doc_id: str, most: int = 10) -> str:
        """The document's first chunks: what a summary is written from."""
        row = catalog.first_chunks(self.table("chunks").filter(F.col("doc_id") == doc_id), most).first()
        return row["text"] if row else ""

    def _searched(self) -> tuple[DataFrame, DataFrame]:
        at = self.store.snapshot()
        return self.table("chunks", at), self.table("documents", at)

    def search_rag(self, query: str, collection: str | None = None, **more) -> DataFrame:
        return search_plan.search_rag(*self._searched(), query, collection, config=self.config, **more)

    def search(self, body: dict) -> DataFrame:
        """A search request as it comes from outside."""
        r = requests.search_request(body)
        config = replace(self.config, max_candidates=r.get("rerank_max_candidates", self.config.max_candidates), reranker_override=r.get("rerank_provider", self.config.reranker_override))
        return search_plan.search_rag(
            *self._searched(), r["query"], r["collection_id"], r.get("top_k"), r.get("min_similarity", search.MIN_SIMILARITY), r.get("search_mode"), r.get("rerank", False), r.get("rerank_top_k"), config=config
        )

    def compare(self, body: dict, make_judge: Callable | None = None) -> dict[str, DataFrame]:
        """Approaches, conflicts and a recommendation among the reranked results of a request."""
        r = requests.compare_request(body)
        config = replace(self.config, reranker_override=r.get("rerank_provider", self.config.reranker_override))
        top = r.get("top_k")
        found = search_plan.search_rag(*self._searched(), r["query"], r["collection_id"], top, mode="hybrid", reranking=True, rerank_top=top, config=config)
        value = lambda k: F.try_element_at("doc_metadata", F.lit(k))
        day = lambda k: F.try_to_timestamp(value(k)).cast("date").alias(k.removeprefix("last_").removesuffix("_date"))
        given = found.select(
            F.lit(0).cast("long").alias("query_id"), F.col("rank").alias("pos"), "text", F.col("doc_title").alias("title"), F.col("source_url").alias("url"), value("source_quality").alias("quality"), day("last_verified"), day("published_date"),
            value("topic").alias("topic"), F.coalesce(value("approach"), value("method")).alias("method"),
        )
        return search_plan.compare(search_plan.snippet_vectors(given, config.docs_provider), r["query"], self._now(), config, make_judge, *([] if top is None else [top]))

    # cost

    def track(self, provider: str, operation: str, tokens: int, model: str | None = None, collection: str | None = None) -> None:
        now = self._now()
        row = self.spark.createDataFrame([(provider, operation, tokens, model, collection, None, now)], "provider string, operation string, tokens_used long, model string, collection_id string, user_id string, created_at timestamp")
        made = cost.tracked(row).withColumn("metadata", F.create_map().cast("map<string,string>")).select(*schema.API_USAGE.names)

        def make(at: Snapshot) -> dict[str, Change]:
            changes = {"usage": Change(made)}
            if self.config.cost_alerts and self.config.budget is not None:
                used = self.table("usage", at).unionByName(made)
                spent = cost.summary(cost.spend_since_month(used, F.lit(now).cast("timestamp")), self.config.budget).filter("state is not null")
                alert = spent.select(
                    F.col("state").alias("alert_type"), F.lit(self.config.budget).cast("decimal(10,2)").alias("threshold_usd"), F.col("current_spend").cast("decimal(10,4)").alias("current_spend_usd"), F.lit("monthly").alias("period"),
                    F.lit(now).cast("timestamp").alias("triggered_at"), F.lit(False).alias("acknowledged"),
                )
                new = cost.new_alerts(alert, self.table("alerts", at))
                changes |= {} if new.isEmpty() else {"alerts": Change(new)}
            return changes

        self.store.transact(make)

    def cost_summary(self) -> DataFrame:
        return cost.summary(cost.spend_since_month(self.table("usage"), F.lit(self._now()).cast("timestamp")), self.config.budget or cost.BUDGET)

    def cost_breakdown(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        first, last = cost.default_range(self._now())
        return cost.breakdown(self.table("usage"), F.lit(start or first).cast("timestamp"), F.lit(end or last).cast("timestamp"))

    def recent_alerts(self, limit: int = 10) -> DataFrame:
        return cost.recent_alerts(self.table("alerts"), limit)
