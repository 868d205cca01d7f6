"""Settings: what the environment holds in an application is passed as a value here."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Config:
    search_mode: str = "vector"
    vector_weight: float | None = None
    lexical_weight: float | None = None
    fts_language: str | None = None
    trust_scoring: bool = False
    trust_on: str = "document"  # "chunk": weights come from chunk metadata, which ingest leaves without them
    reranker: str = "none"
    reranker_override: str | None = None
    reranker_key: bool = False
    max_candidates: int = 50
    code_provider: str = "voyage"
    writing_provider: str = "openai"
    docs_provider: str = "ollama"
    comparison: bool = False
    contradictions: bool = False
    budget: float | None = 10.0
    cost_alerts: bool = True
    as_of: datetime | None = None

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Config:
        e = os.environ if env is None else env
        number = lambda k: float(e[k]) if e.get(k, "").replace(".", "", 1).lstrip("-").isdigit() else None
        from ..operators.cost import valid_budget

        return Config(
            search_mode=e.get("SEARCH_MODE", "vector").strip().lower(), vector_weight=number("HYBRID_VECTOR_WEIGHT"), lexical_weight=number("HYBRID_BM25_WEIGHT"), fts_language=e.get("FTS_LANGUAGE"),
            trust_scoring=e.get("ENABLE_TRUST_SCORING") == "true", reranker=e.get("RERANKER_PROVIDER", "none"), reranker_override=e.get("RERANKER_PROVIDER_OVERRIDE"),
            max_candidates=int(number("RERANK_MAX_CANDIDATES") or 50), code_provider=e.get("CODE_EMBEDDING_PROVIDER", "voyage"), writing_provider=e.get("WRITING_EMBEDDING_PROVIDER", "openai"),
            docs_provider=e.get("DOC_EMBEDDING_PROVIDER", "ollama"), comparison=e.get("ENABLE_COMPARISON") == "true", contradictions=e.get("ENABLE_CONTRADICTION_DETECTION") == "true",
            budget=valid_budget(e.get("MONTHLY_BUDGET_USD")), cost_alerts=e.get("ENABLE_COST_ALERTS", "true") == "true",
        )
