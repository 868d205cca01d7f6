"""Scoring and routing rules as column expressions: trust, recency, freshness, providers, document types, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, providers, hints and prices.
QUALITY = {"official": 1.0, "verified": 0.85, "community": 0.6}
OTHER_QUALITY = 0.5
PROVIDERS = {"ollama": ("nomic-embed-text", 768), "openai": ("text-embedding-3-large", 1536), "voyage": ("voyage-code-2", 1024)}
CODE_LANGUAGES = ("dart", "typescript", "javascript", "c", "cpp", "python", "java", "kotlin")
CODE_PATTERNS = (
    r"(?m)^\s*(import|export)\s+", r"(?m)^\s*(class|interface|enum)\s+\w+", r"(?m)^\s*(async\s+)?function\s+\w+", r"<\w+>\s*\(.*\)", r"\bconst\s+\w+\s*=", r"//", r"#include\s+<",
)
CODE_FILES = r"\.(dart|ts|tsx|js|jsx|py|java|kt|c|cpp|go|rs)$"
#: (provider, model): dollars; per thousand tokens, or for reranking per request. A provider's first model is its default.
PRICES = {
    ("openai", "text-embedding-3-large"): 0.00013, ("openai", "gpt-4"): 0.03, ("voyage", "voyage-code-2"): 0.00012, ("cohere", "rerank-english-v3.0"): 0.001,
    ("cohere", "rerank-v3.5"): 0.001, ("anthropic", "claude-3-haiku"): 0.00025, ("anthropic", "claude-3-haiku-20240307"): 0.00025,
}
WARNING_SHARE = 0.8


def quality_weight(quality: Column) -> Column:
    """Trust in a source; case matters."""
    return F.coalesce(*[F.when(quality == q, w) for q, w in QUALITY.items()], F.lit(OTHER_QUALITY))


def months_between_days(day: Column, as_of: Column) -> Column:
    """Whole months from day to as_of: one less before the day of the month is reached."""
    return (F.year(as_of) - F.year(day)) * 12 + F.month(as_of) - F.month(day) - F.when(F.dayofmonth(as_of) < F.dayofmonth(day), 1).otherwise(0)


def recency_weight(verified: Column, as_of: Column) -> Column:
    """1 under six months (also for days to come), .9 under twelve, else .7; .7 for none or no date."""
    m = months_between_days(verified, as_of)
    return F.when(m < 6, 1.0).when(m < 12, 0.9).otherwise(0.7)


def half_year_before(as_of: Column) -> Column:
    """Six months earlier, days past the month's end running over into the next month."""
    first = F.add_months(F.trunc(as_of, "month"), -6)
    return F.date_add(first, F.dayofmonth(as_of) - 1)


def freshness(day: Column, as_of: Column) -> Column:
    """1 after half a year before as_of; else by calendar months: .85 up to 12, .7 up to 24, .5 beyond; .7 for no date."""
    m = (F.year(as_of) - F.year(day)) * 12 + F.month(as_of) - F.month(day)
    return F.when(day.isNull(), 0.7).when(day > half_year_before(as_of), 1.0).when(m <= 12, 0.85).when(m <= 24, 0.7).otherwise(0.5)


def is_code(text: Column, language: Column) -> Column:
    hint = F.lower(F.coalesce(language, F.lit(""))).isin(*CODE_LANGUAGES)
    seen = F.lit(False)
    for p in CODE_PATTERNS:
        seen = seen | text.rlike(p)
    return F.coalesce((F.length(text) > 0) & (hint | seen), F.lit(False))


def provider(text: Column, context: Column, language: Column, code: str = "voyage", personal: str = "openai", docs: str = "ollama") -> Column:
    """The embedding provider of a text. context: code, personal, docs or null. An unknown override is ignored."""
    pick = lambda given, default: F.lit(given if given in PROVIDERS else default)
    return F.when(context == "code", pick(code, "voyage")).when(context == "personal", pick(personal, "openai")).when(is_code(text, language), pick(code, "voyage")).otherwise(pick(docs, "ollama"))


def dimensions(provider_: Column) -> Column:
    return F.coalesce(*[F.when(provider_ == p, d) for p, (_, d) in PROVIDERS.items()], F.lit(PROVIDERS["ollama"][1]))


def metadata_context(doc_type: Column, framework: Column, language: Column) -> Column:
    return F.when(doc_type.isin("code_sample", "build_plan") | (F.length(framework) > 0), "code").when(doc_type == "personal_writing", "personal").when(F.length(language) > 0, "docs")


def document_type(explicit: Column, file_path: Column, category: Column, url: Column) -> Column:
    code = F.lower(F.coalesce(file_path, F.lit(""))).rlike(CODE_FILES) | F.coalesce(category == "snippet", F.lit(False))
    return F.when(F.length(explicit) > 0, explicit).when(code, "code_sample").when(F.contains(url, F.lit("github.com")), "repo").otherwise("tutorial")


def url_quality(url: Column) -> Column:
    return F.when(url.isNull(), None).when(F.contains(url, F.lit("flutter.dev")) | F.contains(url, F.lit("dart.dev")), "official").when(F.contains(url, F.lit("github.com")), "verified").otherwise("community")


def source_quality(explicit: Column, url: Column, stars: Column, default: Column) -> Column:
    """Explicit, else inferred from the URL and raised to verified by 1000 stars, else the default, else community."""
    seen = url_quality(url)
    inferred = F.when(F.coalesce(stars, F.lit(0)) >= 1000, F.when(seen == "official", seen).otherwise("verified")).otherwise(seen)
    return F.coalesce(explicit, inferred, default, F.lit("community"))


def price(provider_: Column, model: Column, operation: Column, tokens: Column) -> Column:
    """Dollars of a request; 0 for an unknown provider, the provider's first model for an unknown model."""
    first: dict[str, float] = {}
    rate = F.lit(None).cast("double")
    for (p, m), dollars in PRICES.items():
        first.setdefault(p, dollars)
        rate = F.coalesce(rate, F.when((provider_ == p) & (model == m), dollars))
    for p, dollars in first.items():
        rate = F.coalesce(rate, F.when(provider_ == p, dollars))
    return F.coalesce(F.when((provider_ == "cohere") & (operation == "rerank"), rate).otherwise(tokens / 1000 * rate), F.lit(0.0))


def budget_state(spend: Column, budget: float) -> Column:
    return F.when(spend >= budget, "limit_reached").when(spend > WARNING_SHARE * budget, "warning")
