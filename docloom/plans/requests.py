"""Requests as they come from outside: unknown keys, wrong types and values out of range are refused."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any


def text(v: Any) -> bool:
    return isinstance(v, str) and bool(v)


def identifier(v: Any) -> bool:
    """A UUID in its usual form."""
    try:
        return isinstance(v, str) and str(uuid.UUID(v)) == v.lower()
    except ValueError:
        return False


def whole(low: int, high: int) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) and low <= v <= high


def share(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1


def one_of(*names: str) -> Callable[[Any], bool]:
    return lambda v: v in names


SEARCH = {
    "query": text, "collection_id": identifier, "top_k": whole(1, 50), "min_similarity": share, "search_mode": one_of("vector", "hybrid"), "rerank": lambda v: isinstance(v, bool), "rerank_top_k": whole(1, 50),
    "rerank_max_candidates": whole(1, 50), "rerank_provider": one_of("cohere", "bge", "none"),
}
COMPARE = {k: SEARCH[k] for k in ("query", "collection_id", "top_k", "rerank_provider")}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def checked(body: dict, fields: dict[str, Callable[[Any], bool]], aliases: bool = False) -> dict:
    """body by the fields' names. With aliases a field may also come in camel case, and that one wins; both are checked.
    Raises ValueError with every fault; query and collection_id are needed."""
    names = {n: n for n in fields} | ({camel(n): n for n in fields} if aliases else {})
    faults = [f"{k}: unknown" for k in body if k not in names]
    faults += [f"{k}: not allowed: {v!r}" for k, v in body.items() if k in names and not fields[names[k]](v)]
    found = {n: body[n] for n in fields if n in body} | {names[k]: v for k, v in body.items() if k in names and k not in fields}
    faults += [f"{n}: required" for n in ("query", "collection_id") if n not in found]
    if faults:
        raise ValueError("; ".join(faults))
    return found


def search_request(body: dict) -> dict:
    return checked(body, SEARCH, aliases=True)


def compare_request(body: dict) -> dict:
    return checked(body, COMPARE)
