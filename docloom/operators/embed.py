"""Embedding with pluggable providers, retries and fallback."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import PROVIDERS

#: Makes, in a worker, a function from texts to vectors.
Embedder = Callable[[], Callable[[list[str]], list]]
REGISTRY: dict[str, Embedder] = {}
BATCH, RETRIES, DELAY, LOCAL = 10, 3, 0.25, "ollama"
HELD = 500  # rows whose vectors a task holds at once
MEMO = 1 << 17  # words whose places an embedder remembers


def register(provider: str, embedder: Embedder) -> None:
    REGISTRY[provider] = embedder


def hashing_embedder(dimension: int) -> Embedder:
    """A deterministic stand-in for a model: words are added up as signed hashed positions, made of length one."""

    def make():
        @lru_cache(MEMO)
        def place(word: str) -> int:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            return 2 * (h % dimension) + (h >> 63)

        def embed(texts: list[str]) -> list:
            words = [t.lower().split() for t in texts]
            row = np.repeat(np.arange(len(texts)) * (2 * dimension), [len(w) for w in words])
            at = np.fromiter(map(place, chain.from_iterable(words)), np.int64, len(row))
            n = np.bincount(row + at, minlength=len(texts) * 2 * dimension).reshape(len(texts), dimension, 2)
            v = (n[:, :, 1] - n[:, :, 0]).astype(float)
            size = np.sqrt((v * v).sum(axis=1))
            v[size == 0] = 1 / np.sqrt(dimension)
            size[size == 0] = 1
            return list(v / size[:, None])

        return embed

    return make


for _name, (_, _dimension) in PROVIDERS.items():
    register(_name, hashing_embedder(_dimension))


def valid(vector) -> np.ndarray:
    v = np.asarray(vector, float)
    if v.ndim != 1 or not len(v) or not np.isfinite(v).all():
        raise ValueError("an embedding needs finite numbers")
    return v


def checked(vector) -> list[float]:
    return valid(vector).tolist()


def with_retries(run: Callable[[list[str]], list], texts: list[str], retries: int = RETRIES, delay: float = DELAY) -> list:
    """The first try and up to `retries` more, each after a delay that grows by the number of the try."""
    for attempt in range(retries + 1):
        try:
            return run(texts)
        except Exception:
            if attempt == retries:
                raise
            time.sleep(delay * (attempt + 1))
    raise AssertionError


def embed(df: DataFrame, carry: list[str], text: str = "text", provider: str = "provider", batch: int = BATCH, delay: float = DELAY) -> DataFrame:
    """carry, embedding, embedding_provider, embedding_model, embedding_dimensions, used_fallback of every row. Rows go to
    the provider their column names, in runs of `batch` at most, and HELD rows' vectors go back at a time; where it fails the local one takes over (the local one is tried
    again first). If that fails too, so does the task."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    given = df.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text"), F.coalesce(F.col(provider), F.lit(LOCAL)).alias("__provider"))
    extra = [("embedding", T.ArrayType(T.FloatType())), ("embedding_provider", T.StringType()), ("embedding_model", T.StringType()), ("embedding_dimensions", T.IntegerType()), ("used_fallback", T.BooleanType())]
    schema, registry, models = T.StructType([*given.schema.fields[:-2], *(T.StructField(n, t) for n, t in extra)]), dict(REGISTRY), {p: m for p, (m, _) in PROVIDERS.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Callable] = {}

        def call(name: str, texts: list[str]) -> list:
            if name not in ready:
                ready[name] = registry[name]()
            vectors = with_retries(ready[name], texts, RETRIES if name == LOCAL else 0, delay)
            if len(vectors) != len(texts):
                raise ValueError("as many embeddings as texts are needed")
            return [valid(v).astype(np.float32) for v in vectors]

        def parts() -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), HELD):
                    yield b.iloc[at : at + HELD].reset_index(drop=True)

        for b in parts():
            out: list = [None] * len(b)
            for name, part in b.groupby("__provider"):
                for at in range(0, len(part), batch):
                    some, used = part.iloc[at : at + batch], str(name)
                    try:
                        vectors = call(used, some["__text"].tolist())
                    except Exception:
                        if used == LOCAL:
                            raise
                        used = LOCAL
                        vectors = call(used, some["__text"].tolist())
                    for i, v in zip(some.index, vectors, strict=True):
                        out[i] = (v, used, models.get(used, used), len(v), used != name)
            yield pd.concat([b[carry], pd.DataFrame(out, columns=[n for n, _ in extra])], axis=1)

    return given.mapInPandas(run, schema)


def paired(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_index, …) with embedding from vectors (doc_id, chunk_index, embedding). A document without any
    vector keeps its chunks without; one that has some must have one for each chunk and none besides, else the write that
    reads this fails."""
    v = vectors.select("doc_id", "chunk_index", F.col("embedding").alias("__v"), F.lit(True).alias("__has"))
    some = vectors.select("doc_id").distinct().withColumn("__some", F.lit(True))
    both = chunks.drop("embedding").withColumn("__chunk", F.lit(True)).join(v, ["doc_id", "chunk_index"], "full_outer").join(some, "doc_id", "left")
    wrong = F.col("__chunk").isNull() | F.col("__some").isNotNull() & F.col("__has").isNull()
    checked_ = F.when(wrong, F.raise_error(F.concat(F.lit("chunks and embeddings of "), F.col("doc_id").cast("string"), F.lit(" differ in number")))).otherwise(F.col("__v"))
    return both.withColumn("embedding", checked_.cast(vectors.schema["embedding"].dataType)).drop("__v", "__has", "__some", "__chunk")
