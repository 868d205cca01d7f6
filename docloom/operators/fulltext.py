"""Full-text search by language: a stored inverted index of stems, and many prefix queries answered from it at once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stems, text
from ..session import scratch
from . import search

MEMO = 1 << 18  # stems that a task remembers
HELD = 256  # texts whose words a task holds at once
PRUNED = 1000  # distinct prefixes up to which a reader names the index's parts; more read all of them


# --- lexemes ---


class Stemmer:
    """Stems of distinct words, the last MEMO of them remembered; None for stop words."""

    def __init__(self, language: str):
        self.language, self.known = stems.LANGUAGES[language], {}

    def __call__(self, word: str) -> str | None:
        if word not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[word] = None if word in self.language.stops else self.language.stem(word) if self.language.stem else word
        return self.known[word]


def lexemes(df: DataFrame, carry: list[str], language: str, column: str = "text") -> DataFrame:
    """carry, term and positions (from 1) of each row's stems. Stop words have no row but count as positions; rows without
    words have none. The words of HELD rows are made distinct before they are stemmed."""
    schema = T.StructType([*[df.schema[c] for c in carry], T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = Stemmer(language)
        for b in (b.slice(at, HELD) for b in batches for at in range(0, b.num_rows, HELD)):
            lists = b.column("__t")
            words = lists.flatten().dictionary_encode()
            made = [stem(w) for w in words.dictionary.to_pylist()]
            names = pa.array(made, pa.string()).dictionary_encode()  # words of one stem are one term
            of = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(starts)
            row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(words)) - np.repeat(starts[:-1], sizes) + 1
            term = of[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
            good = term >= 0
            row, place, term = row[good], place[good], term[good]
            by = np.lexsort((place, term, row))
            row, place, term = row[by], place[by], term[by]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.empty(0, np.int64)
            positions = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(place, pa.int32()))
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in carry], names.dictionary.cast(pa.string()).take(pa.array(term[new])), positions], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in carry], text.terms(F.col(column)).alias("__t")).mapInArrow(run, schema)


# --- the stored index ---


def write_index(chunks: DataFrame, path: str, language: str | None = None, carry: tuple[str, ...] = (), parts: int | None = None) -> None:
    """The inverted index of chunks (chunk_id, text, and columns of carry by which queries may be held to their own, such as
    a collection) below path.

    postings: term, chunk_id, carry, positions, in parts by ranges of (term, chunk_id) and sorted within, so a prefix lies
    in few neighbouring parts and a term that very many chunks have is dealt over several. terms: term and its number of
    chunks. ranges: each part's first and last term. Chunks without words are in none of them.
    """
    spark, name = chunks.sparkSession, stems.resolve_language(language)
    raw = lexemes(chunks, ["chunk_id", *carry], name)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = raw.repartitionByRange(n, "term", "chunk_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "term", "chunk_id")
    placed.write.partitionBy("part").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{path}/ranges")
    postings.groupBy("term").agg(F.count("*").alias("n_chunks")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    spark.createDataFrame([(json.dumps({"language": name, "carry": list(carry)}),)], "value string").coalesce(1).write.text(f"{path}/settings")


def settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/settings").first()["value"])


def postings_of(spark: SparkSession, path: str, prefixes: list[str] | None) -> DataFrame:
    """The postings of terms that start with some prefix; None: all. Only parts whose range of terms meets a prefix are
    listed, and in those row groups are skipped by their statistics."""
    found = spark.read.parquet(f"{path}/postings")
    if prefixes is None:
        return found
    meets = F.lit(False)
    for p in prefixes:
        meets = meets | (F.col("last") >= p) & ((F.col("first") <= p) | F.col("first").startswith(p))
    parts = [r["part"] for r in spark.read.parquet(f"{path}/ranges").filter(meets).select("part").collect()]  # a number for each part
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.col("term").startswith(p)
    return found.filter(F.col("part").isin(parts) & starts)


# --- queries ---


def query_prefixes(queries: DataFrame, language: str, carry: list[str]) -> DataFrame:
    """carry, no, prefix: the stems that chunks must have a term starting with, of queries (query_id, query). Pieces between
    white space lose the operators' characters; a piece of several words stands for each of them; stop words go."""
    raw = F.translate(F.coalesce("query", F.lit("")), "':*&|!()", "")
    found = lexemes(queries.withColumn("__q", raw), ["query_id", *carry], language, "__q").select("query_id", *carry, F.col("term").alias("prefix"))
    return found.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("prefix")))


def matching_terms(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, term of every pair where the term starts with the prefix: terms are joined by their own leading characters, of
    as many lengths as prefixes have."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]
    if not lengths:
        return prefixes.select("prefix", F.col("prefix").alias("term")).limit(0)
    own = F.array_distinct(F.array(*[F.substring("term", 1, n) for n in lengths]))
    return terms.select("term", F.explode(own).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "term")


def index_hits(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and w, the positions of each of a query's prefixes, of the chunks that match all of them. queries:
    query_id, query and the columns of the index's carry. Queries of stop words alone match nothing."""
    made = settings(spark, path)
    carry = made["carry"]
    prefixes = query_prefixes(queries, made["language"], carry).cache()
    distinct = [r["prefix"] for r in prefixes.select("prefix").distinct().limit(PRUNED + 1).collect()]
    known = distinct if len(distinct) <= PRUNED else None
    terms = spark.read.parquet(f"{path}/terms")
    if known is not None:
        starts = F.lit(False)
        for p in known:
            starts = starts | F.col("term").startswith(p)
        terms = terms.filter(starts)
    asked = matching_terms(terms, prefixes).join(prefixes, "prefix")
    need = prefixes.groupBy("query_id").agg(F.count("*").alias("need"))
    found = postings_of(spark, path, known).join(asked, ["term", *carry])
    return gathered(found, need)


def gathered(found: DataFrame, need: DataFrame) -> DataFrame:
    """query_id, chunk_id, w of the chunks for which found (query_id, chunk_id, no, positions) has every number that need
    (query_id, need) counts."""
    by = F.sort_array(F.collect_list(F.struct("no", "positions")))
    grouped = found.groupBy("query_id", "chunk_id").agg(by.alias("p")).join(need, "query_id").filter(F.size(F.array_distinct(F.transform("p", lambda s: s["no"]))) == F.col("need"))
    each = F.transform(F.sequence(F.lit(1), F.col("need").cast("int")), lambda i: F.array_sort(F.flatten(F.transform(F.filter("p", lambda s: s["no"] == i), lambda s: s["positions"]))))
    return grouped.select("query_id", "chunk_id", each.alias("w"))


def scan_search(chunks: DataFrame, query: str, language: str | None = None, top: int = search.LEXICAL_TOP, by: str = "density") -> DataFrame:
    """search_index() of one query over chunks (chunk_id, text) that have no index: one scan that stems. Raises if the query
    has no usable term; one of stop words alone matches nothing."""
    name = stems.resolve_language(language)
    stem = Stemmer(name)
    words = [w for t in text.query_terms(query) for w in re.findall(r"[^\W_]+", t.lower())]
    wanted = sorted({s for s in map(stem, words) if s is not None})
    rows = lexemes(chunks.select("chunk_id", "text"), ["chunk_id"], name)
    nos = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), i) for i, p in enumerate(wanted, 1)])) if wanted else F.array().cast("array<int>")
    found = rows.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", F.explode(nos).alias("no"), "positions")
    need = chunks.sparkSession.createDataFrame([(0, len(wanted))], "query_id long, need long")
    best = best_hits(gathered(found, need), by, search.check_top(top))
    return best.withColumn("score", max_normalised(F.col(by)))


def cover_densities(hits: DataFrame) -> DataFrame:
    """tf (places that match some prefix) and density of index_hits(), which may have further columns, in place of w."""
    counted = hits if "tf" in hits.columns else hits.withColumn("tf", matches())
    carry = [c for c in counted.columns if c != "w"]
    schema = T.StructType([*[counted.schema[c] for c in carry], T.StructField("density", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, HELD) for b in batches for at in range(0, b.num_rows, HELD)):
            density = pa.array([search.cover_density(w) for w in b.column("w").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], density], schema.names)

    return counted.mapInArrow(score, schema)


def matches() -> Column:
    return F.size(F.array_distinct(F.flatten("w"))).cast("long")


def best_hits(hits: DataFrame, by: str, top: int) -> DataFrame:
    """query_id, chunk_id, tf, density, rank of each query's best; ranked by tf, only those reach Python."""
    if by == "tf":
        return cover_densities(search.ranked(hits.withColumn("tf", matches()), by, top)).select("query_id", "chunk_id", "tf", "density", "rank")
    return search.ranked(cover_densities(hits).select("query_id", "chunk_id", "tf", "density"), by, top)


def search_index(spark: SparkSession, path: str, queries: DataFrame, top: int = search.LEXICAL_TOP, by: str = "density") -> DataFrame:
    """query_id, chunk_id, tf, density, score, rank: each query's best chunks by density or tf, score over the query's best
    (0 stays 0)."""
    if by not in ("density", "tf"):
        raise ValueError(f"no such order: {by}")
    best = best_hits(index_hits(spark, path, queries), by, search.check_top(top))
    return best.withColumn("score", max_normalised(F.col(by)))


def max_normalised(raw: Column) -> Column:
    largest = F.max(raw).over(Window.partitionBy("query_id"))
    return raw / F.when(largest == 0, 1).otherwise(largest)


def stem_search(chunks: DataFrame, queries: DataFrame, language: str | None = None, top: int = search.LEXICAL_TOP, by: str = "density", carry: tuple[str, ...] = ()) -> DataFrame:
    """search_index() without a stored index: one is written to the shared scratch folder."""
    path = scratch(chunks.sparkSession, "index")
    write_index(chunks, path, language, carry)
    return search_index(chunks.sparkSession, path, queries, top, by)


def hybrid_batch(
    spark: SparkSession, path: str, chunks: DataFrame, queries: DataFrame, top: int = search.HYBRID_TOP, min_similarity: float = search.MIN_SIMILARITY, weights: tuple[float, float] = search.WEIGHTS, by: str = "density"
) -> DataFrame:
    """fuse() of both legs for every row of queries (query_id, query, embedding, and the index's carry) over chunks
    (chunk_id, embedding, carry): each leg's best three times `top` of each query, the lexical leg from the index below
    path. A query sees only chunks that agree with it in the carried columns. A query without usable terms has its vector
    leg alone."""
    carry = settings(spark, path)["carry"]
    wide = search.EXPANSION * search.check_top(top)
    v = search.vector_search_batch(chunks, queries, wide, min_similarity, within=carry)
    return search.fuse(v, search_index(spark, path, queries, wide, by), top, weights)
