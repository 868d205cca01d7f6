"""Retrieval quality and latency measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    """Share of relevant ones among each query's first k results, or fewer if it has fewer. ranked: query_id, rank, relevant.
    Queries without results have no row; count them as 0."""
    return ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.avg(F.col("relevant").cast("double")).alias(f"p_at_{k}"))


def reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """1 over the rank of the first relevant result; 0 if none."""
    return ranked.groupBy("query_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"))


def mean_reciprocal_rank(ranked: DataFrame) -> DataFrame:
    return reciprocal_rank(ranked).agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


def percentage_delta(base: Column, new: Column) -> Column:
    return F.when(base == 0, F.when(new == 0, 0.0).otherwise(100.0)).otherwise((new - base) / base * 100)


def lower_percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The values at place floor((n - 1) * share) of the sorted values, 0 for none. Values are counted and the counts
    summed up in order, so nothing but distinct values is sorted, and in ranges; the ranges are written, so that a range
    made again is the same."""
    ranged = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).repartitionByRange(F.col("v"))
    counts = stored(ranged.withColumn("part", F.spark_partition_id()), "value-counts")
    below = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    parts = counts.groupBy("part").agg(F.sum("n").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = counts.join(F.broadcast(parts.select("part", "before")), "part").select("v", (F.sum("n").over(below) + F.col("before")).alias("upto"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    at = lambda f: F.coalesce(F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * f), F.col("v"))), F.lit(0)).alias(f"p{round(f * 100)}")
    return upto.crossJoin(F.broadcast(total)).agg(*[at(f) for f in shares])


def best_gains(df: DataFrame, most: int = 5) -> DataFrame:
    """Queries by gain (delta), largest first."""
    return df.orderBy(F.desc("delta"), "query_id").limit(most)


def without_gain(df: DataFrame, most: int = 5, least: float = 0.001) -> DataFrame:
    return df.filter(F.col("delta") <= least).orderBy("query_id").limit(most)


def topic_index(docs: DataFrame, parts: int = 1) -> DataFrame:
    """topic, part and the sorted ids of its documents. A topic that many documents have is kept in several parts, by a hash
    of the id, so that no row holds all of them."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    return docs.select("id", part, F.explode("topics").alias("topic")).groupBy("topic", "part").agg(F.array_sort(F.collect_list("id")).alias("ids"))
