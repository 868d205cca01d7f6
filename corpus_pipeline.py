"""A training corpus from documents: quality rules, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, quality, substrings, wide_simhash
from docloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and very short texts fail them; repeated rows are judged each;
    no rows: no rows."""
    return quality.quality_rules(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash of 5-word shingles, then Jaccard similarity 0.8 or more) one row: the first by doc_id, rows
    without one last, so repeated and null ids count as rows of their own. Null and blank texts are one group; no rows: no
    rows."""
    return wide_simhash.one_of_each(docs.select(*COLUMNS), size=5, percent=80).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; documents that lose every word go. Null texts
    stay null; rows without doc_id neither remove nor lose words, rows of one doc_id not each other's; no rows: no rows."""
    found = substrings.dedup_substrings(docs, ["doc_id", "lang", "source", "n_chars"], give=("n_words", "n_removed", "kept_text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.filter("n_removed = 0 OR n_removed < n_words").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their mixing rates; none is repeated, after copies have gone. Rows of one doc_id share the draw,
    also those without one; null texts have a rate like any other; no rows: no rows."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), COLUMNS, most=1).filter("copies > 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with digests of ids and decoded bytes, of every row; null text: no tokens; no rows: no rows."""
    import public_tokenizers as P

    return bpe.encode(docs, P.path(bpe.RANKS), P.PATTERN, ["doc_id", "lang", "source"], digests=True)


STAGES = [("quality rules", drop_poor), ("near-duplicates", drop_near_copies), ("repeated passages", drop_repeats), ("mixing", mix_domains), ("encoding", encode)]

#: The automata, the classifier and the tokenizer are no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
