"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, carried, carried_columns, carried_fields, documents, rows, with_text

#: Grams of 1 to LONGEST characters of each word between two marks; a profile has the TOP most frequent.
LONGEST, TOP = 3, 300
#: At most about so many documents of a language, chosen by a hash of doc_id, make its profile.
SAMPLE = 5000
UNKNOWN = "und"
WORDS_HELD = 100_000  # distinct words that a task of learn_profiles() counts before it tells their grams
WORDS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]


#: A gram as a number: 21 bits for each of its code points. Words whose grams are held at once; what orders equal counts.
BITS, PIECE, TIES = np.uint64(21), 20_000, np.uint64(0x9E3779B97F4A7C15)


def key_of(gram: str) -> int:
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


def gram_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the grams() of all words, and how often each is found: runs of up to LONGEST characters of the words
    with a mark before, between and after them, but not those with a mark alone or in the middle."""
    parts = []
    for at in range(0, len(words), PIECE):
        text = "_" + "_".join(words[at : at + PIECE]) + "_"
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        mark = c == ord("_")
        two = (c[:-1] << BITS) | c[1:]
        three = (two[:-1] << BITS) | c[2:]
        parts.append(np.unique(np.concatenate([c[~mark], two, three[~mark[1:-1]]]), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def top_grams(words: list[str], most: int = TOP) -> np.ndarray:
    """Keys of the most frequent grams, most frequent first, ties in an order that depends on the gram alone."""
    keys, counts = gram_counts(words)
    if len(keys) > most:
        enough = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[enough], counts[enough]
    return keys[np.lexsort((keys * TIES, -counts))][:most]


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters; none if the text has no letter."""
    words = WORDS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def learn_profiles(labelled: DataFrame, sample: int = SAMPLE, top: int = TOP) -> dict[str, list[str]]:
    """Language -> its most frequent grams in order. labelled: doc_id, text, lang; rows without lang or text teach
    nothing. What comes to the driver is one count and `top` grams for each language."""
    bounded(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang")) * (1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}  # by language

        def told() -> Iterator[pa.RecordBatch]:
            for lang, times in words.items():
                own: Counter = Counter()
                for w, n in times.items():
                    for g in grams(w):
                        own[g] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["lang", "gram", "n"])
            words.clear()

        for b in rows(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > WORDS_HELD:
                yield from told()
        yield from told()

    counts = known.filter(drawn).select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= top)
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, profiles: dict[str, list[str]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.keys = np.array(sorted({key_of(g) for p in profiles.values() for g in p}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)  # the last column: in no profile
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array([key_of(g) for g in profiles[lang]], np.uint64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 - distance / the largest distance possible."""
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        own = top_grams(words, self.top)
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        theirs = self.ranks[:, at]
        apart = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.top * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[str]], carry: list[str]) -> DataFrame:
    """carry, lang_pred, score of every row's whole text. Null text or one without a letter: und, 0. Nothing learned: und,
    0. Repeated rows come out repeated; very long texts are read whole; no rows: no rows; columns of docs named as ours
    give way."""
    carry = carried(carry, ("lang_pred", "score"))
    given = with_text(docs, carry)
    schema = T.StructType([*carried_fields(docs, carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles)
        for b in rows(batches):
            got = [known.predict(x) for x in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*carried_columns(b, carry), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], schema.names)

    return given.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs.filter(fold() != 2))
    found = identify(docs, profiles, ["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
