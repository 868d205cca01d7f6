"""Mixing to target weights with soft memberships.

A classifier learned from the labelled table gives each document its posterior over the labels' domains. Document rates
are fitted by distributed projected-gradient least squares so that the expected tokens of each domain, the sum over
documents of rate * tokens * posterior, meet their targets. Rates start at 1 and are kept nonnegative
(and, where documents must not be repeated, at most 1). A document's rate
depends on its posterior and on the steps of the rounds so far alone: each round is one aggregation that brings one
number for each domain to the driver, and rates are never stored or sent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, carried_columns, carried_fields, documents, rows, stored, table, text_bytes, texts_of, with_text

DOMAINS = ("good", "poor", "toxic")
#: Shares of the mixture's tokens.
TARGETS = {"good": 0.97, "poor": 0.02, "toxic": 0.01}
#: The classifier is fitted on about so many labelled documents at most, chosen by a hash of doc_id, with so many words.
SAMPLE, FEATURES, LEAST_DOCUMENTS = 10_000, 1500, 8
#: Measures beside words: of text made of symbols, capitals, repeated words, and short texts.
EXTRA = ("bias", "symbols", "shouts", "upper", "repeats", "bars", "short")
ROUNDS, TOLERANCE, DAMPING, UNIT = 30, 1e-3, 0.1, 1_000_000
SYMBOLS = b"#*$%&|<>"


def domain_of_labels() -> Column:
    """The domain of a row of labels (quality, toxic); null if it has none."""
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.col("quality")
    return F.when(toxic > 0, "toxic").when(quality > 0, "good").when(quality.isNotNull(), "poor")


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """bytes, domain of at most about `sample` documents. Of several labels of a document the first by name counts."""
    known = labels.withColumn("domain", domain_of_labels()).filter(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    share = min(1.0, sample / n) if n else 0.0
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20)) < int(share * (1 << 20))
    return docs.filter(drawn).select("doc_id", text_bytes().alias("bytes")).join(known.filter(drawn), "doc_id").select("bytes", "domain")


def measures(data: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, size = max(1, len(words)), max(1, len(data))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [1.0, min(1, 10 * symbols / size), min(1, 3 * data.count(b"!!") / n), min(1, 3 * upper / size), max(0.0, 1 - distinct / n) ** 2 if n > 30 else 0.0, min(1, 3 * data.count(b"|") / n), 1.0 if n < 10 else 0.0]


class Classifier:
    """Softmax over the presence of words and EXTRA."""

    def __init__(self, words: list[bytes], weights: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.weights = weights  # a row for each feature, words first

    def features(self, data: bytes) -> tuple[np.ndarray, list[float], int]:
        words = data.split()
        distinct = set(words)
        return np.fromiter((self.index[w] for w in distinct if w in self.index), np.int64), measures(data, words, len(distinct)), len(words)

    def posterior(self, data: bytes) -> tuple[np.ndarray, int]:
        """Over DOMAINS, and the number of words."""
        some, extra, n = self.features(data)
        z = self.weights[some].sum(axis=0) + np.array(extra) @ self.weights[len(self.index) :]
        e = np.exp(z - z.max())
        return e / e.sum(), n


def fit_softmax(x: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n_words: int, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights by gradient descent with momentum on the log loss; domains without examples get none of the mass."""
    size = [len(v) for v in x]
    row, col = np.repeat(np.arange(len(x)), size), np.concatenate(x) if x else np.empty(0, np.int64)
    k = len(DOMAINS)
    w, move = np.zeros((n_words + extra.shape[1], k)), 0.0
    truth = np.eye(k)[y]
    w[n_words] = np.where(truth.sum(axis=0) > 0, 0, -30.0)
    absent = truth.sum(axis=0) == 0
    for _ in range(rounds):
        z = np.stack([np.bincount(row, w[col, j], len(x)) for j in range(k)], axis=1) + extra @ w[n_words:]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - truth) / len(x)
        g = np.concatenate([np.stack([np.bincount(col, d[row, j], n_words) for j in range(k)], axis=1), extra.T @ d]) + ridge * w
        g[:, absent] = 0
        move = 0.9 * move - 2.0 * g
        w = w + move
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Classifier:
    """Words are those whose share of documents differs most between a domain and the rest, by a two-proportion z score.
    The driver gets at most `features` words and, for each document of the sample, the numbers of those it has."""
    given = stored(labelled(docs, labels, sample), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in rows(batches):
            for data, domain in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(domain, Counter()).update(set(data.split()))
        for domain, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array([domain] * len(own), pa.string()), pa.array(own.values(), pa.int64())], ["word", "domain", "n"])

    size = {r["domain"]: r["n"] for r in given.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    if not total:
        return Classifier([], np.zeros((len(EXTRA), len(DOMAINS))))
    counts = given.mapInArrow(count, "word binary, domain string, n long").groupBy("word").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(d) for d in DOMAINS])
    every = sum((F.col(d) for d in DOMAINS), F.lit(0))
    scores = []
    for d in DOMAINS:
        inside, outside = size.get(d, 0), total - size.get(d, 0)
        if inside and outside:
            p = every / total
            scores.append(F.abs(F.col(d) / inside - (every - F.col(d)) / outside) / F.sqrt(p * (1 - p) * (1 / inside + 1 / outside) + 1e-12))
    if scores:
        best = counts.filter(every >= LEAST_DOCUMENTS).withColumn("score", F.greatest(*scores, F.lit(0.0))).filter("score > 4").orderBy(F.desc("score"), "word").limit(features)
        words = sorted(bytes(r["word"]) for r in best.select("word").collect())
    else:
        words = []
    reader = Classifier(words, np.zeros((len(words) + len(EXTRA), len(DOMAINS))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            got = [reader.features(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["domain", "words", "extra"])

    got = given.mapInArrow(read, "domain string, words binary, extra array<double>").collect()
    got.sort(key=lambda r: (r["domain"], bytes(r["words"]), r["extra"]))  # the sample's rows, in an order of their own
    x = [np.frombuffer(bytes(r["words"]), "<i4").astype(np.int64) for r in got]
    weights = fit_softmax(x, np.array([r["extra"] for r in got]), np.array([DOMAINS.index(r["domain"]) for r in got]), len(words))
    return Classifier(words, weights)


def memberships(docs: DataFrame, classifier: Classifier, carry: list[str]) -> DataFrame:
    """carry, __n (words of the text) and __p_<domain> (in millionths) of every row; null text: no words."""
    given = with_text(docs, carry)
    names = ["__n", *(f"__p_{d}" for d in DOMAINS)]
    schema = T.StructType([*carried_fields(docs, carry), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            got = [classifier.posterior(x) for x in texts_of(b)]
            p = np.array([g[0] for g in got]).reshape(-1, len(DOMAINS))
            cols = [pa.array([g[1] for g in got], pa.int64()), *(pa.array(np.rint(p[:, i] * UNIT).astype(np.int64)) for i in range(len(DOMAINS)))]
            yield pa.RecordBatch.from_arrays([*carried_columns(b, carry), *cols], schema.names)

    return given.mapInArrow(run, schema)


def rate(history: list[dict[str, float]], most: float | None = None) -> Column:
    """A document's rate after the rounds of history: from 1, less its posterior's product with each round's step, never
    under 0 nor over most."""
    r = F.lit(1.0)
    for step in history:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"__p_{d}") * F.lit(g / UNIT) for d, g in step.items()), F.lit(0.0)))
        r = r if most is None else F.least(F.lit(float(most)), r)
    return r


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, total: float | None = None, most: float | None = None) -> list[dict[str, float]]:
    """The steps of the rounds of projected gradient. members: __n, __p_<domain>.

    The squared residuals of the domains' tokens are weighed by the inverse of the token-weighted second moments of the
    posteriors (and DAMPING of the domains' tokens), gathered once; so domains that the classifier confuses slow the
    descent little, and ones that it can't tell apart move no rates. total: tokens of the mixture; by default as many as
    let the domain with the largest target keep its own. Targets that no rates meet are approached until the totals stand
    still or the rounds are over. most: the highest rate. Sums are of whole numbers, so a repeated run has the same rates.
    """
    p = lambda d: F.col(f"__p_{d}")
    whole = lambda x: F.coalesce(F.sum(F.round(x).cast("decimal(38,0)")), F.lit(0))
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i + 1)]
    got = members.agg(*[whole(F.col("__n") * p(DOMAINS[i]) * p(DOMAINS[j]) / UNIT) for i, j in pairs]).first()
    moments = np.zeros((len(DOMAINS), len(DOMAINS)))
    for (i, j), x in zip(pairs, got, strict=True):
        moments[i, j] = moments[j, i] = float(x) / UNIT
    sums = lambda r: np.array([float(x) / UNIT for x in members.agg(*[whole(F.col("__n") * p(d) * r) for d in DOMAINS]).first()])
    now, history = sums(F.lit(1.0)), []
    inverse = np.linalg.inv(moments + np.diag(DAMPING * now + 1e-9))
    weight = np.array([targets.get(d, 0.0) for d in DOMAINS]) / sum(targets.values())
    want = (now[weight.argmax()] / weight.max() if total is None else total) * weight
    for _ in range(rounds):
        if (np.abs(now - want) <= tolerance * np.maximum(want, 1.0)).all():
            break
        history.append(dict(zip(DOMAINS, (inverse @ (now - want)).tolist(), strict=True)))
        before, now = now, sums(rate(history, most))
        if (np.abs(now - before) <= tolerance / 10 * np.maximum(want, 1.0)).all():
            break
    return history


def mix(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, targets: dict[str, float] = TARGETS, total: float | None = None, most: float | None = None) -> DataFrame:
    """carry (all columns by default), n_tokens (words), p_<domain>, rate and copies of every row of docs (doc_id, text).

    copies is the rate's whole part, and one more for the share of documents that the rest asks for, drawn by a hash of
    doc_id; so the expected number of copies is the rate. most: the highest rate; 1 repeats no document. Null and empty
    texts have no tokens and a posterior like any other; repeated rows share rate and draw; no labels: equal posteriors;
    no rows: no rows. Columns of docs named as ours give way. A null doc_id draws like an id of its own.
    """
    ours = {"n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS)}
    carry = carried(docs.columns if carry is None else carry, ours)
    classifier = learn(docs, labels)
    history = fit_rates(stored(memberships(docs, classifier, []), "memberships"), targets, total=total, most=most)
    found = memberships(docs.withColumn("__id", F.col("doc_id")), classifier, [*carry, "__id"]).withColumn("__rate", rate(history, most))
    draw = F.pmod(F.xxhash64("__id", F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    copies = (F.floor("__rate") + (draw < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long")
    return found.select(*[f"`{c}`" for c in carry], F.col("__n").alias("n_tokens"), *[(F.col(f"__p_{d}") / float(UNIT)).alias(f"p_{d}") for d in DOMAINS], F.col("__rate").alias("rate"), copies.alias("copies"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"])
