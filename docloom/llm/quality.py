"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure exceeds a cutoff. Cutoffs are chosen for each stratum (language) on labelled
holdout documents by fixed-sequence testing: PATH names, before any label is seen, the cutoffs to be tried, one rule after
the other from loose to strict, each step beside all steps before it. A step is certified if an exact binomial test
refutes, at level delta divided by the number of strata (Bonferroni), that the rules so far together reject alpha or more
of the stratum's good documents; the first step that is not certified ends the stratum's walk. So with probability
1 - delta no stratum loses more than alpha of its good documents to the rules. With no false rejection, four strata and
alpha = delta = 0.05, 86 good documents certify a step.

Among the certified cutoffs of a rule the loosest is taken that rejects nearly as much (`NEAR`) of the bad labelled
documents as the strictest; a rule that rejects no more bad than good labelled documents is off. Both choices only reject
less than what was certified. Trials are distinct texts: copies of a labelled document count once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, carried_columns, carried_fields, covered, documents, rows, stored, table, text_bytes, texts_of, window_hashes, with_text, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
NEAR = 0.99
#: Measures between 0 and 1 (more is worse): the share of one count in another.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "shouts": ("n_shouts", "n_words"),
}


#: Steps (rule, cutoff), fixed before any label is seen: marks that prose hardly has first, capitals last.
PATH = tuple(
    (rule, cut) for rule, cuts in {
        "symbols": (0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03), "shouts": (0.5, 0.2, 0.1, 0.05, 0.03), "dup_lines": (0.8, 0.5, 0.3, 0.2), "repeats": (0.19, 0.16, 0.13, 0.1), "upper": (0.8, 0.5, 0.3, 0.2),
    }.items() for cut in cuts
)


def rules() -> dict[str, Column]:
    """RULES of a row that has MEASURES."""
    return {r: F.col(a) / F.greatest(F.col(b), F.lit(1)) for r, (a, b) in RULES.items()}


def repeated_words(data: bytes, words: list[bytes], k: int = REPEAT_WINDOW) -> int:
    """Words in windows of k words that are found twice or more in the text, the first included. Hashes only find
    candidates; equal windows are confirmed word by word."""
    h = window_hashes(word_hashes(data), k)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(len(h), bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    at = np.flatnonzero(twin).tolist()
    count = Counter(tuple(words[i : i + k]) for i in at)
    starts = np.array([i for i in at if count[tuple(words[i : i + k])] > 1], np.int64)
    return int(covered(starts, k, len(words)).sum()) if len(starts) else 0


def text_measures(data: bytes) -> tuple[int, ...]:
    """MEASURES of one text; words are runs of bytes other than ASCII white space."""
    words = data.split()
    solid = data.translate(None, b" \t\n\v\f\r")
    text = solid.decode("utf-8", "replace")
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    upper = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text.isascii() else sum(map(str.isupper, text)) if not text.islower() else 0
    return (
        len(words), len(text), len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(data, words), len(lines), upper, data.count(b"!!"),
    )


def measured(docs: DataFrame, carry: list[str], *more: Column) -> DataFrame:
    """carry, the columns of more and MEASURES (as __<measure>) of every row. Null text: no words."""
    given = with_text(docs, carry, *more)
    extra = [f.name for f in given.schema.fields[sum(c != "text" for c in carry) : -1]]
    names = [f"__{m}" for m in MEASURES]
    schema = T.StructType([*carried_fields(docs, carry), *(given.schema[n] for n in extra), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            got = [text_measures(x) for x in texts_of(b)]
            cols = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([*carried_columns(b, carry), *carried_columns(b, extra), *cols], schema.names)

    return given.mapInArrow(run, schema)


def plain(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({f"__{m}": m for m in MEASURES})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoffs(counts: list[dict], alpha: float = 0.05, delta: float = 0.05) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff. counts has for each stratum n_good and, for each step i of PATH, union_<i> (good texts
    that the rules up to the step reject together), good_<i> and bad_<i> (texts that the step's own cutoff rejects)."""
    level, out = delta / max(1, len(counts)), {}
    for c in counts:
        walked = 0
        while walked < len(PATH) and binomial_tail(c[f"union_{walked}"], c["n_good"], alpha) <= level:
            walked += 1
        for rule in RULES:
            mine = [i for i in range(walked) if PATH[i][0] == rule and c[f"bad_{i}"] > c[f"good_{i}"]]
            if mine:
                most = max(c[f"bad_{i}"] for i in mine)
                out[c["stratum"], rule] = PATH[min(i for i in mine if c[f"bad_{i}"] >= NEAR * most)][1]
    return out


def label_counts(measures: DataFrame, labels: DataFrame) -> list[dict]:
    """Counts for choose_cutoffs() over every labelled text that passes the base rules: a row for each stratum. measures:
    doc_id, stratum, digest (of the text) and MEASURES. Labels without doc_id or quality don't count; of several for a
    document or a text the lowest does."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__good"))
    values = {r: v.alias(f"__{r}") for r, v in rules().items()}
    rated = measures.filter(~base_failed()).join(known, "doc_id").select("stratum", "digest", "__good", *values.values())
    once = rated.groupBy("stratum", "digest").agg(F.min("__good").alias("__good"), *[F.max(f"__{r}").alias(f"__{r}") for r in values])  # equal texts have equal measures
    own = F.array(*[F.col(f"__{rule}") > cut for rule, cut in PATH])
    steps = once.select("stratum", (F.col("__good") > 0).alias("good"), own.alias("own")).withColumn("first", F.array_position("own", F.lit(True)))
    flat = steps.select("stratum", "good", "first", F.posexplode("own").alias("step", "own"))
    union = (F.col("first") > 0) & (F.col("first") <= F.col("step") + 1)
    sums = flat.groupBy("stratum", "step").agg(
        F.count_if("good").alias("n_good"), F.count_if(F.col("good") & union).alias("union"), F.count_if(F.col("good") & F.col("own")).alias("good"), F.count_if(~F.col("good") & F.col("own")).alias("bad")
    )
    out: dict[str, dict] = {}
    for x in sums.collect():
        out.setdefault(x["stratum"], {"stratum": x["stratum"]}).update({"n_good": x["n_good"], **{f"{k}_{x['step']}": x[k] for k in ("union", "good", "bad")}})
    return list(out.values())


def verdict(cutoffs: dict[tuple[str, str], float], stratum: Column) -> Column:
    """False where a rule's measure exceeds its cutoff in the row's stratum."""
    bad = F.lit(False)
    for (s, r), cut in sorted(cutoffs.items()):
        bad = bad | ((stratum == s) & (rules()[r] > cut))
    return ~bad


def strata(docs: DataFrame, by: str) -> Column:
    return F.coalesce(F.col(f"`{by}`").cast("string"), F.lit(""))


def quality_rules(docs: DataFrame, labels: DataFrame, by: str = "lang", alpha: float = 0.05, delta: float = 0.05, carry: list[str] | None = None) -> DataFrame:
    """carry (all columns by default) of every row of docs, with MEASURES, base_failed and kept.

    docs: doc_id, text and the stratum column `by`, a column of few values. Null or empty text has no words and so fails
    the base rules; a null stratum is one of its own; repeated rows are judged each, as trials they count once; no labels:
    only the base rules reject; no rows: no rows. Very long texts are measured whole. Further columns, also ones named as
    our own, don't matter (own results win). Texts are measured once, into a table in the shared folder.
    """
    keep = carried(docs.columns if carry is None else carry, [*MEASURES, "base_failed", "kept"])
    extra = [F.col("doc_id").alias("__id"), strata(docs, by).alias("__stratum"), F.xxhash64(text_bytes()).alias("__digest")]
    full = plain(stored(measured(docs, keep, *extra), "measures"))
    narrow = full.select(F.col("__id").alias("doc_id"), F.col("__stratum").alias("stratum"), F.col("__digest").alias("digest"), *MEASURES)
    kept_by = verdict(choose_cutoffs(label_counts(narrow, labels), alpha, delta), F.col("__stratum"))
    out = full.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & kept_by)
    return out.select(*[f"`{c}`" for c in keep], *MEASURES, "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SPLIT = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_VALUES = {r: f"({a}::DOUBLE / greatest({b}, 1))" for r, (a, b) in RULES.items()}
_STEPS = ", ".join(f"({i}, '{rule}', {cut}::DOUBLE)" for i, (rule, cut) in enumerate(PATH))
SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_SPLIT.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
win AS (SELECT doc_id, i, w || ' ' || {" || ' ' || ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, REPEAT_WINDOW))} AS five FROM words),
five AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win WHERE five IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WINDOW})) AS j FROM five WHERE n > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, stratum, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, CAST((length(text) - length(replace(text, '!!', ''))) / 2 AS BIGINT) AS n_shouts
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"{v} AS v_{r}" for r, v in _VALUES.items())} FROM m),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
once AS MATERIALIZED (SELECT stratum, text, bool_and(good) AS good, {", ".join(f"max(v_{r}) AS v_{r}" for r in RULES)} FROM f JOIN known ON known.doc_id = f.doc_id WHERE NOT base_failed GROUP BY stratum, text),
steps(step, rule, cut) AS (VALUES {_STEPS}),
own AS (SELECT stratum, text, good, step, rule, cut, CASE rule {" ".join(f"WHEN '{r}' THEN v_{r}" for r in RULES)} END > cut AS hit FROM once, steps),
so_far AS (SELECT *, bool_or(hit) OVER (PARTITION BY stratum, text ORDER BY step) AS any_hit FROM own),
c AS (SELECT stratum, step, rule, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND any_hit) AS lost, count(*) FILTER (good AND hit) AS good_hit, count(*) FILTER (NOT good AND hit) AS bad_hit FROM so_far GROUP BY ALL),
p AS (SELECT *, CASE WHEN lost >= n THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.05) + (n - k) * ln(0.95)))) END AS tail, (SELECT count(DISTINCT stratum) FROM c) AS strata FROM c),
walk AS (SELECT *, bool_and(tail <= 0.05 / strata) OVER (PARTITION BY stratum ORDER BY step) AS certified FROM p),
able AS (SELECT *, max(bad_hit) OVER (PARTITION BY stratum, rule) AS most FROM walk WHERE certified AND bad_hit > good_hit),
chosen AS (SELECT stratum, rule, arg_min(cut, step) AS cut FROM able WHERE bad_hit >= {NEAR} * most GROUP BY stratum, rule),
bad AS (SELECT DISTINCT f.doc_id FROM f JOIN chosen ON chosen.stratum = f.stratum WHERE CASE rule {" ".join(f"WHEN '{r}' THEN v_{r}" for r in RULES)} END > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""
