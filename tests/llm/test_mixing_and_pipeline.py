import hashlib
import shutil

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, mixing

from .conftest import ODD
from .test_near_copies import brute_copies
from .test_quality_cutoffs import brute_kept
from .test_structure_operators import WORD, brute_dedup
from .test_text_operators import tik  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def brute_rates(p, n, rounds=mixing.ROUNDS):
    """Projected gradient in numpy over all rows at once."""
    p, n = np.array(p), np.array(n)
    inverse = np.linalg.inv((p * n[:, None]).T @ p + mixing.DAMPING * np.diag(n @ p))
    want = (p[:, 0] @ n) / mixing.TARGETS["good"] * np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    r = np.ones(len(n))
    for _ in range(rounds):
        gap = (p * (n * r)[:, None]).sum(axis=0) - want
        if (np.abs(gap) <= mixing.TOLERANCE * np.maximum(want, 1)).all():
            break
        r = np.maximum(0, r - p @ inverse @ gap)
    return r, p, want


def test_rates_are_those_of_numpy(spark):
    rows = mixing.mix(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")), ["doc_id"]).collect()
    n = [r.n_tokens for r in rows]
    want_rates, p, want = brute_rates([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows], n)
    assert [r.rate for r in rows] == pytest.approx(want_rates, abs=1e-3)
    apart = lambda r: np.abs(p.T @ (np.array(n) * r) - want).sum()
    assert apart(want_rates) < 0.25 * apart(np.ones(len(n)))
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)


def test_classifier_on_other_rows(tables):
    docs, labels = tables
    labels = labels.filter("doc_id % 2 = 0")
    known = {r.doc_id: ("toxic" if r.toxic else "good" if r.quality else "poor") for r in tables[1].collect() if r.doc_id % 2}
    seen = mixing.mix(docs, labels, ["doc_id"]).collect()
    right = [max(mixing.DOMAINS, key=lambda d, r=r: r[f"p_{d}"]) == known[r.doc_id] for r in seen if r.doc_id in known]
    assert np.mean(right) > 0.8


def test_projection_keeps_rates_nonnegative(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3] * 3, 400)
    n = rng.integers(0, 900, 400)
    rows = [(int(a), *(int(round(x * mixing.UNIT)) for x in v)) for a, v in zip(n, p, strict=True)]
    members = spark.createDataFrame(rows, "__n long, __p_good long, __p_poor long, __p_toxic long")
    targets = {"good": 0.999, "poor": 0.0005, "toxic": 0.0005}
    history = mixing.fit_rates(members, targets)
    got = np.array([r[0] for r in members.select(mixing.rate(history)).collect()])
    tokens = (p * (n * got)[:, None]).sum(axis=0)
    assert got.min() == 0 and tokens[0] / tokens.sum() > 0.85
    for targets in (mixing.TARGETS, {"good": 0.2, "poor": 0.5, "toxic": 0.3}):
        got = np.array([r[0] for r in members.select(mixing.rate(mixing.fit_rates(members, targets))).collect()])
        tokens = (p * (n * got)[:, None]).sum(axis=0)
        assert targets["poor"] < 0.1 or tokens / tokens.sum() == pytest.approx(list(targets.values()), rel=0.01)
    got = np.array([r[0] for r in members.select(mixing.rate(mixing.fit_rates(members, targets, most=1), 1)).collect()])
    assert 0 <= got.min() and got.max() <= 1
    one = members.filter("__p_good > 900000").withColumn("__p_poor", F.lit(0)).withColumn("__p_toxic", F.lit(0))
    assert len(mixing.fit_rates(one, rounds=4)) <= 4  # domains without tokens


def test_mixing_odd(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, None, None), (7, 0, 0), (7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.ids == "x" for r in rows)
    assert all(sum(r[f"p_{d}"] for d in mixing.DOMAINS) == pytest.approx(1, abs=1e-4) for r in rows)
    none = mixing.mix(odd, labels.limit(0), ["doc_id"]).collect()
    assert all(r.p_good == pytest.approx(1 / 3, abs=1e-5) for r in none)
    assert mixing.mix(odd.limit(0), labels.limit(0)).count() == 0


def test_pipeline_against_plain_python(spark, tables, tik, tmp_path):  # noqa: F811
    """run() on the smallest tables with rows repeated: each stage against plain Python over its predecessor's rows."""
    docs = [tuple(r) for r in tables[0].collect()]
    docs += [(10_000, docs[3][1], "en", "s", docs[3][4]), (10_001, "tiny text", "en", "s", 9), (10_002, None, None, None, None)]
    spark.createDataFrame(docs, tables[0].schema).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    verdicts, _ = brute_kept([(d[0], d[1], d[2]) for d in docs], [(r.doc_id, r.quality) for r in tables[1].collect()])
    kept = [d for d, k in zip(docs, verdicts, strict=True) if k]
    first = dict(brute_copies([(d[0], d[1]) for d in kept]))
    kept = [d for d in kept if first[d[0]] == d[0]]
    dedup = {i: (n, gone, digest) for i, n, gone, digest in brute_dedup([(d[0], d[1]) for d in kept])}
    left = {d[0] for d in kept if dedup[d[0]][1] < dedup[d[0]][0]}
    assert set(got) <= left and 10_000 not in got and 10_001 not in got and len(got) > 0.6 * len(left)
    texts = {d[0]: d[1] for d in kept}
    for i, r in got.items():
        back = b"".join(tik.decode_single_token_bytes(x) for x in r.ids).decode()
        assert hashlib.sha256(" ".join(WORD.findall(back)).encode()).hexdigest() == dedup[i][2]
        assert r.ids == tik.encode_ordinary(back) and (dedup[i][1] or back == texts[i])
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert P.path(bpe.RANKS)


def test_stages_return_the_columns_of_documents(spark, odd, tmp_path):
    shutil.copy(f"{SF}/labels.parquet", f"{tmp_path}/labels.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", odd.n_words.cast("long").alias("n_chars"))
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, given, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == given.count()


def test_quality_stage_rejects_by_certified_cutoffs(spark):
    """At sf0.01 a cutoff is certified, and the stage's rows are those of plain Python."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    given = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want, cutoffs = brute_kept(given, [(r.doc_id, r.quality) for r in labels.collect()])
    assert cutoffs and {r.doc_id for r in corpus_pipeline.drop_poor(spark, docs, sf).collect()} == {i for (i, _, _), k in zip(given, want, strict=True) if k}


def test_learning_of_memberships_is_that_of_numpy():
    """Softmax weights against the same descent over a dense table."""
    rng = np.random.default_rng(9)
    n, words = 120, 15
    x = [np.flatnonzero(rng.random(words) < 0.3) for _ in range(n)]
    extra, y = np.c_[np.ones(n), rng.random((n, 2))], rng.integers(0, 2, n)
    got = mixing.fit_softmax(x, extra, y, words, rounds=50)
    dense = np.zeros((n, words))
    for i, v in enumerate(x):
        dense[i, v] = 1
    full, k = np.c_[dense, extra], len(mixing.DOMAINS)
    w, move, truth = np.zeros((full.shape[1], k)), 0.0, np.eye(k)[y]
    absent = truth.sum(axis=0) == 0
    w[words] = np.where(absent, -30.0, 0)
    for _ in range(50):
        p = np.exp(full @ w - (full @ w).max(axis=1, keepdims=True))
        g = full.T @ (p / p.sum(axis=1, keepdims=True) - truth) / n + 1e-4 * w
        g[:, absent] = 0
        move = 0.9 * move - 2.0 * g
        w = w + move
    assert got == pytest.approx(w, abs=1e-9)
