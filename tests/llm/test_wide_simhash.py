import random

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import copies, minhash, wide_simhash

from .conftest import ODD
from .test_near_copies import edited


def pair(rng, both, own):
    """Fingerprints of two sets of shingles of which so many are shared, and so many are each one's own."""
    shared = rng.integers(0, 1 << 63, both, np.uint64)
    return [wide_simhash.fingerprint(np.r_[shared, rng.integers(0, 1 << 63, own, np.uint64)]) for _ in "ab"]


def test_the_stage_finds_near_copies_by_simhash(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("MinHash stands in for SimHash")

    monkeypatch.setattr(minhash, "sketches", never)
    monkeypatch.setattr(minhash, "candidates", never)
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(230)]
    given = [(1, " ".join(words)), (2, edited(rng, words, 4)), (3, edited(rng, words, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    calls, real = [], minhash.rooted
    monkeypatch.setattr(minhash, "rooted", lambda *a: calls.append(a[4]) or real(*a))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == [1, 3]
    assert calls == [wide_simhash.SIMHASH]


@pytest.mark.parametrize("small", [6, 30, 400])
def test_pairs_at_the_similarity_are_near_and_share_a_block(small):
    """8 in 10 shingles of the union are shared."""
    rng = np.random.default_rng(small)
    near = wide_simhash.most_differing(80)
    for n in (1000, 200_000):
        places = wide_simhash.blocks(n, 80)
        for _ in range(150):
            a, b = pair(rng, 8 * small, small)
            assert wide_simhash.apart(a, b[None])[0] <= near
            assert (np.bitwise_count(a[:2] ^ b[:2]).sum()) <= wide_simhash.most_differing(80, 128)
            assert (wide_simhash.block_keys(a[None], places) == wide_simhash.block_keys(b[None], places)).any()
    far = [wide_simhash.apart(*(x if i == 0 else x[None] for i, x in enumerate(pair(rng, 40, 60))))[0] for _ in range(50)]
    assert min(far) > near  # a quarter shared


def test_fingerprints_are_majorities_of_bits():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 700, np.uint64)
    one = np.array([np.unpackbits(wide_simhash.fingerprint(own[i : i + 1]).view(np.uint8)) for i in range(700)], np.int64)
    assert (np.unpackbits(wide_simhash.fingerprint(own).view(np.uint8)) == (2 * one.sum(axis=0) > 700)).all()


def test_more_fingerprints_get_longer_blocks():
    few, many = wide_simhash.blocks(40_000, 80), wide_simhash.blocks(13_000_000, 80)
    assert few.shape[1] == 6 and many.shape[1] == 14 and len(few) < len(many) < 200


def test_links_of_buckets_connect_what_near_pairs_connect():
    """Alone, few, a crowd of copies, and a chain: as all pairs of each bucket give."""
    rng = np.random.default_rng(3)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.left_shift(np.uint64(1), rng.choice(64, n, replace=False).astype(np.uint64)))
    alone = rng.integers(0, 1 << 63, (300, 2), np.uint64)
    crowd = np.array([[flip(alone[0, 0], 3), flip(alone[0, 1], 3)] for _ in range(200)])
    chain = [alone[1]]
    for _ in range(40):
        chain.append(np.array([flip(chain[-1][0], 8), flip(chain[-1][1], 8)]))
    few = np.array([[flip(x[0], 5), flip(x[1], 5)] for x in alone[2:12]])
    for rest in ([alone], [alone, few], [alone, crowd], [alone, crowd, few, np.array(chain)], [crowd], [alone[:1]]):
        sig = np.concatenate(rest)
        node = rng.permutation(len(sig)).astype(np.uint64) + np.uint64(1)
        most, near = 25, np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2, dtype=np.int64) <= 25
        i, j = np.nonzero(np.triu(near, 1))
        want = {tuple(sorted(node[g].tolist())) for g in wide_simhash.groups_of(len(sig), i, j)}
        key = np.full(len(sig), 7, np.int64)
        found = list(wide_simhash.candidates(key, node, sig, most))
        bucket, src, dst = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64),) * 3
        got = {tuple(sorted(x.tolist())) for x in wide_simhash.groups_of(len(sig), src, dst)}
        assert {x for x in got if len(x) > 1} == want
        assert len(src) <= 9 * len(sig) and all((src[bucket == b] == src[bucket == b][0]).all() for b in set(bucket.tolist()) - {0})


def test_distances_in_the_engine_are_those_in_tasks(spark):
    rng = np.random.default_rng(9)
    a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, (50, 16)) for _ in range(2))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<long>, b array<long>")
    mine = [r.n for r in df.select(wide_simhash.distance("a", "b").alias("n")).collect()]
    assert mine == [int(wide_simhash.apart(x.view(np.uint64), y.view(np.uint64)[None])[0]) for x, y in zip(a, b, strict=True)]


def test_one_row_of_each_group_stays(spark, sample):
    rng = random.Random(12)
    given = [(i, t, "s") for i, t, _ in sample] + [(1000 + i, t, "s") for i, t, _ in ODD] + [(None, "alone " * 9, "b"), (None, "alone " * 9, "a"), (None, None, "a"), (7, sample[3][1], "z"), (7, sample[3][1], "z")]
    for g in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        given += [(2000 + 100 * g + i, edited(rng, words, rng.choice((0, 1, 2, 3, 4))), "g") for i in range(4 if g % 2 else 40)]
    words = [f"c{i}" for i in range(400)]
    given += [(3000 + i, " ".join(words[8 * i : 8 * i + 120]), "chain") for i in range(35)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(5)
    rows = lambda found: sorted(((r.doc_id, r.text, r.source) for r in found.collect()), key=str)
    want = rows(copies.one_of_each(df))  # the same links, found and compared in another way
    assert rows(wide_simhash.one_of_each(df, 5, 80)) == want and rows(wide_simhash.one_of_each(df, 5, 80, tile=500)) == want
    assert wide_simhash.one_of_each(df.limit(0), 5, 80).collect() == []


def test_a_large_group_is_held_once_whatever_its_blocks(spark, monkeypatch):
    """150 near copies, and 150 texts that share half of one: these hang together by the first bits, not by all."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    given = [(i, edited(rng, words, rng.choice((0, 1, 2, 3, 4)))) for i in range(150)]
    given += [(1000 + i, " ".join(words[:75] + [f"x{rng.randrange(90000)}" for _ in range(75)])) for i in range(150)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    counts, real = {}, minhash.kept

    def counting(made, label):
        table = real(made, label)
        counts[label] = table[0].count()
        return table

    monkeypatch.setattr(minhash, "kept", counting)
    got = sorted(r.doc_id for r in wide_simhash.one_of_each(df, 5, 80).collect())
    assert got == sorted(r.doc_id for r in copies.one_of_each(df).collect()) and set(range(1000, 1150)) < set(got)
    assert counts["families"] <= 150  # before: all 273 that differ
    assert counts["parted"] <= 12 * 150  # before: 5,069, a text once for each bucket


def test_large_groups_are_near_by_whole_fingerprints(spark):
    """150 fingerprints whose first bits are near and whose others are not, beside 50 that are near."""
    rng = np.random.default_rng(4)
    sig = rng.integers(-(1 << 63), (1 << 63) - 1, (200, 16))
    sig[:, :2] = sig[0, :2]
    sig[150:] = sig[150] ^ rng.integers(0, 4, (50, 16))
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sig)], "node long, sig array<long>").cache()
    got = wide_simhash.found(nodes, 80, lambda made, label: made).collect()
    assert {x for r in got if r.bucket for x in (r.src, r.dst)} == set(range(150, 200))
