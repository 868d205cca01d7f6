"""Whitening, vector codes and b-bit MinHash against plain versions, with odd rows."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm import codes, minhash, whitening

from .conftest import ODD
from .test_near_copies import edited
from .test_text_operators import LOWER, WORD

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, component int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 7, "x") for i, v, g in rows], SCHEMA)


def odd_vectors(rng, n, d):
    """Vectors with repeated rows, null ids, null and non-finite entries."""
    rows = [(i, [rng.gauss(0, 1) * (1 + j) for j in range(d)], rng.choice((0, 1, 1, 1, None))) for i in range(n)]
    rows += [rows[0], (None, rows[1][1], None), (n, rows[2][1], 1)]
    rows += [(n + 1, None, 0), (n + 2, [None] + [0.0] * (d - 1), 0), (n + 3, [float("nan")] + [0.0] * (d - 1), 0), (n + 4, [float("-inf")] + [0.0] * (d - 1), 0)]
    return rows


def whole(rows):
    return [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


# --- whitening ---


def brute_whitening(rows, components=16):
    """(vec_id, deviation, whitened of each component), shares; exact rational covariance."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in rows]
    fit = sorted({tuple(v) for v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    y = [[n * v[j] - s[j] for j in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    out = [(i, sum((n * v[j] - s[j]) ** 2 for j in range(d)), (np.array([float(Fraction(n * v[j] - s[j], n)) for j in range(d)]) @ axes) / np.sqrt(e)) for (i, _, _), v in zip(rows, x, strict=True)]
    return n, out, e / np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_whitening_is_that_of_exact_covariances(spark, scale):
    rng = random.Random(3)
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v], g) for i, v, g in odd_vectors(rng, 60, 5)]
    got = whitening.whiten(frame(spark, rows).repartition(5)).collect()
    n, want, shares = brute_whitening(whole(rows))
    assert {r.n for r in got} == {n} and len(got) == 5 * len(want)
    assert max(abs(r.explained - shares[r.component - 1]) for r in got) < 1e-12 and max(r.identity_error for r in got) < 1e-9
    key = lambda i, dev, z: (str(i), dev, round(abs(z), 6))
    for c in range(5):
        mine = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == c + 1}
        theirs = {(i, dev): z[c] for i, dev, z in want}
        sign = 1 if all(abs(mine[k] - theirs[k]) < 1e-7 for k in theirs) else -1  # either, but the same for all rows
        assert mine.keys() == theirs.keys() and all(abs(mine[k] - sign * theirs[k]) < 1e-7 for k in theirs)
        assert sorted(key(r.vec_id, r.deviation, r.whitened) for r in got if r.component == c + 1) == sorted(key(i, dev, z[c]) for i, dev, z in want)


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 19, 1 << 20, 1 << 41, 1 << 61):
        y = rng.integers(-top, top, (300, 4)) if top > 1 else rng.integers(-1, 2, (300, 4))
        y[0], y[1] = top - 1, -top
        g = whitening.Gram(4)
        for part in np.array_split(y, 7):
            g.add(part)
        exact = y.astype(object)
        assert (g.recombined() == exact.T @ exact).all()
        assert (sum(x.astype(np.int64).astype(object) * (1 << whitening.LIMB * i) for i, x in enumerate(whitening.limbs(y))) == exact).all()
    for value in (0, -1, 10**40, -(10**40), 1 << 31, 1 << 32):
        assert sum(p << (32 * i) for i, p in enumerate(whitening.digits(value))) == value


def test_whitening_of_few_and_odd_vectors(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [float("nan")], 1)])).collect() == []
    same = whitening.whiten(frame(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1)])).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, 0.0)}
    line = whitening.whiten(frame(spark, [(i, [float(i), 1.0, 2.0 * i], 1) for i in range(9)])).collect()  # one direction only
    assert all((r.whitened is not None) == (r.component == 1) for r in line) and line[0].identity_error < 1e-12
    short = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [3.0], 1), (3, [0.0, 5.0], 1)]))
    padded = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 0.0], 1), (3, [0.0, 5.0], 1)]))
    assert sorted(short.collect()) == sorted(padded.collect())
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whiten(frame(spark, [(1, [1e12], 1), (2, [0.0], 1)])).collect()


# --- vector codes ---


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, code, error, label_error) and the digest: every part against every entry in every round."""
    d = max(len(v) for _, v, _ in rows)
    d = -(-d // parts) * parts
    v = [[int(np.floor(1024 * c)) for c in v] + [0] * (d - len(v)) for _, v, _ in rows]
    w = d // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))[:entries]
    book = [[v[i][p * w : (p + 1) * w] for i in order] for p in range(parts)]
    near = lambda x, es: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(es))
    for r in range(rounds + 1):
        found = [[near(x[p * w : (p + 1) * w], book[p]) for p in range(parts)] for x in v]
        if r < rounds:
            for p in range(parts):
                for k in range(len(book[p])):
                    mine = [x[p * w : (p + 1) * w] for x, f in zip(v, found, strict=True) if f[p][1] == k]
                    if mine:
                        book[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    errors = [sum(s for s, _ in f) for f in found]
    by = {}
    for (_, _, g), e in zip(rows, errors, strict=True):
        by[g] = by.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by[g]) for (i, _, g), f, e in zip(rows, found, errors, strict=True)), key=str), digest


@pytest.mark.parametrize(("n", "d", "entries", "scale", "block"), [(120, 8, 16, 0.1, 17), (90, 6, 256, 0.02, 1000), (70, 8, 5, 3e3, 16)])
def test_codes_are_those_of_full_scans(spark, n, d, entries, scale, block):
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v], g) for i, v, g in odd_vectors(random.Random(n), n, d)]
    seen = []
    got = codes.compress(frame(spark, rows).repartition(3), entries=entries, block=block, scanned=seen).collect()
    want, digest = brute_codes(whole(rows), entries=entries)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert seen[0][0] == seen[0][1] and seen[-1][0] < seen[-1][1]  # heaps keep later rounds from scanning all


def test_heaps_keep_what_holds(spark):
    """Well parted clusters: after the first round nothing is scanned again, though entries move."""
    rng = random.Random(5)
    rows = [(i, [10.0 * (i % 4) + rng.random() * 0.01 for _ in range(8)], i % 4) for i in range(400)]
    seen = []
    got = codes.compress(frame(spark, rows), entries=4, scanned=seen).collect()
    assert [s for s, _ in seen] == [1600, 0, 0, 0] and sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == brute_codes(rows, entries=4)[0]


def test_codes_of_odd_tables(spark):
    assert codes.compress(frame(spark, [])).collect() == [] and codes.compress(frame(spark, [(1, None, 1)])).collect() == []
    got = codes.compress(frame(spark, [(5, [0.5, 0.25, 0.125], None), (None, [], None)])).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == brute_codes([(5, [0.5, 0.25, 0.125], None), (None, [], None)])[0]
    with pytest.raises(Exception, match="2\\^28"):
        codes.compress(frame(spark, [(1, [1e9] * 4, 1)])).collect()
    with pytest.raises(ValueError):
        codes.compress(frame(spark, []), entries=257)


# --- b-bit MinHash ---


def brute_minhash(given, size=4):
    """(doc_id, n_shingles, component_id), all pairs compared; nulls last."""
    sets = []
    for _, t in given:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(given):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(given)), key=str)


def got_minhash(spark, given, **more):
    df = spark.createDataFrame([(i, t, -1, -1) for i, t in given], "doc_id long, text string, node long, n_shingles long").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **more).collect()), key=str)


def test_minhash_links_are_those_of_all_pairs(spark, sample):
    rng = random.Random(2)
    given = [(i, t) for i, t, _ in sample] + [(1000 + i, t) for i, t, _ in ODD] + [(None, "alone " * 3 + "null"), (None, "")]
    for g in range(12):  # groups around the threshold, some larger than the small buckets
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        given += [(2000 + 100 * g + i, edited(rng, words, rng.choice((0, 1, 2, 3, 4, 5)))) for i in range(6 if g % 3 else 40)]
    want = brute_minhash(given)
    assert got_minhash(spark, given) == want
    assert got_minhash(spark, given, tile=500) == want  # families in many tiles
    assert got_minhash(spark, []) == [] and got_minhash(spark, [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]


def test_chains_within_a_bucket_are_joined(spark):
    """Texts of which only neighbours are alike share most bands: stars leave the bucket in parts."""
    rng = random.Random(4)
    words, given = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(60):
        given.append((i, " ".join(words)))
        for at in rng.sample(range(200), 3):
            words[at] = f"n{rng.randrange(10**9)}"
    want = brute_minhash(given)
    assert got_minhash(spark, given, tile=1500) == want and len({c for _, _, c in want}) < 10


def test_a_very_long_text_is_read_whole(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(1_500_000)]
    copy = words[:-1] + ["other"]
    assert got_minhash(spark, [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(words[: len(words) // 2]))]) == [(1, 1_499_997, 1), (2, 1_499_997, 1), (3, 749_997, 3)]


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(8)
    for small in (8, 400):
        found = []
        for _ in range(60):
            both, a, b = rng.integers(0, 1 << 63, 8 * small // 10, np.uint64), rng.integers(0, 1 << 63, small // 10 + 1, np.uint64), rng.integers(0, 1 << 63, small // 10 + 1, np.uint64)
            x, y = (minhash.packed(minhash.minima(np.r_[both, own])) for own in (a, b))
            true = len(both) / (len(both) + len(a) + len(b))
            found.append(minhash.similarity(int(minhash.agreeing_with(x, y[None])[0])) - true)
        assert abs(np.mean(found)) < 0.03 and np.abs(found).max() < 0.15


def test_bit_counts_in_the_engine_are_those_in_tasks(spark):
    rng = np.random.default_rng(9)
    a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, (50, 16)) for _ in range(2))
    b[:, ::2] = a[:, ::2]
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<long>, b array<long>")
    mine = [r.n for r in df.select(minhash.agreeing("a", "b").alias("n")).collect()]
    assert mine == [int(minhash.agreeing_with(x.view(np.uint64), y.view(np.uint64)[None])[0]) for x, y in zip(a, b, strict=True)]


def test_sql_gives_the_same_rows(spark):
    from ..oracle import database, difference

    duck = database(FOLDER)
    assert difference(spark, duck, FOLDER, minhash.op12_minhash, minhash.SQL) is None
    assert difference(spark, duck, FOLDER, codes.op13_vector_codes, codes.SQL) is None


def test_whitening_of_the_given_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    got = whitening.op11_whitening(spark, FOLDER).collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(object)
    cov = (y.T @ y).astype(float) / float(n) ** 3
    e = np.linalg.eigvalsh(cov)[::-1][:16]
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    at = {r.vec_id: i for i, r in enumerate(rows)}
    z = np.zeros((len(rows), 16))
    for r in got:
        z[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == int(((n * x[at[r.vec_id]] - s) ** 2).sum()) and abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-9
    assert np.abs(np.cov(z.T, bias=True) - np.eye(16)).max() < 1e-6 and got[0].identity_error < 1e-9


def test_one_row_of_each_group_stays(spark, sample):
    from docloom.llm import copies

    rng = random.Random(12)
    given = [(i, t, "s") for i, t, _ in sample] + [(1000 + i, t, "s") for i, t, _ in ODD] + [(None, "alone " * 9, "b"), (None, "alone " * 9, "a"), (None, None, "a"), (7, sample[3][1], "z"), (7, sample[3][1], "z")]
    for g in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        given += [(2000 + 100 * g + i, edited(rng, words, rng.choice((0, 1, 2, 3, 4))), "g") for i in range(4 if g % 2 else 30)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(5)
    rows = lambda found: sorted(((r.doc_id, r.text, r.source) for r in found.collect()), key=str)
    want = rows(copies.one_of_each(df))  # the same links, found and compared in another way
    assert rows(minhash.one_of_each(df, 5, 80)) == want and rows(minhash.one_of_each(df, 5, 80, tile=500)) == want
    assert minhash.one_of_each(df.limit(0), 5).collect() == []
