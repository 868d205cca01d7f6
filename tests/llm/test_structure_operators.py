import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.llm import html, language, licenses, substrings, topk

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def docs(spark, sample):
    return spark.createDataFrame([(i, t, g) for i, t, g in sample], "doc_id long, text string, lang string")


# --- substring dedup ---


def brute_dedup(given, k=13):
    first = {}
    cut = [(i, WORD.findall(t or "")) for i, t in given]
    for i, w in cut:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in cut:
        gone = {x for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < i for x in range(s, s + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def dedup(df, **more):
    rows = substrings.dedup_substrings(df, ["doc_id"], **more).collect()
    for r in rows:
        assert WORD.findall(r.kept_text) == r.kept_words.split(" ") if r.kept_words else not (r.kept_text or "").strip()
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_words.encode()).hexdigest()) for r in rows)


def test_dedup_odd(odd, spark):
    assert dedup(odd) == brute_dedup([(i, t) for i, t, _ in ODD])
    assert dedup(odd.limit(0)) == []
    null = spark.createDataFrame([(None, ODD[0][1]), (1, ODD[0][1])], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.dedup_substrings(null).collect()) == [0, 0]
    full = substrings.dedup_substrings(odd)
    assert set(full.columns) == {*odd.columns, "n_removed", "kept_words", "kept_text"}
    assert {r.doc_id: r.kept_text for r in full.collect()}[8] == ODD[7][1]  # untouched texts stay as they are


def test_dedup_sample(docs, sample):
    assert dedup(docs, batch_bytes=100_000, shard_bytes=200_000) == brute_dedup([(i, t) for i, t, _ in sample])


def test_dedup_dense_repeats(spark):
    """Few distinct words, so windows recur at odd places and within texts."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("ab", k=rng.randrange(40)) if i % 2 else ["x y z"] * rng.randrange(20))) for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert dedup(df, batch_bytes=300, shard_bytes=500) == brute_dedup(texts)


# --- exact top-k ---


def brute_topk(rows, k=20):
    """Every row with an id divisible by 20 asks, all rows but itself answer."""
    ints = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    for at, (q, v) in enumerate(ints):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(ints) if other != at)[:k]  # noqa: B905
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def topk_rows(df, **more):
    return sorted(map(tuple, topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0, **more).collect()))


def test_topk_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(90)] + [(0, [9.0] * 5), (None, [1.0] * 5), (200, None), (201, [None, 1.0]), (202, [float("nan")] * 5)]
    rows += [(203, [float("inf")] * 5), (204, []), (220, [1.0, -1.0]), (41, rng.normal(size=5).tolist())]
    rows += [rows[40]] * 2 + [rows[7]] * 30 + [(60, rows[61][1])]  # rows that repeat, and an id with several vectors
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    assert topk_rows(df) == brute_topk(rows)
    assert topk_rows(df, query_block=2, candidate_block=7, sample=25) == brute_topk(rows)
    assert topk_rows(df.limit(0)) == [] and topk_rows(df.filter("vec_id = 80")) == []


def test_scores_that_do_not_fit_raise():
    big = np.full((1, 4), 1 << 31, np.int64)
    with pytest.raises(OverflowError):
        topk.search(np.array([0]), big, np.array([1]), big, 20)


def test_bounds_drop_pairs_of_the_given_vectors():
    """How far bounds reach on vectors that point everywhere: a share of pairs is still summed in each block."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v, ids = np.floor(64 * np.array(t["embedding"].to_pylist())).astype(np.int64), np.array(t["vec_id"].to_pylist())
    queries = np.flatnonzero(ids % 20 == 0)
    r, s, score = topk.search(ids[queries], v[queries], ids, v, 20)
    least = np.array([score[r == i].min() for i in range(len(queries))])
    summed: dict = {}
    again = topk.search(ids[queries], v[queries], ids, v, 20, least, dropped=summed)
    assert all((a == b).all() for a, b in zip(again, (r, s, score), strict=True))
    share = [float(np.mean(x)) for _, x in sorted(summed.items())]
    assert share[0] == 1 and share[-1] < 0.25 and sorted(share, reverse=True) == share


def test_topk_clusters(spark, monkeypatch):
    """Clustered vectors, so that bounds drop pairs; also with whole numbers too large for floating point."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 48)) * 4
    c = np.floor(64 * (centres[rng.integers(0, 8, 1500)] * np.r_[np.ones(16), np.full(32, 0.1)] + rng.normal(size=(1500, 48)) * 0.05)).astype(np.int64)
    ids = rng.permutation(1500).astype(np.int64)
    for scale in (1, 1 << 20):
        for dense in (1.0, 0.5, 0.0):
            monkeypatch.setattr(topk, "DENSE", dense)
            r, s, score = topk.search(ids[:40], c[:40] * scale, ids, c * scale, 20)
            full = (c[:40] * scale) @ (c * scale).T
            for q in range(40):
                want = sorted((-int(full[q, j]), int(ids[j])) for j in range(1500) if ids[j] != ids[q])[:20]
                assert [(-int(a), int(ids[b])) for a, b in zip(score[r == q], s[r == q], strict=True)] == want


# --- language identification ---


def brute_language(text, profiles):
    words = language.words_of(text)
    if not words:
        return "und"
    count = {}
    for w in words:
        for g in language.grams(w):
            count[g] = count.get(g, 0) + 1
    own = sorted(count, key=lambda g: (-count[g], language.key_of(g) * int(language.TIES) % (1 << 64)))[: language.TOP]
    far = {k: sum(abs(p.index(g) - i) if g in p else language.TOP for i, g in enumerate(own)) for k, p in profiles.items()}
    return min(sorted(far), key=far.get)


def test_language(odd, docs, sample):
    profiles = language.learn_profiles(docs.filter(language.fold() != 2))
    assert set(profiles) == {g for _, _, g in sample} and all(len(set(p)) == language.TOP for p in profiles.values())
    for df, given in ((odd, ODD), (docs, sample)):
        rows = language.identify(df, profiles, ["doc_id"]).collect()
        assert sorted((r.doc_id, r.lang_pred) for r in rows) == sorted((i, brute_language(t, profiles)) for i, t, _ in given)
        assert all(0 <= r.score <= 1 for r in rows)
    pairs = [(g, r.lang_pred) for (_, _, g), r in zip(sorted(sample), sorted(rows), strict=True)]
    assert np.mean([a == b for a, b in pairs]) > 0.97
    assert {r.lang_pred for r in language.identify(odd, {}, ["doc_id"]).collect()} == {"und"}
    assert language.learn_profiles(odd.limit(0)) == {}


def test_grams_of_long_texts_and_odd_words(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("aéßあ𝒳", k=rng.choice((1, 2, 3, 9)))) for _ in range(500)]
    count = Counter(g for w in words for g in language.grams(w))
    for piece in (20_000, 7, 1):
        monkeypatch.setattr(language, "PIECE", piece)
        keys, n = language.gram_counts(words)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {language.key_of(g): k for g, k in count.items()}


def test_profiles_are_those_of_plain_counts(docs, sample):
    """All documents are within the sample here, so profiles follow from counting alone."""
    count = {}
    for _, t, g in sample:
        own = count.setdefault(g, Counter())
        for w in language.words_of(t):
            own.update(language.grams(w))
    want = {g: sorted(c, key=lambda x, c=c: (-c[x], x))[: language.TOP] for g, c in count.items()}
    assert language.learn_profiles(docs) == want


# --- license scans ---


def test_patience():
    assert licenses.patience(list("xaxbxcx"), list("abc")) == [(1, 0), (3, 1), (5, 2)]
    assert licenses.patience(list("cab"), list("abc")) == [(1, 0), (2, 1)]
    assert licenses.patience([], list("a")) == []
    for a, b in ((list("abcabba"), list("cbabac")), (list("aaaa"), list("aa"))):
        found = licenses.patience(a, b)
        assert all(a[x] == b[y] for x, y in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))  # noqa: B905


def test_license_scan(spark, odd):
    mit, long = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MIT-text"]
    edited = " ".join(w for i, w in enumerate(long.split()) if i % 12)
    texts = [f"{'the word ' * 500}{mit.upper()}. {'tail ' * 500}", f"License, license!\n{edited}\nlicense", "licensed version under the GNU", None, "", f"{mit} and {licenses.TEMPLATES['CC-BY-NC-4.0']}"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    rows = {r.doc_id: r for r in licenses.license_scan(df, df.columns).drop("text").collect()}
    assert [rows[i].license for i in range(6)] == ["MIT", "MIT-text", None, None, None, "CC-BY-NC-4.0"]
    assert rows[0].coverage == 1 and rows[0].first_word == 1000 and rows[0].last_word == 1004 and 0.8 <= rows[1].coverage < 1
    assert rows[5].n_licenses == 2 and rows[5].licenses == "CC-BY-NC-4.0,MIT"
    assert licenses.license_scan(odd, odd.columns).count() == len(ODD) and licenses.license_scan(odd.limit(0), ["doc_id"]).count() == 0


# --- HTML extraction ---


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="ad-free"><NAV><p>menu</nav>
    <div class="top cookie-notice"><div>cookies</div></div><script>"</p>"</script><!-- <p>no</p> -->
    <main><header><h1>Head&amp;line</h1></header><p title="a > b">one<b>two</b> &lt;three&gt;
    next<br>line<p>five</p><aside>side</aside><form><p>form</form><div hidden>h</div><section id="comments"><p>said</section></main>
    <p>after</p><footer>foot</footer>"""
    assert html.blocks_of(page) == [(1, "menu"), (1, "cookies"), (2, "Head&line"), (2, "onetwo <three> next line"), (2, "five"), (1, "side"), (1, "form"), (1, "h"), (1, "said"), (0, "after"), (1, "foot")]
    assert html.main_text(html.blocks_of(page), None) == "Head&line\nonetwo <three> next line\nfive"
    for bad in ("", "<", "a < b", "<p", "<p class='", "<script>", "<!--", "</p></p>", "<div " + "a='" * 2000):
        html.blocks_of(bad)


def test_common_lines():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(25)) for _ in "12")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        for most in (1 << 27, 20):
            got = sorted(html.common_lines(a, b, most))
            left = iter(b)
            assert len(got) == table[-1][-1] and all(a[i] in left for i in got)
