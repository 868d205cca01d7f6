import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from docloom.llm import bpe, quality, simhash
from docloom.llm.components import components

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def docs(spark, sample):
    return spark.createDataFrame([(i, t, g) for i, t, g in sample], "doc_id long, text string, lang string")


# --- SimHash ---


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, distance=4):
    """{row number: smallest doc_id reachable}, all pairs compared."""
    ids = [i for i, _ in fps]
    f = np.array([x for _, x in fps], np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= distance) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i in range(len(f)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(f))]


def check_simhash(df, given):
    fps = [(i, brute_fingerprint(t)) for i, t in given]
    want = sorted(zip([i for i, _ in fps], [f"{x:016x}" for _, x in fps], brute_components(fps), strict=True))
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()) == want


def test_simhash_odd(odd):
    check_simhash(odd, [(i, t) for i, t, _ in ODD])


def test_simhash_sample(docs, sample):
    check_simhash(docs, [(i, t) for i, t, _ in sample])


def test_simhash_empty(odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_find_every_component(spark):
    """Dense clusters, larger than the small buckets, around a few centres."""
    rng = np.random.default_rng(1)
    fps = {0, (1 << 64) - 1}
    for c in rng.integers(0, 1 << 63, 6, np.int64).tolist():
        for _ in range(150):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    got = [root.get(int(np.uint64(x).view(np.int64)), x) for x in fps]
    want = brute_components([(i, x) for i, x in enumerate(fps)])
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def tik():
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(df, given, tik):
    got = bpe.encode(df, P.path(bpe.RANKS), P.PATTERN, ["doc_id"], spans=True, decoded=True, digests=True)
    want = sorted((i, tik.encode_ordinary(t or ""), t or "") for i, t in given)
    rows = sorted(got.collect(), key=lambda r: (r.doc_id, r.ids))
    assert [(r.doc_id, r.ids) for r in rows] == [w[:2] for w in want]
    for r, (_, ids, t) in zip(rows, want, strict=True):
        assert r.n_tokens == len(ids) and bytes(r.decoded) == t.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert [*zip(r.starts, r.ends, strict=True)] == spans(t, [tik.decode_single_token_bytes(x) for x in ids])
    back = bpe.decode(got.select("doc_id", "ids"), P.path(bpe.RANKS), P.PATTERN, ["doc_id"])
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t in given)


def spans(text, tokens):
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for t in tokens:
        out.append((owner[at], owner[at + len(t) - 1] + 1))
        at += len(t)
    return out


def test_bpe_odd(odd, tik):
    check_bpe(odd, [(i, t) for i, t, _ in ODD], tik)


def test_bpe_sample(docs, sample, tik):
    check_bpe(docs.limit(60), [(i, t) for i, t, _ in sample[:60]], tik)


def test_bpe_random(tik):
    rng = np.random.default_rng(2)
    alphabet = list("aAeE'stdlvmr  \n\t\r\x0b\x1c\x85  -=_.!09éあ\U0001f600́٠²")
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 4000)] + [c * n for c in "a -=_.0\n" for n in range(1, 70)]
    encoder, back = bpe.rank_encoder(P.path(bpe.RANKS), P.PATTERN)
    for t, p in zip(texts, encoder.packed(texts), strict=True):
        assert np.frombuffer(p, "<u4").tolist() == tik.encode_ordinary(t), repr(t)
    whole = Tokenizer.from_file(P.path(bpe.TOKENIZER))
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>"]
    for t, p in zip(texts, bpe.file_encoder(P.path(bpe.TOKENIZER)).packed(texts), strict=True):
        assert np.frombuffer(p, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(odd, docs, sample, spark, tmp_path):
    whole, cache = Tokenizer.from_file(P.path(bpe.TOKENIZER)), f"{tmp_path}/cache"
    for df, given in ((odd.limit(0), []), (odd, [(i, t) for i, t, _ in ODD]), (docs, [(i, t) for i, t, _ in sample]), (odd, [(i, t) for i, t, _ in ODD])):
        got = bpe.count_tokens(df, P.path(bpe.TOKENIZER), cache, ["doc_id"])
        want = sorted((i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in given)
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    texts = {t or "" for _, t, _ in ODD} | {t or "" for _, t, _ in sample}
    assert spark.read.parquet(cache).count() == len(texts)  # each text was encoded once, the second time from the cache


# --- quality rules ---


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= {*range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_measures(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(odd, labels).collect()
    want = sorted((i, *brute_measures(t)) for i, t, _ in ODD)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
        assert r.ids == "x" and r.source == "s0"
    assert quality.quality_rules(odd.limit(0), labels.limit(0), carry=["doc_id"]).count() == 0


def test_quality_sample(docs, sample, spark):
    rows = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"), carry=["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted((i, *brute_measures(t)) for i, t, _ in sample)


def test_binomial_tail():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (7, 7, 0.5), (0, 1, 0.01)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
