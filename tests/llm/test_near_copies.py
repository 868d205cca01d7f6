import random

import numpy as np

import corpus_pipeline
from docloom.llm import copies

from .conftest import ODD
from .test_text_operators import LOWER, WORD


def brute_copies(given, similarity=0.8, size=5):
    """Smallest doc_id reachable by links of enough Jaccard similarity, all pairs compared; nulls last."""
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
            b = sets[j]
            if a == b or 10 * len(a & b) >= round(10 * similarity) * len(a | b) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(given):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(given)), key=str)


def got_copies(spark, given):
    df = spark.createDataFrame(given, "doc_id long, text string")
    return sorted(((r.doc_id, r.component_id) for r in copies.near_copies(df).collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_copies_are_those_of_all_pairs(spark, sample):
    rng = random.Random(2)
    given = [(i, t) for i, t, _ in sample] + [(1000 + i, t) for i, t, _ in ODD] + [(None, "alone " * 3 + "null")]
    for g in range(12):  # groups around the threshold, some larger than the small buckets
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        given += [(2000 + 100 * g + i, edited(rng, words, rng.choice((0, 1, 2, 3, 4)))) for i in range(6 if g % 3 else 30)]
    assert got_copies(spark, given) == brute_copies(given)
    assert got_copies(spark, []) == []


def test_parted_buckets_are_joined(spark):
    """A chain whose members share one bucket but of which few are like the first."""
    words = [f"w{i}" for i in range(400)]
    given = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(35)]
    assert got_copies(spark, given) == brute_copies(given)
    sets = [copies.shingles(t.encode()).view(np.int64) for _, t in given]
    assert len(copies.join_sets(list(range(35)), list(range(35)), sets, 0.8)) == 34
    assert len(copies.join_sets(list(range(35)), [i // 7 for i in range(35)], sets, 0.8)) == 4
    key, node = np.zeros(20, np.int64), np.arange(20, dtype=np.uint64)
    assert sum(len(a) for a, _, _ in copies.candidates(key, node)) == 20  # grows with the bucket, not with its square


def test_pipeline_drops_an_edited_copy(spark, tmp_path):
    """Jaccard 0.85 or so, at which fingerprints are more than 4 bits apart."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(230)]
    given = [(1, " ".join(words))] + [(i, edited(rng, words, 4)) for i in (2, 3, 4)] + [(5, edited(rng, words, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == [1, 5]


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark, tmp_path):
    text, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    given = [(1, text), (1, text), (None, text), (None, other), (None, other), (None, third), (7, third), (1, third + " more"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, text), (None, other), (1, third + " more"), (None, "alone")], key=str)
