from math import comb

import pytest

from docloom.llm import quality

from .test_text_operators import brute_measures

SF = "/root/testdata/sf0.01"


def brute_rates(text):
    """The measure of each rule, in plain Python."""
    text = text or ""
    n_words, chars, symbols, dup, repeat = brute_measures(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    upper = sum(c.isupper() for w in text.split() for c in w)
    return {"symbols": symbols / max(1, chars), "shouts": text.count("!!") / max(1, n_words), "dup_lines": dup / max(1, len(lines)), "repeats": repeat / max(1, n_words), "upper": upper / max(1, chars)}


def brute_failed(text):
    n_words, *_, repeat = brute_measures(text)
    return n_words < 10 or 100 * repeat > 20 * n_words


def tail(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute_kept(docs, labels, alpha=0.05, delta=0.05):
    """(kept of each row, cutoffs). docs: doc_id, text, lang; labels: doc_id, quality."""
    least = {}
    for i, q in labels:
        if i is not None and q is not None:
            least[i] = min(q, least.get(i, q))
    texts = {}  # stratum -> text -> lowest label
    for i, t, g in docs:
        if i in least and not brute_failed(t):
            own = texts.setdefault(g or "", {})
            own[t] = min(least[i], own.get(t, least[i]))
    cutoffs = {}
    for g, own in texts.items():
        good = [brute_rates(t) for t, q in own.items() if q > 0]
        bad = [brute_rates(t) for t, q in own.items() if q <= 0]
        walked = []
        for rule, cut in quality.PATH:
            if tail(sum(any(m[r] > c for r, c in [*walked, (rule, cut)]) for m in good), len(good), alpha) > delta / len(texts):
                break
            walked.append((rule, cut))
        for rule in quality.RULES:
            hits = lambda rows, c, rule=rule: sum(m[rule] > c for m in rows)
            mine = [c for r, c in walked if r == rule and hits(bad, c) > hits(good, c)]
            if mine:
                most = max(hits(bad, c) for c in mine)
                cutoffs[g, rule] = max(c for c in mine if hits(bad, c) >= quality.NEAR * most)
    kept = [not brute_failed(t) and not any(g == (lang or "") and brute_rates(t)[r] > c for (g, r), c in cutoffs.items()) for _, t, lang in docs]
    return kept, cutoffs


def test_verdicts_are_those_of_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    given = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want, cutoffs = brute_kept(given, [(r.doc_id, r.quality) for r in labels.collect()])
    assert cutoffs  # something is certified on these tables
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels, carry=["doc_id"]).collect()}
    assert got == {i: k for (i, _, _), k in zip(given, want, strict=True)}
    assert sum(not k for k in want) > sum(brute_failed(t) for _, t, _ in given)


def test_copies_count_once(spark):
    """One good text, however often it is labelled, certifies nothing; nor do repeated rows of labels."""
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [(i, prose if i < 500 else f"{prose} {i} ###" * 3, "en") for i in range(520)] + [(3, None, None)]
    labels = [(i, int(i < 500)) for i in range(520)] * 2 + [(1000, 1), (None, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    want, cutoffs = brute_kept(rows, labels)
    assert cutoffs == {}
    assert sorted(map(str, want)) == sorted(str(r.kept) for r in quality.quality_rules(docs, known, carry=["doc_id"]).collect())
    distinct = [(i, f"{prose} {i}" if i < 500 else f"{prose} {i} " + "#" * 200, "en") for i in range(520)]
    want, cutoffs = brute_kept(distinct, labels)
    assert cutoffs and sum(want) == 500
    docs = spark.createDataFrame(distinct, "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs, known, carry=["doc_id"]).collect()} == dict(enumerate(want))


def counts(stratum, n_good, union, good, bad):
    n = len(quality.PATH)
    return {"stratum": stratum, "n_good": n_good, **{f"{k}_{i}": f(i) for k, f in (("union", union), ("good", good), ("bad", bad)) for i in range(n)}}


def test_fixed_sequence():
    none = lambda i: 0
    few = counts("few", 50, none, none, lambda i: 9)
    # good documents begin to be lost at the fifth step: no later step is tried, whatever it would show
    much = counts("much", 400, lambda i: 0 if i < 4 else 200, none, lambda i: 10 * (i + 1))
    cut = dict(quality.PATH[:4])
    assert quality.choose_cutoffs([few, much]) == {("much", "symbols"): cut["symbols"]}
    worse = counts("worse", 400, none, lambda i: 3, lambda i: 3)  # as many good as bad ones: off
    assert quality.choose_cutoffs([worse]) == {}
    flat = counts("flat", 400, none, none, lambda i: 7)  # nothing is won by strictness: the loosest
    assert quality.choose_cutoffs([flat])["flat", "symbols"] == quality.PATH[0][1]
    assert quality.choose_cutoffs([]) == {}


@pytest.mark.parametrize(("n", "certified"), [(86, True), (85, False)])
def test_documents_that_certify(n, certified):
    """Four strata, no false rejection, a risk of 5 %."""
    some = [counts(str(s), n, lambda i: 0, lambda i: 0, lambda i: 1) for s in range(4)]
    assert bool(quality.choose_cutoffs(some)) == certified


def test_risk_is_controlled_on_other_documents():
    """With a path whose fifth step loses 8 % of good documents, hardly any draw of labels certifies it."""
    import random

    rng, wrong = random.Random(4), 0
    for _ in range(300):
        losses = [sum(rng.random() < p for _ in range(300)) for p in (0.0, 0.0, 0.01, 0.02)]
        bad_step = losses[-1] + sum(rng.random() < 0.06 for _ in range(300))
        c = counts("s", 300, lambda i: losses[i] if i < 4 else bad_step, lambda i: 0, lambda i: i + 1)  # noqa: B023
        wrong += quality.choose_cutoffs([c]).get(("s", "symbols"), 1.0) < quality.PATH[3][1]
    assert wrong <= 300 * 0.05


def test_clashing_names_of_any_case(spark):
    df = spark.createDataFrame([(1, "a b", "en", 5, True)], "doc_id long, text string, lang string, N_Words int, KEPT boolean")
    got = quality.quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert got["n_words"] == 2 and got["kept"] is False and got["text"] == "a b"
