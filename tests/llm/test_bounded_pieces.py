"""What bounds memory and work changes no result."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe, common, licenses, simhash

from .test_text_operators import brute_components


def linked(fps, src, dst):
    """Component of each fingerprint under the links."""
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        root[find(a)] = find(b)
    return [find(x) for x in fps]


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("large", [1, 8, 64, 10_000])
def test_large_buckets_are_parted(large, monkeypatch):
    rng = random.Random(large)
    monkeypatch.setattr(simhash, "LARGE", large)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 5, 60))):
            x = centre
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    src, dst = simhash.forest(np.array(fps, np.uint64), 4)
    assert (np.bitwise_count(src ^ dst) <= 4).all()
    assert same_parts(linked(fps, src, dst), brute_components(list(enumerate(fps))))


def test_unlinked_bucket_has_no_links():
    fps = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 5000, np.uint64, endpoint=False))
    src, dst = simhash.forest(fps, 4)
    assert len(src) == len(dst) == 0


def test_memo_is_bounded_by_bytes():
    whole = Tokenizer.from_file(P.path(bpe.TOKENIZER))
    encoder = bpe.PieceEncoder(whole)
    encoder.BOUND = 20_000
    rng, most = random.Random(1), 0
    for _ in range(60):
        texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(10)] + ["あ" * 5000 + str(rng.random()), "x" * 300 + " y"]
        for t, p in zip(texts, encoder.packed(texts), strict=True):
            assert np.frombuffer(p, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
        most = max(most, encoder.held)
        assert all(len(piece) <= encoder.LONG for piece in encoder.memo)
    assert most < 20_000 + 200 * 260


def test_tokenizers_that_do_not_cut_at_spaces():
    """Files with another way of parting texts are used on whole texts; sentencepiece models too."""
    import sentencepiece

    texts = ["Two  words and\n a line", " leading", "", "naïve café ☃", "a <|endoftext|> b"]
    word = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(word)
    encoder = bpe.file_encoder(word)
    assert encoder.cut == bpe.cuts_at_spaces(word) and bpe.cuts_at_spaces(P.path(bpe.TOKENIZER))
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder.packed(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe.file_encoder(P.path("piece_bpe_32k.model")).packed(texts)] == [model.encode(t) for t in texts]


def test_batches_of_a_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for key, ours in common.BATCH.items():
        spark.conf.unset(key)
        common.bounded(spark)
        assert spark.conf.get(key) == ours
        spark.conf.set(key, "10000")  # a value that the user has set stays, also Spark's own default
        common.bounded(spark)
        assert spark.conf.get(key) == "10000"
        spark.conf.unset(key)


def brute_scan(templates, words, coverage):
    """Best coverage of each long template over every stretch, none left out beforehand."""
    out = {}
    for name, text in templates.items():
        template = licenses.words_of(text.encode())
        m, best = len(template), 0.0
        for start in range(0, len(words), m):
            best = max(best, len(licenses.patience(words[start : start + 2 * m], template)) / m)
        if best >= (coverage if m >= licenses.SHORT else 1.0):
            out[name] = best
    return out


def test_scanner_finds_what_every_stretch_gives():
    rng = random.Random(7)
    templates = {f"t{i}": " ".join(f"v{rng.randrange(60)}" for _ in range(rng.choice((6, 25, 40, 90)))) for i in range(6)}
    scanner = licenses.Scanner(templates)
    for _ in range(60):
        words = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(80))]
        for name in rng.sample(sorted(templates), 2):
            copy = [w for w in templates[name].split() if rng.random() > 0.1]
            for _ in range(rng.randrange(6)):
                copy.insert(rng.randrange(len(copy) + 1), f"v{rng.randrange(60)}")
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        got = {name: c for name, c, *_ in scanner.scan(" ".join(words).encode())}
        assert got == pytest.approx(brute_scan(templates, [w.encode() for w in words], licenses.COVERAGE))


def test_ties_of_licenses(spark):
    """Equal coverage: the longer template, then the first by name."""
    df = spark.createDataFrame([(1, "one two three four five"), (2, "alpha beta")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.license_scan(df, ["doc_id"], {"b": "two three", "a": "four five", "c": "one two three", "z": "alpha beta", "y": "Alpha, beta!"}).collect()}
    assert (rows[1].license, rows[1].n_licenses, rows[1].licenses) == ("c", 3, "a,b,c") and (rows[2].license, rows[2].licenses) == ("y", "y,z")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the GPL License", []), ("Released under the Apache License", []), ("Creative Commons Attribution-NonCommercial 4.0 International", []),
        ("Licensed under the Foo License, Version 2.0", []), ("released under the supervision of the License board", []), ("Licensed under CC BY 4.0", ["CC-BY-4.0-short"]),
    ],
)
def test_names_decide(text, want):
    assert [x[0] for x in licenses.Scanner(licenses.TEMPLATES).scan(text.encode())] == want
