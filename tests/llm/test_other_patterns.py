"""Encoding by patterns that let a match hold white space after other characters."""

import public_tokenizers as P
import pytest
import tiktoken

from docloom.llm import bpe

NEWER = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
TEXTS = ["end.\n\nNext", "foo();\n}", "a  b\n\n c", "don't 12345 x\n", "", "tab\tword  \n\n\tend ;\n", "é ü x …\n…"]


@pytest.mark.parametrize("pattern", [P.PATTERN, NEWER, r" ?[^\s]+|\s+(?!\S)|\s+", r"\p{L}+\s?|[^\p{L}]|\s+(?!\S)|\s+"])
def test_ids_are_those_of_whole_texts(spark, pattern):
    path = P.path(bpe.RANKS)
    ranks = bpe.read_ranks(path)
    whole = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, path, pattern, ["doc_id"]).collect()}
    assert got == {i: whole.encode_ordinary(t) for i, t in enumerate(TEXTS)}


def test_which_patterns_let_texts_be_cut():
    assert bpe.parts_at_spaces(P.PATTERN) and bpe.parts_at_spaces(r" ?[^\s]+|\s+(?!\S)|\s+")
    for no in (NEWER, r"\p{L}+\s?|\s+(?!\S)|\s+", r"[^\p{L}]+|\s+(?!\S)|\s+", r"\p{L}+", r".+|\s+(?!\S)|\s+"):
        assert not bpe.parts_at_spaces(no)


def test_a_very_long_text_and_no_rows(spark):
    text = "Some words, 123 and more.\n" * 800_000
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    encoder = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.RANKS)), special_tokens={})
    line = len(encoder.encode_ordinary("Some words, 123 and more.\n" * 2)) - len(encoder.encode_ordinary("Some words, 123 and more.\n"))
    rows = {r.doc_id: r.n_tokens for r in bpe.encode(df, P.path(bpe.RANKS), P.PATTERN, ["doc_id"], ids=False).collect()}
    assert rows[2] == 0 and abs(rows[1] - line * 800_000) < 5
    assert bpe.encode(df.limit(0), P.path(bpe.RANKS), P.PATTERN, ["doc_id"]).collect() == []
