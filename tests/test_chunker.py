"""The chunker on long texts, against its definition."""

import random
import time

from docloom.operators import chunk


def plain_end(source, start, hard, far):
    """The end of a chunk with every paragraph break of the rest of the text looked at."""
    if hard == len(source):
        return hard, hard
    breaks = [m.end() for m in chunk.BREAK.finditer(source, start) if start < m.start() < hard]
    if breaks:
        return breaks[-1], hard
    ends = [m.end() for m in chunk.SENTENCE.finditer(source[start:hard])]
    if ends and ends[-1] > 0:
        return start + ends[-1], hard
    m = chunk.SENTENCE.search(source[hard:far])
    return (hard + m.end(), far) if m else (hard, hard)


def test_breaks_are_those_of_the_whole_text(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(("word ", "end. ", "\n", "\n\n", "\n\n\n\n", "x" * rng.randrange(30), "! ")) for _ in range(300)) for _ in range(60)]
    sizes = [(rng.randrange(2, 120), 0) for _ in texts]
    got = [chunk.chunk_text(t, s, o) for t, (s, o) in zip(texts, sizes, strict=True)]
    more = [chunk.chunk_text(t, 80, 20) for t in texts]
    monkeypatch.setattr(chunk, "_end", plain_end)
    assert got == [chunk.chunk_text(t, s, o) for t, (s, o) in zip(texts, sizes, strict=True)] and more == [chunk.chunk_text(t, 80, 20) for t in texts]


def test_long_texts_take_linear_time():
    for text in ("word " * 1_000_000, "a sentence. " * 400_000, "x" * 5_000_000, "p\n\n" * 1_500_000):
        at = time.time()
        assert chunk.chunk_text(text)[-1][2] == len(text.strip())
        assert time.time() - at < 20
