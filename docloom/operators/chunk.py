"""Cutting texts into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SIZE, OVERLAP = 800, 150
BREAK = re.compile(r"\n{2,}")
SENTENCE = re.compile(r"[.!?][\"')\]]*\s+")
SPACES = " \t\n\r\v\f" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
HEADING = re.compile("[#A-Z]")


def heading_of(text: str) -> str | None:
    line = text.split("\n", 1)[0].strip(SPACES)
    return line if len(line) <= 120 and HEADING.match(line) else None


def chunk_text(text: str | None, max_size: int = MAX_SIZE, overlap: int = OVERLAP, heading: str | None = None) -> list[tuple[str, int, int, str | None]]:
    """(text, start, end, heading) of each chunk; offsets into the text with \\n line ends and both ends trimmed, the end
    exclusive. A chunk ends, in order of preference, with the text, at the last paragraph break or sentence end before
    max_size, at the first sentence end up to `overlap` beyond it, or at max_size."""
    if max_size <= 0:
        raise ValueError("max_size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= max_size:
        raise ValueError("overlap must be smaller than max_size")
    source = re.sub(r"\r\n?", "\n", text or "").strip(SPACES)
    size, start, out = len(source), 0, []
    while start < size:
        hard = min(start + max_size, size)
        end, limit = _end(source, start, hard, min(start + max_size + overlap, size))
        body = source[start:end].rstrip(SPACES)
        if not body:
            start = limit
            continue
        stop = start + len(body)
        if out and stop <= out[-1][2]:
            start = stop
            continue
        out.append((body, start, stop, heading_of(body) or heading))
        if end >= size:
            break
        start = end - overlap if end - overlap > start else end
    return out


def _end(source: str, start: int, hard: int, far: int) -> tuple[int, int]:
    if hard == len(source):
        return hard, hard
    last, stop = None, hard
    while stop < len(source) and source[stop - 1] == source[stop] == "\n":  # a break that begins before hard is taken whole
        stop += 1
    for m in BREAK.finditer(source, start, stop):
        if start < m.start() < hard:
            last = m.end()
    if last is not None:
        return last, hard
    ends = [m.end() for m in SENTENCE.finditer(source[start:hard])]
    if ends and ends[-1] > 0:
        return start + ends[-1], hard
    if m := SENTENCE.search(source[hard:far]):
        return hard + m.end(), far
    return hard, hard


SCHEMA = [T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType()), T.StructField("heading", T.StringType())]


def chunk_documents(docs: DataFrame, carry: list[str], max_size: int = MAX_SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """carry and, for each chunk of each row's text, chunk_index (from 0), text, start_offset, end_offset, heading,
    token_count. Texts are cut where they lie: no shuffle."""
    chunk_text("", max_size, overlap)  # bad parameters fail here
    given = docs.select(*carry, F.col(text).alias("__source"))
    schema = T.StructType([*given.schema.fields[:-1], *SCHEMA])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.iloc[at : at + 256]
                cut = [[(i, *c) for i, c in enumerate(chunk_text(t, max_size, overlap))] for t in b["__source"]]
                rows = b[carry].loc[b.index.repeat([len(c) for c in cut])].reset_index(drop=True)
                parts = pd.DataFrame([c for cs in cut for c in cs], columns=[f.name for f in SCHEMA])
                yield pd.concat([rows, parts], axis=1)

    return given.mapInPandas(run, schema).withColumn("token_count", F.ceil(F.length("text") / 4).cast("int"))
