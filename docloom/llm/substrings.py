"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of one document. Documents are dealt into batches by a hash of doc_id; what batches
tell each other goes through shards:

1. Anchors. A window's anchor is the least of the hashes of its GRAM-word pieces, so equal windows have equal anchors and
   neighbouring windows mostly share theirs. Each batch sends its distinct anchors to shards, which answer with those that
   more than one document has. Only windows with such an anchor can recur.
2. Confirmation. Each batch sends the stretches of text that hold such windows, each distinct stretch once with its
   smallest and largest doc_id. A shard finds for each window the smallest doc_id that has it and answers a batch with
   the stretches whose windows begin in a smaller doc_id than some document of the batch has. Stretches travel packed and
   compressed, one row for each batch and shard.
3. Automata. Each batch compiles the answered phrases into Aho-Corasick automata over words and streams its documents
   through them; a hit is confirmed word by word against the phrases' windows.

A passage that a third of all documents share is one entry for each batch in every exchange, and its stretches are spread
over the shards; with batch_bytes so large that batches are at most some hundred thousand, such an entry stays small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, carried_columns, carried_fields, covered, table, text_size, texts_of, window_hashes, with_text, word_hashes, word_spans

WINDOW, GRAM, MAX = 13, 6, (1 << 63) - 1
OURS = ("n_words", "n_removed", "kept_words", "kept_text")
#: Bytes of text in a batch, and for each shard; phrases in an automaton.
BATCH_BYTES, SHARD_BYTES, AUTOMATON = 8 << 20, 16 << 20, 100_000


def window_anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of every window, from the word hashes of a text."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = window_hashes(h, gram)
    out = g[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(out, g[i : n + i], out=out)
    return out


def _documents(batch: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    for chunk in batch.select(["__id", "__text"]).to_batches(max_chunksize=256):
        yield from zip(chunk.column(0).to_pylist(), texts_of(chunk), strict=True)


def packed(texts: list[bytes], *numbers: np.ndarray) -> bytes:
    """Texts without line ends and arrays of long, compressed."""
    sizes = np.array([len(texts), *map(len, numbers)], np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(x.astype(np.int64).tobytes() for x in numbers), b"\n".join(texts)]), 1)


def unpacked(blob: bytes, arrays: int) -> tuple:
    data = zstandard.decompress(blob)
    n, *sizes = np.frombuffer(data, np.int64, 1 + arrays).tolist()
    at, out = 8 * (1 + arrays), []
    for size in sizes:
        out.append(np.frombuffer(data, np.int64, size, at))
        at += 8 * size
    return (data[at:].split(b"\n") if n else [], *out)


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def send_anchors(batch: pa.Table, b: int, shards: int, window: int, gram: int) -> pa.Table:
    ids, anchors = [], []
    for doc_id, data in _documents(batch):
        if doc_id is not None and len(found := np.unique(window_anchors(word_hashes(data), window, gram))):
            ids.append(np.full(len(found), doc_id, np.int64))
            anchors.append(found)
    if not anchors:
        return pa.table({"p": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    anchor, doc = np.concatenate(anchors), np.concatenate(ids)
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    anchor = anchor[first]
    shard = _shard(anchor, shards)
    rows = [(int(p), anchor[m := shard == p].tobytes() + many[m].tobytes()) for p in np.unique(shard)]
    return pa.table({"p": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([b] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def answer_anchors(sent: pa.Table) -> pa.Table:
    """For each batch its anchors that more than one document has."""
    batches, parts, many = sent["b"].to_pylist(), [], []
    for blob in sent["blob"].to_pylist():
        n = len(blob) // 9
        parts.append(np.frombuffer(blob, np.uint64, n))
        many.append(np.frombuffer(blob, bool, n, 8 * n))
    anchor = np.concatenate(parts)
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    recurs = np.concatenate(many)
    first = np.flatnonzero(np.r_[True, ~same])
    recurs[order] = np.repeat(np.logical_or.reduceat(recurs[order], first) | (np.diff(np.r_[first, len(anchor)]) > 1), np.diff(np.r_[first, len(anchor)]))
    out, at = [], 0
    for b, part in zip(batches, parts, strict=True):
        if (m := recurs[at : at + len(part)]).any():
            out.append((b, part[m].tobytes()))
        at += len(part)
    return pa.table({"b": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})


def send_stretches(batch: pa.Table, answers: pa.Table, b: int, shards: int, window: int, gram: int) -> pa.Table:
    found: dict[int, dict[bytes, list[int]]] = {}  # by shard
    if answers.num_rows:
        recurring = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in answers["blob"].to_pylist()]))
        for doc_id, data in _documents(batch):
            if doc_id is None or not len(anchor := window_anchors(word_hashes(data), window, gram)):
                continue
            at = np.minimum(np.searchsorted(recurring, anchor), len(recurring) - 1)
            hit = recurring[at] == anchor
            if not hit.any():
                continue
            begins, ends = (x.tolist() for x in word_spans(data))
            edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            stop = np.r_[edge[1:], len(anchor)]
            picked = hit[edge]
            for s, e, p in zip(edge[picked].tolist(), stop[picked].tolist(), _shard(anchor[edge[picked]], shards).tolist(), strict=True):
                own = found.setdefault(p, {})
                while s < e:  # repeats in a text can chain windows of one anchor; a stretch has the windows that share it
                    upto = min(e, s + window - gram + 1)
                    words = b" ".join(data[begins[s] : ends[upto + window - 2]].split())
                    if (known := own.get(words)) is None:
                        own[words] = [doc_id, doc_id]
                    elif doc_id < known[0]:
                        known[0] = doc_id
                    elif doc_id > known[1]:
                        known[1] = doc_id
                    s = upto
    blobs = []
    for own in found.values():
        span = np.array(list(own.values()), np.int64)
        blobs.append(packed(list(own), span[:, 0], span[:, 1]))
    return pa.table({"p": pa.array(found, pa.int32()), "b": pa.array([b] * len(found), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def answer_stretches(sent: pa.Table, window: int) -> pa.Table:
    """Stretches with, for each of their windows, the smallest doc_id that has it; only those that some document of the
    batch has after it. Windows are told apart by 64-bit hashes here, word by word in the automata."""
    wh, counts, first, last = [], [], [], []
    for blob in sent["blob"].to_pylist():
        some, a, b = unpacked(blob, 2)
        sizes = np.fromiter((x.count(b" ") + 1 for x in some), np.int64, len(some))
        h = window_hashes(word_hashes(b" ".join(some)), window)
        n = sizes - window + 1  # windows of each stretch
        wh.append(h[np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        counts.append(n)
        first.append(np.repeat(a, n))
        last.append(np.repeat(b, n))
    hashes = np.concatenate(wh)
    order = np.argsort(hashes, kind="stable")
    edge = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    least = np.empty(len(hashes), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(np.concatenate(first)[order], edge), np.diff(np.r_[edge, len(hashes)]))
    least[least >= np.concatenate(last)] = np.iinfo(np.int64).max  # no document of the batch has it after another
    out, at = [], 0
    for b, blob, n in zip(sent["b"].to_pylist(), sent["blob"].to_pylist(), counts, strict=True):
        own = least[at : at + n.sum()]
        at += len(own)
        use = np.minimum.reduceat(own, np.cumsum(n) - n) < np.iinfo(np.int64).max
        if use.any():
            texts = unpacked(blob, 2)[0]
            out.append((b, packed([texts[i] for i in np.flatnonzero(use).tolist()], own[np.repeat(use, n)])))
    return pa.table({"b": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})


class Phrases:
    """Automata over the words of phrases. A pattern is GRAM words that all windows of a phrase share.

    A word is written as DIGITS characters, each place with an alphabet of its own: the library looks a character up among
    a node's children one by one, so few children make it fast, and hits can't begin within a word."""

    DIGITS = 3

    def __init__(self, phrases: list[bytes], firsts: np.ndarray, window: int, gram: int = GRAM):
        """firsts: for each window of each phrase the smallest doc_id that has it."""
        import ahocorasick

        distinct = sorted(set().union(*(x.split(b" ") for x in phrases)))
        base = next(b for b in range(2, 1 << 16) if b**self.DIGITS > len(distinct))
        letter = [chr(x if x < 0xD800 else x + 0x800) for x in range(1 + self.DIGITS * base)]
        self.window, self.gram, self.nothing = window, gram, "\0" * self.DIGITS
        self.codes = {w: "".join(letter[1 + d * base + i // base**d % base] for d in range(self.DIGITS)) for i, w in enumerate(distinct)}
        self.firsts: dict[str, int] = {}
        patterns: set[str] = set()
        size, d, codes, known = window * self.DIGITS, self.DIGITS, self.codes, self.firsts
        left = iter(firsts.tolist())
        for words in phrases:
            text = "".join([codes[w] for w in words.split(b" ")])
            patterns.add(text[len(text) - size : len(text) - size + gram * d])
            for at in range(0, len(text) - size + 1, d):
                if (first := next(left)) < MAX and first < known.get(key := text[at : at + size], MAX):
                    known[key] = first
        self.automata, todo = [], sorted(patterns)
        for at in range(0, len(todo), AUTOMATON):
            made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in todo[at : at + AUTOMATON]:
                made.add_word(p)
            made.make_automaton()
            self.automata.append(made)

    def removed(self, words: list[bytes], doc_id: int) -> np.ndarray:
        """Mask of the words covered by windows that a smaller doc_id has."""
        get, w, g, d, nothing, known = self.codes.get, self.window, self.gram, self.DIGITS, self.nothing, self.firsts.get
        text = "".join([get(x, nothing) for x in words])
        starts, top, size = [], len(words) - w, w * d
        for made in self.automata:
            tried = -1
            for end, _ in made.iter(text):
                last = end // d  # the last word of the hit
                for s in range(max(0, tried + 1, last - w + 1), min(last - g + 1, top) + 1):
                    tried = s
                    if known(text[s * d : s * d + size], doc_id) < doc_id:
                        starts.append(s)
        return covered(np.array(starts, np.int64), w, len(words)) if starts else np.zeros(len(words), bool)


GAPS = re.compile(rb"[\x20\x09-\x0D]+")


def without(data: bytes, gone: np.ndarray) -> bytes:
    """A text without the words that are gone and the white space after each."""
    at = 0 if not (m := GAPS.match(data)) else m.end()
    out, i = [data[:at]], 0
    for m in GAPS.finditer(data, at):
        if not gone[i]:
            out.append(data[at : m.end()])
        at, i = m.end(), i + 1
    if at < len(data) and not gone[i]:
        out.append(data[at:])
    return b"".join(out)


def dedup_substrings(docs: DataFrame, carry: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES, give: tuple[str, ...] = OURS) -> DataFrame:
    """carry (all columns by default) and give of every row of docs (doc_id, text): n_words, n_removed, kept_words (the kept
    words joined by one space) and kept_text (the text without the removed words and the white space after each).

    A word is removed if a window that covers it also begins in a document with a smaller doc_id. Null, empty and short
    texts have no window and lose nothing (null counts as empty; its kept_text is null). Rows of one doc_id count as one
    document: they don't remove each other's words. A null doc_id neither removes nor loses words. Very long texts are
    searched whole, a batch of their own; no rows: no rows. Columns of docs named as ours give way. Rows are dealt by a
    hash of doc_id and text, so only rows that repeat in both meet in a batch.
    """
    carry = carried(docs.columns if carry is None else carry, OURS)
    size = text_size(docs)
    spread = min(4 * docs.sparkSession.sparkContext.defaultParallelism, size >> 20)  # so that small inputs use every core
    batches, shards = max(1, -(-size // batch_bytes), spread), -(-size // shard_bytes) or 1
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("__b")
    given = with_text(docs, carry, F.col("doc_id").cast("long").alias("__id"), deal)
    kinds = dict(zip(OURS, (T.LongType(), T.LongType(), T.StringType(), T.StringType()), strict=True))
    schema = T.StructType([*carried_fields(docs, carry), *(T.StructField(n, kinds[n]) for n in give)])
    dealt = given.groupBy("__b")

    def anchors(key, batch):
        return send_anchors(batch, key[0].as_py(), shards, window, gram)

    def stretches(key, batch, answers):
        return send_stretches(batch, answers, key[0].as_py(), shards, window, gram)

    def remove(key, batch, phrases):
        sent = [unpacked(x, 1) for x in phrases["blob"].to_pylist()]
        known = Phrases([x for texts, _ in sent for x in texts], np.concatenate([np.empty(0, np.int64), *(f for _, f in sent)]), window, gram)
        del sent
        cols: dict[str, list] = {n: [] for n in OURS}
        for doc_id, data in _documents(batch):
            words = data.split()
            gone = known.removed(words, doc_id) if known.automata and doc_id is not None and len(words) >= window else None
            n = int(gone.sum()) if gone is not None else 0
            cols["n_words"].append(len(words))
            cols["n_removed"].append(n)
            if "kept_words" in give:
                cols["kept_words"].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words))
            if "kept_text" in give:
                cols["kept_text"].append(without(data, gone) if n else data)
        made = {n: pa.array(cols[n], pa.int64()) if kinds[n] == T.LongType() else pa.array(cols[n], pa.binary()).cast(pa.string()) for n in give}
        if "kept_text" in give:
            made["kept_text"] = pc.if_else(pc.is_null(batch["__text"].combine_chunks()), pa.scalar(None, pa.string()), made["kept_text"])
        return pa.Table.from_arrays([*carried_columns(batch, carry), *made.values()], names=[*carry, *give])

    sent = dealt.applyInArrow(anchors, "p int, b int, blob binary")
    answers = sent.groupBy("p").applyInArrow(lambda x: answer_anchors(x), "b int, blob binary")
    told = dealt.cogroup(answers.groupBy("b")).applyInArrow(stretches, "p int, b int, blob binary")
    phrases = told.groupBy("p").applyInArrow(lambda x: answer_stretches(x, window), "b int, blob binary")
    return dealt.cogroup(phrases.groupBy("b")).applyInArrow(remove, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), ["doc_id"], give=("n_words", "n_removed", "kept_words"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
win AS (SELECT i.doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS t FROM i JOIN w ON w.doc_id = i.doc_id),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ') ELSE coalesce((SELECT string_agg(ws[k], ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(ws) + 1)) AS k) WHERE NOT list_contains(js, k)), '') END) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""
