"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches, and token counts by a digest cache.

Texts are cut where no token can cross: before a single white-space character that leads a run of other characters.
Each distinct piece is encoded once in a worker and its ids are kept, packed, in a bounded memo; a text's ids are its
pieces' ids joined. Bytes stand in the library's vocabulary as printable characters (the byte table); decoding goes
from ids through that table back to bytes, so characters split over several tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, carried, carried_columns, carried_fields, documents, rows, shared_dir, stored, text_bytes, texts_of, with_text

#: White space as the tokenizers' pattern sees it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How patterns end that let no match cross from a piece into the next.
WHITE = r"|\s+(?!\S)|\s+"
PIECES = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: What else a pattern that lets texts be cut may hold: alternatives of letters after an apostrophe, of character properties
#: and of classes without white space, with a space before them at most.
_TIGHT = re.compile(r"(?: \??)?(?:'[a-z]+|(?:\\p\{[A-Z][a-z]?\}|\[\^\\s(?:\\p\{[A-Z][a-z]?\})*\])[+*?]?)+")


def parts_at_spaces(pattern: str) -> bool:
    """Whether no match of a pattern goes on over white space into other characters, or from them into white space."""
    return pattern.endswith(WHITE) and all(_TIGHT.fullmatch(x) for x in pattern[: -len(WHITE)].split("|"))


def byte_characters() -> list[str]:
    """The byte table: for each byte the character that stands for it; printable ones stand for themselves, the others
    are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer with the ids that merging by rank gives: every cut of a token into two tokens is a merge, in
    the order of the merged token's rank; a whole match that is a token stays one."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(shown[a], shown[b]) for a, b in sorted(cuts, key=lambda ab: (ranks[ab[0]], ranks[ab[1]]))]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id: the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


class PieceEncoder:
    """Packed ids (little-endian unsigned 32-bit) of texts. memo: a piece's packed ids; emptied at BOUND bytes (what Python
    needs for an entry included). Pieces of over LONG characters, such as whole texts of scripts without spaces, are
    encoded anew each time."""

    BOUND, LONG, ENTRY = 48 << 20, 256, 180

    def __init__(self, tokenizer, whole: tuple[str, ...] = (), cut: bool = True):
        """whole: strings that the tokenizer treats apart; texts with one are encoded uncut. cut: whether the tokenizer lets
        texts be cut at white space at all."""
        self.tokenizer, self.memo, self.held, self.whole, self.cut = tokenizer, {}, 0, whole, cut

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        cut = [PIECES.findall(t) if self.cut and not any(s in t for s in self.whole) else None for t in texts]
        wanted = set().union(*(c for c in cut if c is not None))
        if self.held > self.BOUND:
            self.memo, self.held = {}, 0
        memo, long, unknown = self.memo, {}, list(wanted.difference(self.memo))
        for at in range(0, len(unknown), 4096):
            some = unknown[at : at + 4096]
            for piece, ids in zip(some, self._encode(some), strict=True):
                if len(piece) > self.LONG:
                    long[piece] = ids
                else:
                    memo[piece] = ids
                    self.held += self.ENTRY + len(piece) + len(ids)
        pick = (lambda p: long[p] if p in long else memo[p]) if long else memo.__getitem__
        return [self._encode([t])[0] if c is None else b"".join([pick(p) for p in c]) for t, c in zip(texts, cut, strict=True)]


class SentencePieces:
    """As PieceEncoder, of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.model.encode(t, add_bos=False, add_eos=False), "<u4").tobytes() for t in texts]


def offsets(packed: bytes, sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) character of each token of a text: from its tokens' byte lengths through the map of
    bytes to characters. A token that holds part of a character has the whole of it in its span."""
    ends = np.cumsum(sizes[np.frombuffer(packed, "<u4")])
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # 1 + the character that a byte belongs to
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return (char[starts] - 1, char[ends - 1]) if len(ends) else (starts, ends)


_ENCODERS: dict[tuple, tuple] = {}  # a worker loads a vocabulary once


def rank_encoder(path: str, pattern: str) -> tuple[PieceEncoder, list[bytes]]:
    if (path, pattern) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = tokenizer_of_ranks(read_ranks(path), pattern)
        _ENCODERS[path, pattern] = PieceEncoder(made, cut=parts_at_spaces(pattern)), token_bytes(made)
    return _ENCODERS[path, pattern]


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is byte-level with the usual pattern and nothing before it, so that no token crosses from
    one piece into the next."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    first = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)


def file_encoder(path: str) -> PieceEncoder | SentencePieces:
    """For .json files of the tokenizers library and .model files of sentencepiece."""
    if (path,) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            _ENCODERS[(path,)] = (SentencePieces(path),)
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            _ENCODERS[(path,)] = (PieceEncoder(made, tuple(t.content for t in made.get_added_tokens_decoder().values()), cuts_at_spaces(path)),)
    return _ENCODERS[(path,)][0]


def groups(values: list, size: Callable, most: int = 1 << 21) -> Iterator[list]:
    """values in runs of about `most` in size."""
    run, n = [], 0
    for v in values:
        run.append(v)
        n += size(v)
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def encode(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str], ids: bool = True, spans: bool = False, decoded: bool = False, digests: bool = False) -> DataFrame:
    """carry and, as asked for, of every row's text: n_tokens; ids; starts, ends (characters of each token); decoded
    (bytes that the ids decode to); ids_sha256, decoded_sha256. Null text: as empty, no tokens. Any row stands for itself:
    repeated rows come out repeated; very long texts are encoded whole; no rows: no rows; columns of docs named as ours
    give way."""
    extra = [T.StructField("n_tokens", T.LongType())]
    extra += [T.StructField("ids", T.ArrayType(T.LongType()))] * ids
    extra += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends")] * spans
    extra += [T.StructField("decoded", T.BinaryType())] * decoded
    extra += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")] * digests
    carry = carried(carry, [f.name for f in extra])
    given = with_text(docs, carry)
    schema = T.StructType([*carried_fields(docs, carry), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, back = rank_encoder(ranks_path, pattern)
        sizes = np.array([len(x) for x in back] or [0])
        for b in rows(batches):
            at, own = 0, carried_columns(b, carry)
            for data in groups(texts_of(b), len):
                found = encoder.packed([x.decode("utf-8", "replace") for x in data])
                cols = [pa.array([len(p) // 4 for p in found], pa.int64())]
                if ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4") for p in found], pa.list_(pa.int64())))
                if spans:
                    both = [offsets(p, sizes, x) for p, x in zip(found, data, strict=True)]
                    cols += [pa.array([x[i] for x in both], pa.list_(pa.int64())) for i in (0, 1)]
                if decoded or digests:
                    texts = [b"".join([back[i] for i in np.frombuffer(p, "<u4").tolist()]) for p in found]
                    cols += [pa.array(texts, pa.binary())] * decoded
                if digests:
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (found, texts)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(data)) for c in own), *cols], schema.names)
                at += len(data)

    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, carry: list[str], column: str = "ids") -> DataFrame:
    """carry and text: what the ids of column decode to; null ids: null. Byte sequences that are no UTF-8 become U+FFFD."""
    given = encoded.select(*[F.col(f"`{c}`") for c in carry if c != "text"], F.col(f"`{column}`").alias("__ids"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = rank_encoder(ranks_path, pattern)[1]
        for b in rows(batches):
            texts = [None if x is None else b"".join([back[i] for i in x]).decode("utf-8", "replace") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return given.mapInArrow(run, schema)


# --- token counts by a digest cache -----------------------------------------------------------------------------------

CACHE_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: the digest of its file and of the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def count_tokens(docs: DataFrame, path: str, cache: str, carry: list[str]) -> DataFrame:
    """carry, n_bytes and n_tokens of every row's whole text, by a cache of counts.

    The cache is a Parquet table at `cache` (made if missing) keyed by the digests of tokenizer and content. Content is
    normalised only where that can't change a count: null is as empty. Texts whose digest is not stored are encoded once
    for each digest and their counts appended; then every row's digest is joined to its count. Copies are dropped before
    the shuffle in each task and after it, so a text that a third of all rows have is sent once by each task. Repeated
    rows come out repeated; no rows: no rows, and nothing is appended.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    carry = carried(carry, ("n_bytes", "n_tokens"))
    bounded(spark)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    known = (spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    digest = F.unhex(F.sha2(text_bytes(), 256))
    texts = docs.select(digest.alias("digest"), text_bytes().alias("bytes"))
    if there:
        texts = texts.join(known.select("digest"), "digest", "left_anti")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            fresh = []
            for d in b.column(0).to_pylist():
                fresh.append(d not in seen)
                seen.add(d)
            if len(seen) > 1_000_000:  # forgetting only sends a copy more
                seen.clear()
            yield b.filter(pa.array(fresh, pa.bool_()))

    def encode_missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = file_encoder(path), None
        for b in rows(batches):
            digests, data = [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d != last:  # sorted within the partition
                    digests.append(d)
                    data.append(x)
                    last = d
            counts = [len(p) // 4 for g in groups(data, len) for p in encoder.packed([x.decode("utf-8", "replace") for x in g])]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(data), pa.string()), pa.array(digests, pa.binary()), pa.array(map(len, data), pa.int64()), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_bytes", "n_tokens"])

    missing = texts.mapInArrow(once, texts.schema).repartition("digest").sortWithinPartitions("digest").mapInArrow(encode_missing, CACHE_SCHEMA)
    missing.write.mode("append").parquet(cache)
    # one row for each digest, whoever else appends; written, so that the join's plan is free to split a digest that many rows have
    once_each = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(once_each, "token-counts")
    keyed = docs.select(*[F.col(f"`{c}`") for c in carry], digest.alias("__digest"), F.octet_length(text_bytes()).cast("long").alias("n_bytes"))
    found = keyed.join(counts.withColumnRenamed("digest", "__digest"), "__digest")
    return found.select(*[F.col(f"`{c}`") for c in carry], "n_bytes", "n_tokens")


RANKS, TOKENIZER, LIMIT = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", 1024


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = documents(spark, sf_dir)
    return encode(docs, P.path(RANKS), P.PATTERN, ["doc_id"], ids=False, digests=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers as P

    cache = f"{shared_dir(spark)}/docloom/token-counts-{uuid.uuid4().hex}"  # a new cache: every count is made here
    found = count_tokens(documents(spark, sf_dir), P.path(TOKENIZER), cache, ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
