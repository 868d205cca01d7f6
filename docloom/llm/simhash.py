"""SimHash near-dedup: pigeonhole blocks, then exact Hamming distance, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows, stored, texts_of, with_text
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints at DISTANCE or less share at least BLOCKS - DISTANCE of BLOCKS blocks; every choice of so many blocks is
#: a key. 6 blocks: 15 keys of about 21 bits, for some ten million texts; 8 blocks: 70 keys of 32 bits, for billions.
BLOCKS = 6


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text: a bit is 1 if over half of its shingles' XXH64 have it; no words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        starts, stops, digest = [0, *(ends[:-size] + 1).tolist()], ends[size - 1 :].tolist(), xxhash.xxh64_digest
        digests = [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 16):
        bits = np.unpackbits(np.frombuffer(b"".join(digests[at : at + (1 << 16)]), np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every row; null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            fps = np.array([fingerprint(x) for x in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return with_text(docs, [], F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks - distance of the blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(x)).view(np.int64)) for x in combinations(one, blocks - distance)]


LARGE = 2048  # fingerprints of a bucket that are compared one with all; larger ones are parted first


def parts_of(fps: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Parts of a bucket of which some holds both of any two at `distance` or less: the bits in which its fingerprints differ
    are dealt into distance + 1 blocks, and two so near are equal in one of them."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << i for i in range(64) if differ >> i & 1]
    for i in range(distance + 1):
        block = fps & np.uint64(sum(bits[i :: distance + 1]))
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order])) + 1
        yield from (x for x in np.split(fps[order], edges) if len(x) > 1)


def forest(fps: np.ndarray, distance: int, large: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links of at most distance between fps connect; not more than one for each of fps, or
    distance + 1 where they are parted first."""
    large = LARGE if large is None else large
    src, dst, rest = [fps[:0]], [fps[:0]], fps
    if len(fps) > large:
        found = [forest(x, distance, len(x)) for x in parts_of(fps, distance)]  # parted once: parts of linked ones overlap
        return tuple(np.concatenate([fps[:0], *x]) for x in zip(*found, strict=True)) if found else (fps[:0], fps[:0])
    while len(rest):
        frontier, rest = [rest[:1]], rest[1:]
        while frontier and len(rest):
            for x in frontier.pop():
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    found, rest = rest[near], rest[~near]
                    src.append(np.full(len(found), x))
                    dst.append(found)
                    frontier.append(found)
    return np.concatenate(src), np.concatenate(dst)


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int, small: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within buckets; rows are sorted by key, fp are distinct in a bucket."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    few = np.repeat(sizes <= small, sizes)
    for j in range(1, min(small, int(sizes.max(initial=1)))):
        near = (key[j:] == key[:-j]) & few[j:]
        near[near] = np.bitwise_count(fp[j:][near] ^ fp[:-j][near]) <= distance
        if near.any():
            yield fp[:-j][near], fp[j:][near]
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        yield forest(fp[s : s + n], distance)


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """src, dst: links between the distinct fingerprints of fps (column fp), enough of them that their connected
    components are those of all pairs at `distance` or less. A bucket holds 8 bytes for each distinct fingerprint."""
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("combo", "mask")).select(F.xxhash64("combo", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fp):
            if found := [x for x in bucket_links(key, fp, distance) if len(x[0])]:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []  # the rows since the last complete bucket
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # sorted within the partition
            if parts and (cut or parts[0][0][0] != key[-1]):
                if cut:
                    parts.append((key[:cut], fp[:cut]))
                yield from out(*map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            elif cut:
                yield from out(key[:cut], fp[:cut])
            parts.append((key[cut:], fp[cut:]))
        if parts:
            yield from out(*map(np.concatenate, zip(*parts, strict=True)))

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    Fingerprints of null, empty and blank texts are 0 and link like any other. Rows of one fingerprint are one node,
    however many; repeated rows come out repeated. A null doc_id takes part but is never a component's id unless all
    are null. Very long texts are hashed whole, in pieces. Empty input: no rows. Further columns of docs are ignored.
    """
    fps = stored(fingerprints(docs), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(links(nodes.select("fp"), distance, blocks))
    named = stored(nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "components")
    ids = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")  # written, so that the join can split a root that many have
    member = named.join(ids, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(member, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
