"""SimHash near-dedup at a Jaccard similarity: wide fingerprints, joins on blocks of bits, Hamming distance, then full sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import rows, text_bytes, texts_of, with_text
from .copies import by_bucket, node_of, shingles

#: A fingerprint has WORDS longs. The first SCREEN of them go into the buckets, where they are compared first; all of them only
#: of what hangs together there in large groups.
WORDS, SCREEN = 16, 2
BITS = 64 * WORDS
MISS = 1e-6  # chance that a pair of just the similarity asked for shares no block, and that it is farther apart than a distance allows
CROWD = 10  # a bucket holds about 2^CROWD unlike fingerprints, or half as many
SMALL = 16  # fingerprints of a bucket that hang together of which every near pair is a candidate; of more each with the first
STRIP = 1 << 16  # distances of a bucket that are taken at once
_ODD = np.random.default_rng(2).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles: a bit is 1 if over half of their hashes have it."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(own), 255):  # so many votes fit a byte
        h = own[at : at + 255, None] * _ODD
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        votes += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(own)).view(np.uint64)


def differing(percent: int) -> float:
    """The share of bits in which fingerprints of equally many shingles differ at this similarity: the angle between the sets,
    over pi. Sets of unequal size differ in fewer."""
    return acos(2 * percent / (100 + percent)) / pi


def _chances(n: int, p: float) -> list[float]:
    """Of 0 to n differing bits, each differing with chance p."""
    return [float(comb(n, i)) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]


@cache
def most_differing(percent: int, bits: int = BITS) -> int:
    """In how many of so many bits pairs of this similarity differ at most, but for a chance of MISS."""
    left = 1.0
    for n, chance in enumerate(_chances(bits, differing(percent))):
        left -= chance
        if left <= MISS:
            return n
    return bits


@cache
def blocks(n: int, percent: int) -> np.ndarray:
    """Bits of each block for n fingerprints. The more there are, the longer are blocks, so that buckets stay of a size; as many
    blocks as let pairs of this similarity miss all of them with a chance of MISS."""
    size = max(6, ceil(log2(max(n, 1))) - CROWD)
    chance = np.array(_chances(BITS, differing(percent)))
    apart = 1 - (1 - np.arange(BITS + 1) / BITS) ** size
    many = 1
    while float((chance * apart**many).sum()) > MISS:
        many += 1
    rng = np.random.default_rng(size)
    return np.array([rng.choice(BITS, size, replace=False) for _ in range(many)])


def block_keys(sig: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key for each fingerprint (rows) and block (columns)."""
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    h = np.tile(np.arange(len(places), dtype=np.uint64), (len(sig), 1))
    for column in places.T:
        h = (h << np.uint64(1)) | bits[:, column]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def apart(sig: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Hamming distance of one fingerprint and each row of every."""
    return np.bitwise_count(every ^ sig).sum(axis=-1, dtype=np.int64)


def distance(a: str, b: str) -> Column:
    """apart() of two columns of fingerprints."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)), F.lit(0))


def together(sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | list[np.ndarray]:
    """Fingerprints (rows) of a bucket that are at most so far apart: all pairs, or where these are many the groups that they
    connect, found by comparing what is reached with what is not."""
    n, pairs = len(sig), []
    step, found = max(1, STRIP // n), 0
    for at in range(0, n - 1, step):
        differ = np.zeros((min(step, n - at), n - at), np.uint8 if sig.shape[1] < 4 else np.uint16)
        for word in sig.T:
            differ += np.bitwise_count(word[at : at + step, None] ^ word[None, at:])
        np.fill_diagonal(differ, np.iinfo(differ.dtype).max)
        some = np.flatnonzero(differ.min(axis=1) <= most)  # of unlike fingerprints few rows
        i, j = np.nonzero(differ[some] <= most)
        i = some[i]
        later = j > i
        pairs.append((i[later] + at, j[later] + at))
        found += int(later.sum())
        if found > 8 * n:
            break
    else:
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    groups, rest = [], np.arange(n)
    while len(rest):
        group, frontier, rest = [rest[0]], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = apart(sig[frontier.pop()], sig[rest]) <= most
            if near.any():
                group += (reached := rest[near].tolist())
                frontier += reached
                rest = rest[~near]
        groups.append(np.array(group))
    return groups


def groups_of(n: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """What pairs connect."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        up[find(y)] = find(x)
    members: dict[int, list[int]] = {}
    for x in list(up):
        members.setdefault(find(x), []).append(x)
    return [np.array(x) for x in members.values()]


def candidates(key: np.ndarray, node: np.ndarray, sig: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bucket, src, dst, as minhash's buckets give: near pairs of a bucket's small groups (bucket 0); of a larger group every
    member with the first, under a key of its own. Rows are sorted by key; nodes are distinct in a bucket."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if e - s < 2:
            continue
        own, held = node[s:e], sig[s:e]
        got = together(held, most)
        if isinstance(got, tuple):
            a, b = got
            groups = groups_of(e - s, a, b) if len(a) else []
            large = {x for group in groups if len(group) > SMALL for x in group.tolist()}
            few = np.array([x not in large for x in a.tolist()], bool)
            a, b = a[few], b[few]
        else:
            groups, pairs = got, []
            for group in got:
                if len(group) <= SMALL:
                    i, j = np.triu_indices(len(group), 1)
                    near = np.bitwise_count(held[group[i]] ^ held[group[j]]).sum(axis=1, dtype=np.int64) <= most
                    pairs.append((group[i[near]], group[j[near]]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        if len(a):
            yield np.zeros(len(a), np.uint64), np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
        for group in groups:
            if len(group) > SMALL:
                first = own[group].min()
                name = ((key[s : s + 1].view(np.uint64) ^ first) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
                yield np.repeat(name, len(group)), np.repeat(first, len(group)), own[group]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row (hash of id and text), t (hash of the text), node (hash of the shingles; null if there are none), n_shingles
    of every row; sig (the fingerprint) where the task meets the node first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in rows(batches):
            nodes, sizes, sigs = [], [], []
            for data in texts_of(b):
                own = shingles(data, size)
                node = int(node_of(own).view(np.int64)) if len(own) else None
                new = node is not None and node not in seen
                if new:
                    seen.add(node)
                nodes.append(node)
                sizes.append(len(own))
                sigs.append(fingerprint(own).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "row", "t", "node", "n_shingles", "sig"])

    given = with_text(docs, [], F.col("doc_id").cast("long"), minhash.row_of(), F.xxhash64(text_bytes()).alias("t"))
    return given.mapInArrow(run, "doc_id long, row long, t long, node long, n_shingles long, sig array<long>")


def in_buckets(nodes: DataFrame, places: np.ndarray, words: int, percent: int, members: bool = False) -> DataFrame:
    """bucket, src, dst (candidates()) of nodes (node, sig) that share a block, by the first words of their fingerprints.
    members: large groups give their members only, each as src and dst."""
    most, names = most_differing(percent, 64 * words), [f"s{i}" for i in range(words)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            sig = b.column("sig").flatten().to_numpy().reshape(-1, WORDS)
            keys = block_keys(sig.view(np.uint64), places)
            held = [np.repeat(x, len(places)) for x in (b.column("node").to_numpy(), *sig[:, :words].T)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel().view(np.int64), *held)], ["key", "node", *names])

    def pick(key, node, *sig):
        got = list(candidates(key, node, np.stack(sig, axis=1), most)) if len(key) else []
        if not members:
            return got
        large = [dst for bucket, _, dst in got if bucket[0]]
        once = np.unique(np.concatenate(large)) if large else np.empty(0, np.uint64)
        return [x for x in got if not x[0][0]] + [(np.ones(len(once), np.uint64), once, once)]

    keyed = nodes.select("node", "sig").mapInArrow(spread, "key long, node long, " + ", ".join(f"{x} long" for x in names))
    return by_bucket(keyed, pick, ["bucket", "src", "dst"])


def found(nodes: DataFrame, percent: int, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """bucket, src, dst (candidates()) of nodes (node, sig) that share a block. Large groups that hang together by the first
    words, as unlike texts do around many near copies, are parted by whole fingerprints in the same buckets."""
    places = blocks(nodes.count(), percent)
    screened = written(in_buckets(nodes, places, SCREEN, percent, members=True).distinct(), "screened")
    crowd = screened.filter("bucket <> 0").select(F.col("dst").alias("node"))
    return screened.filter("bucket = 0").union(in_buckets(nodes.join(crowd, "node", "left_semi"), places, WORDS, percent))


#: Steps of minhash.rooted() by SimHash.
SIMHASH = minhash.Method(
    sketches,
    found,
    lambda a, b, percent: distance(a, b) <= most_differing(percent),
    lambda sig, every, percent: apart(sig, every) <= most_differing(percent),
)


def one_of_each(docs: DataFrame, size: int, percent: int, tile: int = minhash.TILE) -> DataFrame:
    """One row of each component, all columns: the first by doc_id (nulls last) and text hash, however often it is repeated.
    Linked are texts of whose distinct shingles at least percent in a hundred are shared; texts without words are one group."""
    return minhash.one_of_each(docs, size, percent, tile, SIMHASH)
