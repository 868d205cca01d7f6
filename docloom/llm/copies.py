"""Near copies by Jaccard similarity of word shingles: MinHash bands give candidates, exact similarity decides."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, stored, text_bytes, texts_of, window_hashes, with_text, word_hashes
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity s share no band, and so are no candidates, with a chance of (1 - s^ROWS)^BANDS: 3e-6 at 0.8.
BANDS, ROWS = 32, 5
SMALL = 8  # texts of a bucket up to which every pair is a candidate at once
_ODD = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    h = word_hashes(data.lower())
    return np.unique(window_hashes(h, min(size, len(h)))) if len(h) else h


def node_of(own: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a set of shingles; 0 if it is empty."""
    x = own * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles, each of ROWS minima; none if it is empty."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024, None] * _ODD).min(axis=0), out=least)
    h = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def by_bucket(keyed: DataFrame, find: Callable[[np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, ...]]], names: list[str]) -> DataFrame:
    """What `find` yields, as columns of longs, for runs of complete buckets of keyed (key and more longs, the latter as
    unsigned): arrays sorted by key and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, *values):
            if found := [x for x in find(key, *values) if len(x[0])]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], names)

        parts: list[tuple[np.ndarray, ...]] = []  # the rows since the last complete bucket
        for batch in batches:
            key, *values = batch.column(0).to_numpy(), *(x.to_numpy().view(np.uint64) for x in batch.columns[1:])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # sorted within the partition
            if parts and (cut or parts[0][0][0] != key[-1]):
                if cut:
                    parts.append((key[:cut], *(x[:cut] for x in values)))
                yield from out(*map(np.concatenate, zip(*parts, strict=True)))
                parts = []
            elif cut:
                yield from out(key[:cut], *(x[:cut] for x in values))
            parts.append((key[cut:], *(x[cut:] for x in values)))
        if parts:
            yield from out(*map(np.concatenate, zip(*parts, strict=True)))

    return keyed.repartition("key").sortWithinPartitions(*keyed.columns).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def candidates(key: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bucket, src, dst: all pairs of small buckets (bucket 0); of larger ones every member with the first, under the
    bucket's key. Rows are sorted by key; nodes are distinct in a bucket."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    few = np.repeat(sizes <= SMALL, sizes)
    for j in range(1, min(SMALL, int(sizes.max()))):
        near = (key[j:] == key[:-j]) & few[j:]
        yield np.zeros(near.sum(), np.uint64), node[:-j][near], node[j:][near]
    first = np.repeat(node[starts], sizes)
    yield key[~few].view(np.uint64), first[~few], node[~few]


def join_sets(ids: list, roots: list, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what all links of at least `similarity` between the sets connect, beside equal roots."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    members: dict[int, list[int]] = {}
    for i, root in enumerate(roots):
        members.setdefault(root, []).append(i)
    rest, out, flag = np.ones(len(sets), bool), [], np.zeros(codes.max() + 1, bool)
    for i in range(len(sets)):
        if not rest[i]:
            continue
        frontier = list(members[roots[i]])
        rest[frontier] = False
        while frontier and rest.any():
            x = frontier.pop()
            own = codes[starts[x] : starts[x + 1]]
            flag[own] = True
            shared = np.add.reduceat(flag[codes], starts[:-1], dtype=np.int64)
            flag[own] = False
            for y in np.flatnonzero(rest & (shared >= similarity * (sizes + sizes[x] - shared) - 1e-9)).tolist():
                if rest[y]:
                    out.append((ids[x], ids[y]))
                    frontier += members[roots[y]]
                    rest[members[roots[y]]] = False
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (hash of the text), node and keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            own = [shingles(x, size) for x in texts_of(b)]
            nodes = np.array([node_of(x) for x in own], np.uint64).view(np.int64)
            keys = [bands(x).view(np.int64) for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "node", "keys"])

    given = with_text(docs, [], F.col("doc_id").cast("long"), F.xxhash64(text_bytes()).alias("t"))
    return given.mapInArrow(run, "doc_id long, t long, node long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its shingles for the nodes of wanted (t, node); a task sends a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in rows(batches):
            some = [(n, shingles(x, size)) for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if n not in seen and not seen.add(n)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int64()), pa.array([x.view(np.int64) for _, x in some], pa.list_(pa.int64()))], ["node", "own"])

    texts = docs.select(F.xxhash64(text_bytes()).alias("t"), text_bytes().alias("bytes")).join(wanted, "t").select("node", "bytes")
    return texts.mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


def rooted(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t (hash of the text) and root of every row of docs (doc_id, text); rows of one root are one component.

    Texts whose sets of shingles have a Jaccard similarity of at least `similarity` are linked; a component is what links
    connect. Texts of one set are one node, however many; so are texts without words. Pairs that share a band are
    compared, in buckets over SMALL first with one member; where that leaves a bucket in several parts, one task holds
    the sets of its members.
    """
    drawn = stored(sketches(docs, size), "sketches")
    nodes = drawn.groupBy("node").agg(F.min("t").alias("t"), F.first("keys").alias("keys"))

    def pick(key, node):
        return candidates(key, node) if len(key) else ()

    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    found = stored(by_bucket(keyed, pick, ["bucket", "src", "dst"]).distinct(), "candidates")
    wanted = nodes.select("t", "node").join(found.select(F.col("src").alias("node")).union(found.select("dst")).distinct(), "node", "left_semi")
    sets = stored(sets_of(docs, wanted, size), "shingles")
    pairs = found.filter("src <> dst").select("src", "dst").distinct()
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("own").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("own").alias("b")), "dst")
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    edges = stored(both.filter(shared >= F.lit(similarity) * (total - shared) - 1e-9).select("src", "dst"), "near")
    root = stored(components(edges), "roots")

    def finish(group: pa.Table) -> pa.Table:
        own = [np.array(x, np.int64) for x in group["own"].to_pylist()]
        got = join_sets(group["node"].to_pylist(), group["root"].to_pylist(), own, similarity)
        return pa.table({"src": pa.array([a for a, _ in got], pa.int64()), "dst": pa.array([b for _, b in got], pa.int64())})

    large = found.filter("bucket <> 0").select("bucket", F.col("dst").alias("node")).join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parted = large.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    more = large.join(parted, "bucket", "left_semi").join(sets, "node").groupBy("bucket").applyInArrow(finish, "src long, dst long")
    root = components(edges.union(more.distinct()))
    return drawn.select("doc_id", "t", "node").join(root, "node", "left").select("doc_id", "t", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (its smallest doc_id) of every row of docs (doc_id, text). A null doc_id is never a
    component's id unless all are null."""
    named = rooted(docs, size, similarity)
    ids = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return named.join(ids, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component: the first by doc_id (nulls last) and text hash, however often its id is repeated."""
    first = F.min_by("t", F.struct(F.col("doc_id").isNull(), "doc_id", "t"))
    best = rooted(docs, size, similarity).groupBy("root").agg(first.alias("__t")).select("__t")
    order = Window.partitionBy("__t").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in docs.columns if c not in ("doc_id", "text")])
    one = docs.withColumn("__t", F.xxhash64(text_bytes())).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return one.join(best, "__t", "left_semi").drop("__t", "__n")
