"""b-bit MinHash near-dedup: bands of minima give candidates, packed low bits estimate their similarity, full sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, kept, rows, text_bytes, texts_of, with_text
from .components import components
from .copies import by_bucket, candidates, node_of, shingles

SHINGLE, PERCENT = 4, 80
#: Texts of similarity s share no band with a chance of (1 - s^ROWS)^BANDS: 5e-9 at 0.8.
BANDS, ROWS = 48, 5
#: MINIMA hashes of which BITS low bits each are kept: 16 longs a text.
MINIMA, BITS = 256, 4
MISS = 1e-7  # chance that a pair of just the similarity asked for is dropped by its estimate
TILE = 1_000_000  # shingles of a block of texts that a task holds against another block
_ODD = np.random.default_rng(12).integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)
_CHANCE = 2.0**-BITS


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of each of MINIMA hashes over a set of shingles."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 256):
        np.minimum(least, (own[at : at + 256, None] * _ODD).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, mixed so that those of different minima agree by chance only, 16 in a long."""
    h = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    low = (h ^ (h >> np.uint64(32))) & np.uint64((1 << BITS) - 1)
    places = np.arange(0, 64, BITS, dtype=np.uint64)
    return (low.reshape(-1, 64 // BITS) << places).sum(axis=1, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def similarity(agreeing: Column | float) -> Column | float:
    """The similarity that so many agreeing minima stand for: chance agreements of BITS bits are taken off."""
    return (agreeing / MINIMA - _CHANCE) / (1 - _CHANCE)


def least_agreeing(percent: int) -> int:
    """How many minima pairs of this similarity agree in at least, but for a chance of MISS."""
    p = _CHANCE + (1 - _CHANCE) * percent / 100
    total = 0.0
    for n in range(MINIMA + 1):
        total += comb(MINIMA, n) * p**n * (1 - p) ** (MINIMA - n)
        if total > MISS:
            return n
    return MINIMA


_ONES = sum(1 << at for at in range(0, 64, BITS))


def agreeing(a: str, b: str) -> Column:
    """Minima whose kept bits are equal, of two packed signatures: bits that differ are folded and counted."""
    differ = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    return F.lit(MINIMA) - differ


def agreeing_with(sig: np.ndarray, every: np.ndarray) -> np.ndarray:
    """agreeing() of one signature and each row of every."""
    x = every ^ sig
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return MINIMA - np.bitwise_count(x & np.uint64(_ONES)).sum(axis=1, dtype=np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row (hash of id and text), t (hash of the text), node (hash of the shingles; null if there are none), n_shingles
    of every row; sig and keys where the task meets the node first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in rows(batches):
            nodes, sizes, sigs, keys = [], [], [], []
            for data in texts_of(b):
                own = shingles(data, size)
                node = int(node_of(own).view(np.int64)) if len(own) else None
                new = node is not None and node not in seen
                if new:
                    seen.add(node)
                    least = minima(own)
                nodes.append(node)
                sizes.append(len(own))
                sigs.append(packed(least).view(np.int64) if new else None)
                keys.append(band_keys(least).view(np.int64) if new else None)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, many), pa.array(keys, many)], ["doc_id", "row", "t", "node", "n_shingles", "sig", "keys"])

    given = with_text(docs, [], F.col("doc_id").cast("long"), row_of(), F.xxhash64(text_bytes()).alias("t"))
    return given.mapInArrow(run, "doc_id long, row long, t long, node long, n_shingles long, sig array<long>, keys array<long>")


def row_of() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text_bytes()).alias("row")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its shingles of wanted (row, node): of each node the text of one row is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            own = [shingles(x, size).view(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    texts = docs.select(row_of(), text_bytes().alias("bytes")).join(wanted, "row").select("node", "bytes")
    return texts.mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"])


def linked(shared, total, percent: int):
    """Whether intersection over union is enough, in whole numbers; total: both sizes."""
    return (100 + percent) * shared >= percent * total


class Method(NamedTuple):
    """What rooted() finds and estimates pairs with."""

    sketches: Callable[[DataFrame, int], DataFrame]  # of docs and the size of shingles, as sketches() gives; keys are its own
    found: Callable[[DataFrame, int, Callable[[DataFrame, str], DataFrame]], DataFrame]  # bucket, src, dst of nodes and percent, as candidates() gives; what writes a scratch table
    close: Callable[[str, str, int], Column]  # whether two columns of signatures may be of texts of percent
    near: Callable[[np.ndarray, np.ndarray, int], np.ndarray]  # the same of one signature and each row of others


def found_by_bands(nodes: DataFrame, percent: int, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    return by_bucket(keyed, lambda key, node: candidates(key, node) if len(key) else (), ["bucket", "src", "dst"])


MINHASH = Method(
    sketches,
    found_by_bands,
    lambda a, b, percent: agreeing(a, b) >= least_agreeing(percent),
    lambda sig, every, percent: agreeing_with(sig, every) >= least_agreeing(percent),
)


def tile_links(node: list[int], root: list[int], side: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, near=MINHASH.near) -> list[tuple[int, int]]:
    """Links that connect what all links between texts of different roots connect. side: texts of side 1 are held against
    those of side 2 only, those of side 0 against each other."""
    up, out = {r: r for r in root}, []

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    number = np.unique(root, return_inverse=True)[1]
    for i in np.flatnonzero(side < 2).tolist():
        others = np.arange(i + 1, len(node)) if side[i] == 0 else np.flatnonzero(side == 2)
        others = others[number[others] != number[i]]
        for j in others[near(sig[i], sig[others], percent)].tolist():
            a, b = find(root[i]), find(root[j])
            if a != b and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]) + len(sets[j]), percent):
                up[max(a, b)] = min(a, b)
                out.append((node[i], node[j]))
    return out


def family_links(members: DataFrame, sets: DataFrame, percent: int, tile: int, near=MINHASH.near) -> DataFrame:
    """src, dst: links within families, members (family, node, root, sig, n) of whose texts those of one root are connected.

    The texts of a family's largest root are not held against each other. The rest of a family is dealt into blocks of
    about `tile` shingles, and so is the largest root; a task gets two blocks.
    """
    large = members.groupBy("family", "root").agg(F.sum("n").alias("n"))
    of = large.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    blocks = lambda n: F.ceil(n / tile).cast("int")
    sized = of.select("family", "main", blocks(F.col("n_main")).alias("t_main"), F.greatest(blocks(F.col("n_all") - F.col("n_main")), F.lit(1)).alias("t_rest"))
    placed = members.join(sized, "family").withColumn("in_main", F.col("root") == F.col("main"))
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = at(F.col("t_rest"))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    # tiles (i, j): i a block of the rest; j a later block of the rest, or t_rest + a block of the largest root
    rest = F.concat(
        F.transform(upto(F.col("t_rest")), lambda x: cell(F.least(own, x), F.greatest(own, x), F.when(x == own, 0).when(own < x, 1).otherwise(2))),
        F.transform(upto(F.col("t_main")), lambda x: cell(own, F.col("t_rest") + x, F.lit(1))),
    )
    main = F.transform(upto(F.col("t_rest")), lambda x: cell(x, F.col("t_rest") + at(F.col("t_main")), F.lit(2)))
    dealt = placed.withColumn("c", F.explode(F.when(F.col("in_main"), main).otherwise(rest))).select("family", "c.*", "node", "root", "sig").join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        sig = np.array(group["sig"].to_pylist(), np.int64).view(np.uint64)
        own = [np.array(x, np.int64) for x in group["own"].to_pylist()]
        got = tile_links(group["node"].to_pylist(), group["root"].to_pylist(), group["side"].to_numpy(), sig, own, percent, near)
        return pa.table({"src": pa.array([a for a, _ in got], pa.int64()), "dst": pa.array([b for _, b in got], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(run, "src long, dst long")


def rooted(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, by: Method = MINHASH) -> tuple[DataFrame, DataFrame]:
    """sketches() of docs (doc_id, text), and node, first (its least doc_id), root of every set of shingles: two written
    tables. Pairs that share a band are estimated from packed minima (or what else `by` names) and confirmed on full sets: in
    buckets of a few all pairs, in larger ones every text with the first; where that leaves those of one first in several
    components, they are held against each other in tiles."""
    spark, left = docs.sparkSession, []

    def written(df: DataFrame, label: str) -> DataFrame:
        made, path = kept(df, label)
        left.append(path)
        return made

    drawn = kept(by.sketches(docs, size), "sketches")[0]
    some = drawn.filter("node IS NOT NULL")
    first = some.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    marks = some.filter("sig IS NOT NULL").drop("doc_id", "row", "t", "n_shingles").dropDuplicates(["node"])
    nodes = written(first.join(marks, "node"), "nodes")
    found = written(by.found(nodes, percent, written).select((F.col("bucket") != 0).alias("large"), "src", "dst").distinct(), "candidates")
    one = lambda name, sig: nodes.select(F.col("node").alias(name), F.col("sig").alias(sig))
    pairs = written(found.filter("src <> dst").select("src", "dst").distinct(), "pairs")
    close = written(pairs.join(one("src", "a"), "src").join(one("dst", "b"), "dst").filter(by.close("a", "b", percent)).select("src", "dst"), "close")
    ends = close.select(F.col("src").alias("node")).union(close.select("dst")).union(found.filter("large").select("dst")).distinct()
    sets = written(sets_of(docs, nodes.select("row", "node").join(ends, "node", "left_semi"), size), "shingles")
    both = close.join(sets.select(F.col("node").alias("src"), F.col("own").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("own").alias("b")), "dst")
    edges = written(both.filter(linked(F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b"), percent)).select("src", "dst"), "near")
    root = written(components(edges), "roots")
    stars = found.filter("large").select("src", F.col("dst").alias("node"))  # buckets of one first are one star, a text once in it
    large = written(stars.join(root, "node", "left").select("src", "node", F.coalesce("root", "node").alias("root")), "stars")
    parted = large.groupBy("src").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("src")
    open_ = written(large.join(parted, "src", "left_semi"), "parted")
    family = components(open_.select("src", F.col("node").alias("dst")))
    members = open_.select("node", "root").distinct().join(family.withColumnRenamed("root", "family"), "node").join(nodes.select("node", "sig", "n"), "node")
    more = written(family_links(written(members, "families"), sets, percent, tile, by.near).distinct(), "more")
    root = components(edges.union(more))
    named = kept(nodes.join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")[0]
    for path in left:
        forget(spark, path)
    return drawn, named


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles (size of the set of word shingles), component_id (smallest doc_id reachable by links) of every row
    of docs (doc_id, text). Linked are texts of whose shingles at least percent in a hundred are shared.

    Words are lower-cased (A-Z); a text of fewer words is one shingle. Null, empty and blank texts have no shingles and are
    linked with nothing. Rows of one set are one node, however many; repeated rows come out repeated. A null doc_id takes
    part but is never a component's id unless all are null. Very long texts are read whole. No rows: no rows. Further
    columns are ignored.
    """
    drawn, named = rooted(docs, size, percent, tile)
    ids = kept(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")[0]
    member = kept(named.join(ids, "root").select("node", "component_id"), "members")[0]
    without = drawn.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return drawn.filter("node IS NOT NULL").select("doc_id", "node", "n_shingles").join(member, "node").select("doc_id", "n_shingles", "component_id").union(without)


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, by: Method = MINHASH) -> DataFrame:
    """One row of each component, all columns: the first by doc_id (nulls last) and text hash, however often it is repeated.
    Texts without words are one group."""
    drawn, named = rooted(docs, size, percent, tile, by)
    columns = ("root", "doc_id", "row", "t")
    blank = drawn.filter("node IS NULL").withColumn("root", F.lit(None).cast("long")).select(*columns)
    root = drawn.filter("node IS NOT NULL").join(named.select("node", "root"), "node").select(*columns).union(blank)
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "t"))
    best = kept(root.groupBy("root").agg(first.alias("row")).select(F.col("row").alias("__row")), "firsts")[0]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("__row").orderBy(*others) if others else Window.partitionBy("__row").orderBy("__row")
    mine = docs.withColumn("__row", row_of()).join(best, "__row", "left_semi")
    return mine.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__row", "__n")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - {SHINGLE - 2})), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS s FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT s, min(doc_id) AS doc_id FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= {PERCENT} * (len(u.s) + len(v.s) - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
o AS (SELECT s.doc_id, len(s.s) AS n_shingles, component_id FROM s JOIN n ON n.s = list_sort(s.s) JOIN c ON c.a = n.doc_id)
SELECT w.doc_id, CAST(coalesce(n_shingles, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, w.doc_id = coalesce(component_id, w.doc_id) AS kept FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""
