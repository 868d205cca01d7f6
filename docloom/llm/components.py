"""Connected components by alternating large and small stars; no link or node reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kept


ROWS = 500_000  # links in a part of a written round, about


class Rounds:
    """Written tables of which a new one takes an old one's place, in as many parts as `links` of them ask for. Both sides of
    each join are written, so the join can split a node that many links have, such as the centre of a star."""

    def __init__(self, spark, links: int | None = None):
        self.spark, self.links, self.paths = spark, links, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        made, path = kept(df if self.links is None else df.coalesce(-(-self.links // ROWS) or 1), name)
        self.drop(name)
        self.paths[name] = path
        return made

    def drop(self, name: str) -> None:
        if name in self.paths:
            forget(self.spark, self.paths.pop(name))


def _large_star(edges: DataFrame, rounds: Rounds) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = rounds.put("least", both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """edges point from the larger to the smaller node."""
    least = rounds.put("least", edges.groupBy("src").agg(F.min("dst").alias("m")))
    moved = edges.join(least, "src").filter("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has a link. edges: src, dst (long); self
    links and repeated links don't matter. Every round is written to the shared folder and takes the place of the one
    before; the number of rounds grows with the logarithm of the longest chain."""
    rounds = Rounds(edges.sparkSession)
    down = edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = rounds.put("links", down)
    was = _state(now)
    rounds.links = was[0]
    while was[0]:
        now = rounds.put("links", _small_star(rounds.put("large", _large_star(now, rounds)), rounds))
        if (new := _state(now)) == was:
            break
        was = new
    rounds.drop("least")
    rounds.drop("large")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(now.select("dst", "dst").distinct())
