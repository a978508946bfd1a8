"""Connected components of links between 64-bit nodes, by alternating large-star and small-star rounds.

Every round is a pair of partial aggregations and equi-joins over the links, written to the shared folder: nothing is
collected but a count and a checksum, a hub's neighbours are dealt over many tasks, and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ssaflow.llm.common import materialise


#: Parts into which the neighbours of a node are dealt at most.
SALTS = 64


def with_least(rows: DataFrame, keys: list[str], other: str) -> DataFrame:
    """rows with m, the least other of each key. A hub's rows are dealt over many tasks: its least comes to each part
    of its neighbours, and no key gives more rows for that than it has neighbours."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    parts = rows.groupBy(*keys, "salt").agg(F.min(other).alias("m"))
    least = parts.groupBy(*keys).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select(*keys, "m", F.explode("salts").alias("salt"))
    return rows.join(least, [*keys, "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.select("b", "a"))
    return with_least(both, ["x"], "y").where("y > x").select(F.col("y").alias("a"), F.least("x", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node and component (the least node reachable) for every node of links, columns a and b: bigint, not null."""
    tidy = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(tidy, tag)
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now).distinct()).distinct(), tag)
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b"), F.col("b")).distinct())
