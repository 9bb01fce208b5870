"""Connected components of a graph of links, by alternating large and small stars.

Each round points neighbours at the least neighbour of their node; the stars left at the end are the
components. A round is two aggregations to minima and two joins whose other side is unique in the key, so a
node with very many links is split by skew-join handling; rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

#: Rounds at most; their number grows with the logarithm of the longest path.
ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """u, v: every node u that isn't the least of its component, and v, the least; edges: u, v of one orderable type."""
    e = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        done = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if done == before:
            return e
        before, last = done, e
        e = materialize(_small(_large(e)), "edges")
        release(last)
    raise RuntimeError(f"components are open after {ROUNDS} rounds")
