"""Connected components over edges of longs, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stored

EDGES_A_FILE = 250_000


def _check(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself counted)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v > u
    return up.join(least, up["u"] == least["w"]).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    met = edges.join(least, edges["a"] == least["w"])
    out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Alternating large and small stars: edges shrink to one star for each component in a
    number of rounds about the logarithm of its diameter. A hub's edges are only summed
    (min, with partial sums) and joined, never gathered. Each round is written to the
    shared folder, so a lost executor costs one round at most. Self-links and repeated
    links are ignored; no links: no rows.
    """
    x, y = F.col(a), F.col(b)
    now = stored(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    before = _check(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # Edges shrink from round to round: few files for few edges
        then = stored(_small_star(_large_star(now)).coalesce(-(-before[0] // EDGES_A_FILE)), "edges")
        after = _check(then)
        discard(now)
        now = then
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
