"""Connected components of an edge table, as joins and aggregations with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _to_least(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v) plus m, the least of each u and its neighbours v.

    A node on over a thousandth of n edges has its m broadcast (there are a few thousand such nodes at most), so
    the edges of a hub need not meet in one task; the others are joined by u.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
    heavy = F.broadcast(least.where(F.col("d") * 1000 > n).select("u", F.col("m").alias("hub_m")))
    marked = edges.join(heavy, "u", "left")
    rest = marked.where("hub_m IS NULL").select("u", "v").join(least.where(F.col("d") * 1000 <= n).select("u", "m"), "u")
    return rest.unionByName(marked.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One star step: every node links its larger (or its smaller) neighbours to the least of all, itself included.

    Only the large step meets hubs again and again: after it, nodes point to the least of their surroundings.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = _to_least(both, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable.

    Alternates large-star and small-star steps until the edge set is a set of stars around least
    nodes. Every round is checkpointed to the shared folder; nothing is gathered on the driver but
    two numbers a round.
    """
    edges = common.cut(edges.where("u <> v").select("u", "v").distinct())
    before, n = None, edges.count()
    for _ in range(max_rounds):
        edges = common.cut(_star(_star(edges, n, True), n, False))
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, n = now, now[0]
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
