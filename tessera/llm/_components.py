"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._runtime import Scratch, join_counted


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m, c): of each u the least of itself and its v, and its rows."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v long); component is the smallest reachable node.

    Alternates large-star and small-star steps until each component is a star
    around its smallest node: until every other node has one edge. Each step
    writes the minimum of each neighbourhood, a partial aggregate, and then the
    edges, so plans and lineage stay short. Minima are joined back by
    ``join_counted``: the edges of a hub of high degree stay where they are,
    and only its minimum is sent to them. Nodes without a link to another node
    are not returned. Raises if the rounds do not suffice.
    """
    # in all steps u > v, and no edge is there twice
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    for k in range(most_rounds + 1):
        down, up = now.select("u", "v"), now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = scratch.save(_lowest(down.union(up)), f"low-{k}")
        size = low.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("ends"), F.max("c").alias("most"), F.count(F.when(F.expr("m <> u and c > 1"), 1)).alias("open")).first()
        if not size["open"]:
            scratch.drop(f"edges-{k}")
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        if k == most_rounds:
            break
        large = join_counted(up, low, ["u"], "c", size["ends"], size["most"])
        large = scratch.save(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{k}")
        scratch.drop(f"edges-{k}")
        scratch.drop(f"low-{k}")
        low = scratch.save(_lowest(large), f"small-{k}")
        size = low.agg(F.sum("c").alias("n"), F.max("c").alias("most")).first()
        small = join_counted(large, low, ["u"], "c", size["n"], size["most"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = scratch.save(small, f"edges-{k + 1}")
        scratch.drop(f"large-{k}")
        scratch.drop(f"small-{k}")
        scratch.release()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
