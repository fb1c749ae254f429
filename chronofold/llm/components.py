"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rounds after which contraction must have ended; star contraction needs O(log n) of them.
MAX_ROUNDS = 60
#: An end is hot if it has more than this share of all edges, and at least so many.
HOT_SHARE, HOT_LEAST = 2000, 256


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows(a, b)`` with ``m`` of ``least(a, m, n)``; an end with very many edges must not gather in one task.

    Ends of more than ``total / HOT_SHARE`` edges go by broadcast: there are at most 2 * HOT_SHARE of them.
    """
    bound = max(HOT_LEAST, total // HOT_SHARE)
    hot = least.where(F.col("n") > bound).select("a", F.col("m").alias("hot"))
    rows = rows.join(F.broadcast(hot), "a", "left")
    cold = rows.where("hot is null").drop("hot").join(least.where(F.col("n") <= bound).select("a", "m"), "a")
    return cold.unionByName(rows.where("hot is not null").withColumnRenamed("hot", "m"))


def _large_star(edges: DataFrame, total: int, tag: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), tag)
    moved = _with_least(both.where("b > a"), least, 2 * total)
    return moved.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int, tag: str) -> DataFrame:
    # every edge points from the larger to the smaller end
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), tag)
    moved = _with_least(edges, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``; component is the smallest node id reachable.

    Nodes without an edge are not returned. Self loops and null ends are ignored; repeated and
    reversed edges count once. Each round is written to the shared folder, so no lineage builds up;
    nothing is collected but one count and one checksum a round.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialise(e, tag)
    before = _signature(e)
    if before[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(MAX_ROUNDS):
        large = materialise(_large_star(e, before[0], tag), tag)
        small = materialise(_small_star(large, before[0] * 2, tag), tag)
        discard(e)
        discard(large)
        e, after = small, _signature(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("star contraction did not converge")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
