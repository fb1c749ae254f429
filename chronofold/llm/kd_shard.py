"""Sharding with a k-d tree over metadata: near-equal bytes in every leaf.

A node that must become several leaves is cut on its widest metadata dimension (relative to the whole
table's range) at the weighted median, or the quantile that fits its leaves. All nodes of a level are cut
together: one aggregate finds the ranges, two histogram passes narrow the cut down. Only sums for each
(node, bin) reach the driver, at most leaves * BINS of them. A third of all rows may share a source or a
size: a hash of the row breaks such ties, so a cut can fall inside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, unit_hash

BINS = 2048
PASSES = 2
#: Rows numbered by one task when slots are given out.
SLOT_ROWS = 20_000
#: Equal rows unfolded by one task.
RUN = 10_000
DIMS = ("d_source", "d_lang", "d_size", "d_id")


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    has = set(df.columns)
    text = F.col(text_col)
    source = F.col("source").cast("string") if "source" in has else F.lit(None).cast("string")
    lang = F.col("lang").cast("string") if "lang" in has else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                     F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), source.alias("src"), lang.alias("lng"))
    # rows that are equal in all of this are told apart by their number among each other; counted and unfolded in
    # bounded runs, so that a row repeated very often is not numbered in one task
    same = rows.groupBy("id", "size", "crc", "src", "lng").agg(F.count("*").alias("n"))
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    long_ones = runs.where(F.col("n") > RUN).repartition("id", "crc", "run")
    runs = runs.where(F.col("n") <= RUN).unionByName(long_ones)
    rows = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))).drop("run", "n")
    tie = unit_hash("id", "crc", "src", "lng", "copy", seed=7)
    return rows.select(
        "id", "size", "crc", "copy",
        (F.pmod(F.xxhash64("src"), F.lit(1024)).cast("double") + tie).alias("d_source"),
        (F.pmod(F.xxhash64("lng"), F.lit(64)).cast("double") + tie).alias("d_lang"),
        F.log2(F.col("size") + tie).alias("d_size"),
        (F.coalesce("id", F.lit(-1)).cast("double") + tie).alias("d_id"))


class _Node:
    """A range of the final leaves [first, first + leaves) that is still one region."""

    def __init__(self, first: int, leaves: int):
        self.first, self.leaves = first, leaves
        self.dim, self.cut = DIMS[0], 0.0


def _by_node(nodes: list[_Node], value) -> Column:
    """A literal table lookup by the ``node`` column (a node is named by its first leaf)."""
    return F.coalesce(*[F.when(F.col("node") == n.first, value(n)) for n in nodes])


def _grow(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``node`` set to the leaf's number. Each level is written to the shared folder."""
    at, nodes, span = materialise(rows.withColumn("node", F.lit(0)), "kd-level"), [_Node(0, shards)], None
    while any(n.leaves > 1 for n in nodes):
        split = [n for n in nodes if n.leaves > 1]
        stats = {r["node"]: r for r in at.groupBy("node").agg(
            F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        if not stats:
            return at
        span = span or {d: max(1e-9, stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) for d in DIMS}
        ranges, below, goal = {}, {}, {}
        live = [n for n in split if n.first in stats]
        for n in live:
            r = stats[n.first]
            n.dim = max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / span[d])
            lo, hi = r[f"lo_{n.dim}"], r[f"hi_{n.dim}"]
            ranges[n.first] = (lo, hi + max(1e-9, abs(hi) * 1e-12))
            below[n.first], goal[n.first] = 0, r["w"] * (n.leaves // 2) / n.leaves
        for _ in range(PASSES if live else 0):
            value = _by_node(live, lambda n: F.col(n.dim))
            lo = _by_node(live, lambda n: F.lit(ranges[n.first][0]))
            width = _by_node(live, lambda n: F.lit((ranges[n.first][1] - ranges[n.first][0]) / BINS))
            sums = (at.select("node", "size", F.floor((value - lo) / width).alias("bin")).where(F.col("bin").between(0, BINS - 1))
                    .groupBy("node", "bin").agg(F.sum("size").alias("w")).collect())
            weight = {(r["node"], r["bin"]): r["w"] for r in sums}
            for n in live:
                (low, high), run = ranges[n.first], below[n.first]
                step = (high - low) / BINS
                for b in range(BINS):
                    w = weight.get((n.first, b), 0)
                    if run + w >= goal[n.first] or b == BINS - 1:
                        break
                    run += w
                ranges[n.first], below[n.first] = (low + b * step, low + (b + 1) * step), run
                n.cut = ranges[n.first][1] if abs(run + w - goal[n.first]) < abs(run - goal[n.first]) else ranges[n.first][0]
        moved = _by_node(split, lambda n: F.when(F.col(n.dim) < F.lit(n.cut), F.lit(n.first)).otherwise(F.lit(n.first + n.leaves // 2)))
        last, at = at, materialise(at.withColumn("node", F.coalesce(moved, F.col("node"))), "kd-level")
        discard(last)
        nodes = [part for n in nodes for part in ([n] if n.leaves == 1 else [_Node(n.first, n.leaves // 2), _Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)])]
    return at


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards of near-equal bytes.

    Returns one row per input row: id, ``size`` (UTF-8 bytes of the text plus 16; null text: 16),
    ``text_crc32`` (of the UTF-8 bytes; null as empty), ``law`` ('bytes'), ``shard`` (0..shards-1),
    ``slot`` (gapless from 0 in each shard, by hash cell, then id) and ``grown_shard`` (null: the law is
    not 'key'). Null ids, sources and languages are values like any other; ``source`` and ``lang`` may be
    missing. Equal rows are told apart by a number, so a row repeated very often is spread
    like any other rows; groups of equal texts are not kept together. An empty table gives an empty result.
    """
    rows = _grow(_narrow(df, id_col, text_col), shards)
    cells = max(1, math.ceil(rows.count() / shards / SLOT_ROWS))
    at = (rows.select("id", "size", "crc", "copy", F.col("node").cast("int").alias("shard"))
          .withColumn("cell", F.pmod(F.xxhash64("id", "crc", "copy"), F.lit(cells)).cast("int")))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    base = at.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("shard", "cell").orderBy("id", "crc", "size", "copy")
    return (at.join(base, ["shard", "cell"]).withColumn("slot", F.col("base") + F.row_number().over(inner) - 1)
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                    "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
