"""Searches over vectors at scale: tiles of vectors against vectors, then the plan's own arithmetic on what may count.

Rows are dealt to stripes of bounded size, and a pair of stripes is one group. There a matrix product says which pairs can reach
the result; only for these is the sum taken in the plan's order, so results equal the plans to the last bit, and Spark rounds and ranks them.
Copies of a vector differ only in their ids: where ``k`` of a ranking are asked for, no more than the first of them are compared.
Vectors with null, non-finite or huge components, of another size than most, or (for cosines) without a length go through the plan's own
expression instead, against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import dialect
from .graph import cut

#: Rows of a stripe at most, and rows that are worth a stripe of their own while there are few stripes.
STRIPE, SMALL, FEW = 32768, 2048, 8
#: Rows of a block of a tile, and pairs whose exact sum is taken at once.
BLOCK, AT_ONCE = 256, 65536
Inputs = dict[str, DataFrame] | None


def _rows(spark: SparkSession, sf_dir: str | None, inputs: Inputs, cosine: bool) -> tuple[DataFrame, DataFrame]:
    """``id, v`` of the even vectors, which go through tiles, and of the odd ones."""
    rows = dialect.run(spark, sf_dir, lambda d: "SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL", inputs)
    usual = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100))
    even = (F.size("v") == (usual.n if usual else 0)) & finite
    if cosine:
        even &= F.exists("v", lambda x: F.abs(x) > 1e-100)
    marked = cut(rows.withColumn("even", F.coalesce(even, F.lit(False))))
    return marked.where("even").drop("even"), marked.where("not even").drop("even")


def _stripes(n: int) -> int:
    return max(math.ceil(n / STRIPE), min(FEW, math.ceil(n / SMALL)), 1)


def _first_copies(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("k") <= k).drop("k")


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("id").to_numpy()
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in rows.column("v").chunks)])
    return ids, flat.reshape(len(ids), -1)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up from the first component on, as the plan does."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _tile(may_count: Callable, cosine: bool, earlier: bool):
    """``may_count(block, slack)`` marks the pairs of a block (asking rows by others; -inf: no pair) that can reach the result, where the
    product may be off by ``slack``."""

    def tile(asking: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(asking) and len(others):
            (new, x), (old, y) = _matrix(asking), _matrix(others)
            x_norm, y_norm = (np.sqrt(_sums(m, m)) if cosine else np.ones(len(m)) for m in (x, y))
            longest = 1.0 if cosine else np.sqrt((y * y).sum(axis=1).max())
            flat = np.ascontiguousarray((y / y_norm[:, None]).T)
            for at in range(0, len(new), BLOCK):
                part = slice(at, at + BLOCK)
                block = (x[part] / x_norm[part, None]) @ flat
                block[new[part, None] <= old[None, :] if earlier else new[part, None] == old[None, :]] = -np.inf
                slack = 1e-13 * longest * (1.0 if cosine else np.sqrt((x[part] * x[part]).sum(axis=1, keepdims=True)))
                a, b = np.nonzero(may_count(block, slack) & (block > -np.inf))
                for k in range(0, len(a), AT_ONCE):
                    i, j = a[k : k + AT_ONCE] + at, b[k : k + AT_ONCE]
                    sim = _sums(x[i], y[j]) + 0.0
                    found.append((new[i], old[j], sim / (x_norm[i] * y_norm[j]) if cosine else sim))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("new_id", "old_id", "sim"), columns)))

    return tile


def _met(asking: DataFrame, others: DataFrame, may_count: Callable, cosine: bool = False, earlier: bool = False) -> DataFrame:
    """``new_id, old_id, sim`` of the pairs of even vectors that can count; ``earlier``: only others with a smaller id."""
    n, m = (_stripes(x.count()) for x in (asking, others))
    if earlier:  # both sides are cut at the same ids, so half of the tiles hold no pair and are not made
        n = m = max(n, m)
        edges = sorted(set(asking.approxQuantile("id", [k / n for k in range(1, n)], 0.02 / n))) if n > 1 else []
        n, m = len(edges) + 1, len(edges) + 1
        stripe = lambda _: sum(((F.col("id") >= e).cast("int") for e in edges), F.lit(0))
    else:
        stripe = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    # both sides may come from the same rows: under one's own names their columns are not taken for each other's
    left, right = (x.select(F.col("id").alias("id"), F.col("v").alias("v")) for x in (asking, others))
    left, right = left.withColumn("i", stripe(n)), right.withColumn("j", stripe(m))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") if earlier else F.lit(m - 1))))
    right = right.withColumn("i", F.explode(F.sequence(F.col("j") if earlier else F.lit(0), F.lit(n - 1))))
    tiles = max(1, n * (n + 1) // 2 if earlier else n * m)
    parts = lambda rows: rows.repartition(tiles, "i", "j").groupBy("i", "j")
    return parts(left).cogroup(parts(right)).applyInArrow(_tile(may_count, cosine, earlier), "new_id long, old_id long, sim double")


def _plain(asking: DataFrame, others: DataFrame, cosine: bool, where: str) -> DataFrame:
    """The plan's own expression over all pairs of ``asking`` and ``others``."""
    dot = lambda a, b: dialect.SPARK.dot(a, b)
    both = asking.select(F.col("id").alias("new_id"), F.col("v").alias("q")).join(others.select(F.col("id").alias("old_id"), F.col("v").alias("o")), F.expr(where))
    sim = F.expr(dot("q", "o"))
    if cosine:
        length = F.sqrt(F.expr(dot("q", "q"))) * F.sqrt(F.expr(dot("o", "o")))
        sim = F.when(length == 0, F.lit(float("nan"))).otherwise(sim / F.nullif(length, F.lit(0.0)))  # as IEEE divides by a zero length
        sim = F.when(F.expr("q IS NULL OR o IS NULL"), F.lit(None)).otherwise(sim)
    return both.select("new_id", "old_id", sim.alias("sim"))


def semantic_supersession(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    """The best earlier vector of every vector, if it is close enough (0.30) and clearly ahead of the second (by 0.08).

    A second one below 0.22 changes nothing, so only what reaches that is looked at, and of that the best two of a stripe.
    """
    even, odd = _rows(spark, sf_dir, inputs, False)

    def may_count(block: np.ndarray, slack: np.ndarray | float) -> np.ndarray:
        if block.shape[1] < 2:
            return block >= 0.2199 - slack
        best = block.argmax(axis=1)[:, None]
        top = np.take_along_axis(block, best, axis=1)
        np.put_along_axis(block, best, -np.inf, axis=1)
        second = block.max(axis=1, keepdims=True)
        np.put_along_axis(block, best, top, axis=1)
        return block >= np.maximum(0.2199, second - 1.1e-6) - 2 * slack

    less = "old_id < new_id"
    s = _met(even, _first_copies(even, 2), may_count, earlier=True).unionByName(_plain(odd, even.unionByName(odd), False, less)).unionByName(_plain(even, odd, False, less))
    order = W.partitionBy("new_id").orderBy(F.desc("sim"), "old_id")
    r = s.where("sim IS NOT NULL").withColumn("sim", F.round("sim", 6)).withColumns({"k": F.row_number().over(order), "second": F.lead("sim").over(order)})
    return r.where("k = 1 AND sim >= 0.3 AND (second IS NULL OR sim - second >= 0.08)").select("new_id", "old_id", "sim")


def _asking(even: DataFrame, odd: DataFrame) -> tuple[DataFrame, DataFrame]:
    return even.where("id % 50 = 0"), odd.where("id % 50 = 0")


def vector_search(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    """Every fiftieth vector asks all others, of any label or none."""
    even, odd = _rows(spark, sf_dir, inputs, False)
    asking, odd_asking = _asking(even, odd)
    s = _met(asking, even, lambda block, slack: block >= 0.29999 - slack).unionByName(_plain(odd_asking, even.unionByName(odd), False, "old_id <> new_id")).unionByName(_plain(asking, odd, False, "old_id <> new_id"))
    return s.select(F.col("new_id").alias("query_id"), F.col("old_id").alias("vec_id"), F.round("sim", 6).alias("sim")).where("sim >= 0.3")


def cosine_topk(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None, k: int = 10) -> DataFrame:
    """The ten nearest of all other vectors for every fiftieth vector, then a bounded rank."""
    even, odd = _rows(spark, sf_dir, inputs, True)
    asking, odd_asking = _asking(even, odd)

    def may_count(block: np.ndarray, slack: np.ndarray | float) -> np.ndarray:
        if block.shape[1] <= k:
            return np.ones(block.shape, dtype=bool)
        return block >= np.partition(block, block.shape[1] - k, axis=1)[:, [block.shape[1] - k]] - 1.1e-5 - 2 * slack

    # the asking vector may be one of its copies, so one more of them than are ranked
    s = _met(asking, _first_copies(even, k + 1), may_count, cosine=True).unionByName(_plain(odd_asking, even.unionByName(odd), True, "old_id <> new_id")).unionByName(_plain(asking, odd, True, "old_id <> new_id"))
    r = s.withColumn("sim", F.round("sim", 5)).withColumn("r", F.row_number().over(W.partitionBy("new_id").orderBy(F.desc_nulls_last("sim"), "old_id")).cast("long"))
    return r.where(F.col("r") <= k).select(F.col("new_id").alias("query_id"), F.col("old_id").alias("vec_id"), "sim", "r")


def queries() -> dict:
    """Their statements over all pairs stay their check."""
    return {f.__name__: f for f in (semantic_supersession, vector_search, cosine_topk)}
