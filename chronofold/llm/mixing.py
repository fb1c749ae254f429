"""Mixing sources to target weights by Pareto order sampling.

Each source's target is a share of all words, capped at ``max_repeats`` times its size with the excess
reshared. Inside a source a document's expected copies grow with the square root of its length (the longer
say more, but not in proportion), capped at ``max_repeats``; one factor a source makes the expected words
equal to the target. The whole part of the expected copies is allocated for certain; the fraction is the
inclusion probability of one more: documents are ranked by their random odds divided by their inclusion odds
and taken in that order until their words fill what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
#: Cells that a source's ranking is cut into, so that no source is ordered in one task.
CELLS = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes(source, source_size)`` -> also ``target``.

    Weights repeat over the sources in code point order, null last. ``target`` is the smaller of
    max_repeats * size and level * weight; the level is where the targets sum to all words.
    One row for each source goes through one ordered window.
    """
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # the level if this source and all fuller-late ones are below their caps
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(onward))
    s = s.withColumn("final", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    return s.withColumn("target", F.least("cap", F.coalesce("final", F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _factors(docs: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """``source, factor``: expected copies are factor * pull, at most ``max_repeats``, and their words sum to the target.

    Only one row for each (source, pull) is ordered: pull is the whole root of a length, so a source has few.
    All sums are of whole numbers, so they do not depend on the order of rows.
    """
    cells = docs.where("size > 0").groupBy("source", "pull").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("pull")).alias("weight"))
    t = targets.select(F.col("source").alias("ts"), "target", "source_size")
    cells = cells.join(t, cells["source"].eqNullSafe(t["ts"])).drop("ts")
    longer = W.partitionBy("source").orderBy(F.desc("pull")).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy("source").orderBy(F.desc("pull")).rowsBetween(0, W.unboundedFollowing)
    left = F.col("target") - max_repeats * F.coalesce(F.sum("words").over(longer), F.lit(0))
    # the factor if all longer documents are capped and this pull is the first that is not
    cells = cells.withColumn("factor", left / F.sum("weight").over(onward)).where((F.col("factor") * F.col("pull") <= max_repeats) & (F.col("factor") >= 0))
    return cells.groupBy("source").agg(F.max(F.struct("pull", "factor"))["factor"].alias("factor")).withColumnRenamed("source", "fs")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, keep_source: bool = False) -> DataFrame:
    """Words each document gives to the mix.

    Returns one row per input row: id, ``size`` (words of the whole text; null text: 0), ``source_size``,
    ``target`` (of its source), ``taken`` (copies * size, at most ``max_repeats`` copies) and ``copies``;
    with ``keep_source`` also the source.
    A source misses its target by half a document at most, unless none of its documents may have one more copy. Sources are compared by code point, null last
    and a source of its own. A source without words has target 0; documents without words get no copies. Random
    numbers come from the id alone, so reruns agree; ties are ordered by id, then size. Rows repeated with one
    id are ranked side by side. Empty tables give empty results; further columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12)
    docs = docs.withColumn("u", (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 48)).withColumn("pull", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
    docs = materialise(docs, "mix-docs")
    targets = materialise(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats, weights), "mix-targets")
    factors = _factors(docs, targets, max_repeats)
    known = targets.join(factors, targets["source"].eqNullSafe(factors["fs"]), "left").select(F.col("source").alias("ks"), "source_size", "target", F.coalesce("factor", F.lit(float(max_repeats))).alias("factor"))
    known = materialise(known, "mix-factors")
    copies = F.when(F.col("size") > 0, F.least(F.lit(float(max_repeats)), F.col("factor") * F.col("pull"))).otherwise(0.0)
    joined = (docs.join(known, docs["source"].eqNullSafe(known["ks"])).drop("ks").withColumn("expected", copies)
              .withColumn("certain", F.floor("expected").cast("long")).withColumn("part", F.col("expected") - F.col("certain")))
    ratio = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    joined = joined.withColumn("rank_key", F.when(F.col("part") > 0, ratio))
    # the last one taken lies near a ratio of one, where cells are narrow; only the cell that it lies in is ordered
    joined = joined.withColumn("cell", F.when(F.col("part") > 0, F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * CELLS).cast("int")).otherwise(CELLS))
    by_source = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    may = F.col("part") > 0
    cells = (joined.groupBy("source", "cell").agg(F.sum(F.when(may, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target"))
             .withColumn("rest", F.col("target") - F.sum("sure").over(whole)).withColumn("below", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
             .withColumn("state", F.when(F.col("cell") == CELLS, 0).when(F.col("below") + F.col("words") <= F.col("rest"), 1).when(F.col("below") >= F.col("rest"), 0).otherwise(2))
             .select(F.col("source").alias("cs"), F.col("cell").alias("cc"), "below", "rest", "state"))
    cells = materialise(cells, "mix-cells")
    placed = joined.join(cells, joined["source"].eqNullSafe(cells["cs"]) & (joined["cell"] == cells["cc"]))
    cols = ["id", "source", "source_size", "size", "target", "certain"]
    sure = placed.where("state <> 2").select(*cols, F.col("state").cast("long").alias("more"))
    inner = W.partitionBy("source", "cell").orderBy("rank_key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("below") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    edge = placed.where("state = 2").select(*cols, F.when(middle <= F.col("rest"), 1).otherwise(0).cast("long").alias("more"))
    out = sure.unionByName(edge).withColumn("copies", F.least(F.col("certain") + F.col("more"), F.lit(max_repeats)))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *([F.col("source")] if keep_source else []))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS full_at,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= full_at), 'inf'::DOUBLE) * weight) AS target FROM l),
g AS (SELECT source, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS pull, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size * CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT)) AS BIGINT) AS weight FROM d WHERE size > 0 GROUP BY ALL),
f AS (SELECT g.source, g.pull, (t.target - 3 * coalesce(sum(g.words) OVER (PARTITION BY g.source ORDER BY g.pull DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(g.weight) OVER (PARTITION BY g.source ORDER BY g.pull DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
h AS (SELECT source, arg_max(factor, pull) AS factor FROM f WHERE factor * pull <= 3 AND factor >= 0 GROUP BY source),
r AS (SELECT t.source, t.source_size, t.target, coalesce(h.factor, 3.0::DOUBLE) AS factor FROM t LEFT JOIN h ON t.source IS NOT DISTINCT FROM h.source),
e AS (SELECT d.*, r.source_size, r.target, CASE WHEN size > 0 THEN least(3.0::DOUBLE, r.factor * floor(sqrt(CAST(size AS DOUBLE)))) ELSE 0.0::DOUBLE END AS expected
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS part FROM e),
p AS (SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest,
        CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank_key FROM o),
q AS (SELECT *, CASE WHEN part > 0 THEN coalesce(sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank_key NULLS LAST, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS below FROM p)
SELECT doc_id, size, source_size, target, CAST(least(certain + CASE WHEN part > 0 AND below + size / 2.0 <= rest THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken,
  CAST(least(certain + CASE WHEN part > 0 AND below + size / 2.0 <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies FROM q
"""
