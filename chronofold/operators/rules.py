"""The rules of replacement at scale: features once a text, verdicts only where two statements can mean something for each other.

``plans.pairs.judged`` says what a pair of statements means; written over all pairs of a bank, it is what results are checked against.
Here the pairs are met by equi-joins on what the deciding rules ask for: the same slot, the same attribute, the same key, an anchor that a
reversal names, or token sets that are alike. Whatever else there is has verdicts that retire nothing and suppress
nothing. Features take dozens of patterns a text, so equal texts are read once. As a verdict depends on two texts alone, pairs can also be
judged by text: each pair of texts that meets in any bank once, whatever the number of banks and statements that hold it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import datasets, dialect, pairs, ranking
from ..sources.relations import asked, said
from .graph import cut
from .similarity import jaccard_join

Inputs = dict[str, DataFrame] | None


def feature_table(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    """What the rules read of every statement."""
    rows = cut(dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, CAST(day AS DATE) AS day, text FROM said", inputs))
    texts = rows.select("text").distinct().selectExpr("0 AS bank", "0 AS ord", "CAST(NULL AS STRING) AS day", "text")
    read = dialect.run(spark, None, lambda d: f"WITH {said(d)}, {pairs.features(d)} SELECT * FROM features", {"said": texts}).drop("bank", "ord", "day").withColumnRenamed("text", "same")
    return cut(rows.join(cut(read), F.col("text").eqNullSafe(F.col("same"))).drop("same"))


def numbered(rows: DataFrame) -> DataFrame:
    """``tid, text``: every text of ``rows`` once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.select("text").distinct().repartition(parts, "text").select(F.monotonically_increasing_id().alias("tid"), "text"))


def by_number(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with what ``texts`` say of their texts."""
    return rows.join(texts.withColumnRenamed("text", "same"), F.col("text").eqNullSafe(F.col("same"))).drop("same")


def text_features(texts: DataFrame) -> DataFrame:
    """What the rules read of ``numbered`` texts, each as a statement of bank 0 in the place of its number."""
    told = texts.selectExpr("0 AS bank", "tid AS ord", "CAST(NULL AS STRING) AS day", "text")
    return cut(dialect.run(texts.sparkSession, None, lambda d: f"WITH {said(d)}, {pairs.features(d)} SELECT * FROM features", {"said": told}))


def judged_texts(statement, features: DataFrame, met: DataFrame) -> DataFrame:
    """What ``statement`` says of the pairs ``met(new, old)`` of texts, each once, as if they were statements of one bank."""
    spark = features.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = cut(met.distinct().repartition(parts, "new", "old").selectExpr("CAST(0 AS BIGINT) AS bank", "new AS new_ord", "old AS old_ord"))
    return dialect.run(spark, None, statement, {"said": features.select("bank", "ord", "day", "text"), "features": features, "met": met})


def may_replace(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    """``bank, new_ord, old_ord`` of all pairs of a bank whose newer statement may replace the older one."""
    rows = cut(dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, text FROM said", inputs))
    texts = numbered(rows)
    placed = cut(by_number(rows, texts).drop("text"))
    held = placed.groupBy("bank", "tid").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    new, old = held.select("bank", F.col("tid").alias("new"), "last"), held.select("bank", F.col("tid").alias("old"), "first")
    may = judged_texts(pairs.may_replace, text_features(texts), new.join(old, "bank").where("first < last").select("new", "old"))
    may = cut(may.select(F.col("new_ord").alias("new"), F.col("old_ord").alias("old")))
    new, old = (placed.select("bank", F.col("tid").alias(s), F.col("ord").alias(f"{s}_ord")) for s in ("new", "old"))
    return new.join(old, "bank").where("old_ord < new_ord").join(may, ["new", "old"]).select("bank", "new_ord", "old_ord")


def deciding_pairs(f: DataFrame, arrived: DataFrame | None = None, answers: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """``bank, new_ord, old_ord`` of all pairs that any deciding rule or the duplicate test can speak about; with ``arrived(bank, ord)`` or
    ``answers(bank, old_ord)`` only those with a new or an old side of these, which no other pair is made for. Not ``ordered``, either side of a
    pair may be the new one, and one row both."""
    before = "old_ord < new_ord" if ordered else "true"
    later = f if arrived is None else f.join(arrived.select("bank", "ord"), ["bank", "ord"], "left_semi")
    earlier = f if answers is None else f.join(answers.withColumnRenamed("old_ord", "ord"), ["bank", "ord"], "left_semi")

    def equal(column: str, where: str) -> DataFrame:
        new, old = (rows.where(where).select("bank", F.col(column).alias("same"), F.col("ord").alias(side)) for rows, side in ((later, "new_ord"), (earlier, "old_ord")))
        return new.join(old, ["bank", "same"]).where(before).select("bank", "new_ord", "old_ord")

    anchors = lambda rows, side: rows.select("bank", F.col("ord").alias(side), F.explode("anchors").alias("same"))
    named = anchors(later.where("reversal = 1"), "new_ord").join(anchors(earlier, "old_ord"), ["bank", "same"]).where(before).select("bank", "new_ord", "old_ord")
    sets = f.where(F.size("t") > 0).groupBy("bank", "t").agg(F.min("ord").alias("id"), F.collect_list("ord").alias("ords"))
    sets = cut(sets)
    like = jaccard_join(sets.select(F.col("bank").alias("key"), "id", "t"), pairs.OVERLAP).select("key", "a", "b")
    like = like.unionByName(like.select("key", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sets.select(F.col("bank").alias("key"), F.col("id").alias("a"), F.col("id").alias("b")))
    members = sets.select(F.col("bank").alias("key"), "id", F.explode("ords").alias("ord"))
    new_side, old_side = members.withColumnsRenamed({"id": "a", "ord": "new_ord"}), members.withColumnsRenamed({"id": "b", "ord": "old_ord"})
    if arrived is not None:
        new_side = new_side.join(arrived.select(F.col("bank").alias("key"), F.col("ord").alias("new_ord")), ["key", "new_ord"], "left_semi")
    if answers is not None:
        old_side = old_side.join(answers.withColumnRenamed("bank", "key"), ["key", "old_ord"], "left_semi")
    alike = (like.join(new_side, ["key", "a"]).join(old_side, ["key", "b"])
             .where(before).select(F.col("key").alias("bank"), "new_ord", "old_ord"))
    met = equal("topic", "topic IS NOT NULL").unionByName(equal("attr", "attr <> ''")).unionByName(equal("k", "k <> ''")).unionByName(named).unionByName(alike)
    return met.distinct()


def prepared(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> dict[str, DataFrame]:
    """Inputs with which ``plans.pairs.judged`` gives its deciding verdicts without pairing all with all."""
    f = (inputs or {}).get("features")
    f = feature_table(spark, sf_dir, inputs) if f is None else f
    limits = {side: inputs[side] for side in ("arrived", "answers") if inputs and side in inputs}
    return {**(inputs or {}), "features": f, "met": cut(deciding_pairs(f, **limits))}


def _deciding(statement, spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    return dialect.run(spark, sf_dir, statement, prepared(spark, sf_dir, inputs))


def replacements(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    """``bank, old_ord, new_ord``: the first statement that replaces each replaced one."""
    return _deciding(pairs.rules_pairs, spark, sf_dir, inputs)


def reconcile_answers(spark: SparkSession, sf_dir: str | None, inputs: Inputs = None) -> DataFrame:
    """Answers that did not stand on the day the question asks about: only banks with a question are read into pairs, and only what came after an answer is judged against it."""
    put = cut(dialect.run(spark, sf_dir, lambda d: f"WITH {asked(d)} SELECT qid, bank, day, question, answer FROM asked", inputs))
    told = dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, day, text FROM said", inputs)
    told = cut(told.join(put.select("bank").distinct(), "bank", "left_semi"))
    answers = put.select("bank", F.col("answer").alias("old_ord")).distinct()
    known = prepared(spark, None, {"said": told, "answers": answers})
    return dialect.run(spark, None, datasets.reconcile_answers, {**known, "asked": put})


def queries() -> dict:
    """Plans that ask for deciding verdicts alone; their own statements over all pairs stay their check."""
    return {p.__name__: partial(_deciding, p) for p in (pairs.rules_pairs, pairs.session_overrides, ranking.prompt_rows, ranking.render_prompt)} | {"reconcile_answers": reconcile_answers, "may_replace": may_replace}
