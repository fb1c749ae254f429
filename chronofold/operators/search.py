"""Search over what stands: statements that something later replaced do not answer, what replaced them does.

A question is answered as of its day: a statement counts if it was said by then and what replaced it, if anything, was not. Lexical
ranking: the slot the question asks about, coverage of its stems, newest, most specific. Semantic ranking: a stand-in
encoder (similarity of token sets) from 0.30. Where no standing statement is a lexical hit but retired ones are, the heads of
their chains take the hits' places, in the order in which the hits would have come. Reciprocal ranks of lexical hits on
the slot and of semantic ones fuse; other lexical hits follow. Where nothing is found, standing statements that hold the whole question.

All ranks are windows over one partitioning by question. Chains are followed by doubling: step tables of 1, 2, 4, ... replacements, each
with the day of its end, from the longest to the shortest, taken where the end was said by the question's day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import dialect
from ..plans.pairs import REPLACES, judged
from ..sources.relations import asked, said
from .graph import cut
from .rules import feature_table, replacements

SIMILAR, SHOWN, FUSION = 0.3, 20, 60


def heads(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """``hits(bank, ord, by, ...)`` with ``head``: the last replacement of a statement that was said by day ``by``.

    ``edges(bank, old_ord, new_ord, new_day)``: one at most for each old statement, each to a later one, so chains end. The number of joins
    grows with the logarithm of the longest chain.
    """
    steps = [edges.select("bank", F.col("old_ord").alias("at"), F.col("new_ord").alias("to"), F.col("new_day").alias("day"))]
    while True:
        last = steps[-1]
        onward = last.select("bank", F.col("at").alias("to"), F.col("to").alias("further"), F.col("day").alias("then"))
        double = cut(last.select("bank", "at", "to").join(onward, ["bank", "to"]).select("bank", "at", F.col("further").alias("to"), F.col("then").alias("day")))
        if double.isEmpty():
            break
        steps.append(double)
    out = hits.withColumn("head", F.col("ord"))
    for step in reversed(steps):
        jump = step.select("bank", F.col("at").alias("head"), "to", "day")
        out = out.join(jump, ["bank", "head"], "left").withColumn("moved", F.when(F.col("day") <= F.col("by"), F.col("to"))).withColumn("head", F.coalesce("moved", "head")).drop("to", "day", "moved")
    return out


def hybrid_search(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """``qid, bank, ord, r``: the statements that answer each question as of its day, best first, ``SHOWN`` at most."""
    def put(d) -> str:
        return f"WITH {asked(d)} SELECT qid, bank, CAST(day AS DATE) AS by, lower(question) AS question, {T.query_topic(d, 'question')} AS wanted, {T.stems(d, 'question')} AS qs, {d.tokens('question')} AS qt FROM asked"

    q = cut(dialect.run(spark, sf_dir, put, inputs))
    # banks that nobody asks about are not read further
    told = dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, day, text FROM said", inputs).join(q.select("bank").distinct(), "bank", "left_semi")
    known = feature_table(spark, None, {"said": told})
    stems = dialect.run(spark, None, lambda d: f"SELECT bank, ord, {T.stems(d, 'text')} AS stems FROM {d.inputs['known']}", {"known": known})
    f = cut(known.select("bank", "ord", "day", F.lower("text").alias("low"), "topic", "t").join(stems.withColumnRenamed("stems", "s"), ["bank", "ord"]))
    e = replacements(spark, None, {"said": told, "features": known})
    e = cut(e.join(f.select("bank", F.col("ord").alias("new_ord"), F.col("day").alias("new_day")), ["bank", "new_ord"]))
    dated = f.join(e.select("bank", F.col("old_ord").alias("ord"), "new_day"), ["bank", "ord"], "left")
    met = q.join(dated, "bank").where("day <= by")
    both, either = F.size(F.array_intersect("qt", "t")), F.size(F.array_union("qt", "t"))
    sim = F.when((F.size("qt") > 0) & (F.size("t") > 0), F.round(both.cast("double") / either, 6)).otherwise(F.lit(0.0))
    shared = F.size(F.array_intersect("qs", "s"))
    coverage = F.round(F.when(F.size("qs") > 0, shared.cast("double") / F.size("qs")).otherwise(F.lit(0.0)), 6)
    p = met.select("qid", "bank", "ord", "day", "by", (F.col("new_day").isNull() | (F.col("new_day") > F.col("by"))).alias("stands"),
                   F.coalesce(F.col("wanted") == F.col("topic"), F.lit(False)).alias("on_topic"), (shared > 0).alias("touches"), coverage.alias("coverage"), F.size("s").alias("specific"),
                   sim.alias("sim"), F.contains("low", "question").alias("holds"))
    hit = F.col("on_topic") | F.col("touches")
    p = p.withColumn("lex", F.col("stands") & hit).withColumn("sem", F.col("stands") & (F.col("sim") >= SIMILAR)).where(hit | F.col("sem") | (F.col("stands") & F.col("holds")))
    mine = W.partitionBy("qid", "bank")
    best = (F.desc("on_topic"), F.desc("coverage"), F.desc("day"), F.desc("specific"), F.desc("ord"))
    place = F.row_number().over(mine.orderBy(F.desc("lex"), *best))
    likest = F.row_number().over(mine.orderBy(F.desc("sem"), F.desc("sim"), F.desc("ord")))
    p = cut(p.withColumns({"any_lex": F.max("lex").over(mine), "place": place, "lr": F.when(F.col("lex"), place), "sr": F.when(F.col("sem"), likest)}))
    # no standing hit: the heads of the retired hits' chains, in the hits' order
    lost = heads(p.where(~F.col("any_lex") & ~F.col("stands") & hit).select("qid", "bank", "ord", "by", "place"), e)
    first = lost.groupBy("qid", "bank", F.col("head").alias("ord")).agg(F.min("place").alias("seen"))
    first = first.withColumn("hr", F.row_number().over(mine.orderBy("seen", "ord"))).select("qid", "bank", "ord", "hr")
    # a head may share nothing with the question; its slot is its statement's
    topics = f.select("bank", "ord", "topic").join(q.select("qid", "bank", "wanted"), "bank").where("topic = wanted").select("qid", "bank", "ord", F.lit(True).alias("head_on_topic"))
    first = first.join(topics, ["qid", "bank", "ord"], "left")
    u = (p.where("stands").join(first, ["qid", "bank", "ord"], "full")
         .withColumns({"lr": F.coalesce("lr", "hr"), "on_topic": F.coalesce("on_topic", "head_on_topic", F.lit(False))}))
    trusted = F.when(F.col("lr").isNotNull() & F.col("on_topic"), F.col("lr"))
    # ranks among trusted hits alone: on-topic hits come first among standing ones, not among heads
    tr = F.when(trusted.isNotNull(), F.row_number().over(mine.orderBy(trusted.asc_nulls_last())))
    found = F.max(F.col("lr").isNotNull() | F.col("sr").isNotNull()).over(mine)
    u = u.withColumns({"tr": tr, "found": found}).where(F.col("lr").isNotNull() | F.col("sr").isNotNull() | (~F.col("found") & F.col("holds")))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(FUSION) + F.col(c)), F.lit(0.0))
    group = F.when(F.col("tr").isNotNull() | F.col("sr").isNotNull(), 0).when(F.col("lr").isNotNull(), 1).otherwise(2)
    far = F.lit(999_999)
    order = mine.orderBy("grp", F.desc("score"), F.coalesce("lr", far), F.coalesce("sr", far), F.desc("ord"))
    ranked = u.withColumns({"grp": group, "score": F.round(part("tr") + part("sr"), 12)}).withColumn("r", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("r") <= SHOWN).select("qid", "bank", "ord", "r")


def _oracle(d) -> str:
    """The same rows by one statement, with chains followed one step at a time."""
    stems = lambda x: T.stems(d, x)
    order = "on_topic DESC, round(CASE WHEN asked_n > 0 THEN CAST(shared AS DOUBLE) / asked_n ELSE 0e0 END, 6) DESC, day DESC, said_n DESC, ord DESC"
    return f"""WITH RECURSIVE {said(d)}, {asked(d)}, {judged(d)}, edges AS (SELECT bank, old_ord, min(new_ord) AS new_ord FROM verdicts WHERE reason IN {REPLACES} GROUP BY bank, old_ord),
      e AS (SELECT edges.*, CAST(s.day AS DATE) AS new_day FROM edges JOIN said s ON s.bank = edges.bank AND s.ord = edges.new_ord),
      f AS (SELECT x.bank, x.ord, CAST(x.day AS DATE) AS day, x.text, {T.topic(d, 'x.text')} AS topic, {stems('x.text')} AS s, {d.tokens('x.text')} AS t, e.new_day FROM said x LEFT JOIN e ON e.bank = x.bank AND e.old_ord = x.ord),
      q AS (SELECT qid, bank, CAST(day AS DATE) AS day, lower(question) AS question, {T.query_topic(d, 'question')} AS wanted, {stems('question')} AS s, {d.tokens('question')} AS t FROM asked),
      p AS (SELECT q.qid, q.bank, f.ord, f.day, q.day AS by_day, CASE WHEN f.new_day IS NULL OR f.new_day > q.day THEN 1 ELSE 0 END AS stands, CASE WHEN q.wanted = f.topic THEN 1 ELSE 0 END AS on_topic, {d.n(d.both('q.s', 'f.s'))} AS shared, {d.n('q.s')} AS asked_n, {d.n('f.s')} AS said_n,
          round({T.jaccard(d, 'q.t', 'f.t')}, 6) AS sim, CASE WHEN contains(lower(f.text), q.question) THEN 1 ELSE 0 END AS holds FROM q JOIN f ON q.bank = f.bank AND f.day <= q.day),
      own AS (SELECT qid, ord, on_topic, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS lr FROM p WHERE stands = 1 AND (on_topic = 1 OR shared > 0)),
      gone AS (SELECT qid, bank, ord, by_day, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS place FROM p WHERE stands = 0 AND (on_topic = 1 OR shared > 0) AND qid NOT IN (SELECT qid FROM own)),
      walk AS (SELECT qid, bank, by_day, place, ord AS here FROM gone UNION ALL SELECT w.qid, w.bank, w.by_day, w.place, e.new_ord FROM walk w JOIN e ON e.bank = w.bank AND e.old_ord = w.here WHERE e.new_day <= w.by_day),
      ends AS (SELECT qid, bank, place, max(here) AS ord FROM walk GROUP BY qid, bank, place), seen AS (SELECT qid, bank, ord, min(place) AS place FROM ends GROUP BY qid, bank, ord),
      l AS (SELECT qid, ord, on_topic, lr FROM own UNION ALL SELECT seen.qid, seen.ord, p.on_topic, row_number() OVER (PARTITION BY seen.qid ORDER BY seen.place, seen.ord) AS lr FROM seen JOIN p ON p.qid = seen.qid AND p.ord = seen.ord),
      m AS (SELECT qid, ord, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, ord DESC) AS sr FROM p WHERE sim >= 0.3 AND stands = 1),
      trusted AS (SELECT qid, ord, row_number() OVER (PARTITION BY qid ORDER BY lr) AS tr FROM l WHERE on_topic = 1),
      u AS (SELECT p.qid, p.bank, p.ord, l.lr, m.sr, t.tr, p.holds, max(CASE WHEN l.lr IS NOT NULL OR m.sr IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.qid) AS found
        FROM p LEFT JOIN l ON l.qid = p.qid AND l.ord = p.ord LEFT JOIN m ON m.qid = p.qid AND m.ord = p.ord LEFT JOIN trusted t ON t.qid = p.qid AND t.ord = p.ord WHERE p.stands = 1),
      g AS (SELECT qid, bank, ord, CASE WHEN tr IS NOT NULL OR sr IS NOT NULL THEN 0 WHEN lr IS NOT NULL THEN 1 ELSE 2 END AS grp, round(coalesce(1e0 / (60 + tr), 0) + coalesce(1e0 / (60 + sr), 0), 12) AS score, lr, sr
        FROM u WHERE lr IS NOT NULL OR sr IS NOT NULL OR (found = 0 AND holds = 1)),
      r AS (SELECT qid, bank, ord, CAST(row_number() OVER (PARTITION BY qid ORDER BY grp, score DESC, coalesce(lr, 999999), coalesce(sr, 999999), ord DESC) AS BIGINT) AS r FROM g)
      SELECT qid, bank, ord, r FROM r WHERE r <= 20"""


def queries() -> dict:
    return {"hybrid_search": hybrid_search}


def oracle_sql() -> dict[str, str]:
    return {"hybrid_search": _oracle(dialect.DUCK)}
