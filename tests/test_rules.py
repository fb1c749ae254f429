"""Pairs that only some statements ask for."""

from pyspark.sql import functions as F

from chronofold import catalog
from chronofold.operators import rules

SAID = [(b, k, f"2025-01-{k:02d}", t) for b in (1, 2) for k, t in enumerate(["I live in Ghent", "I moved to Turin", "My manager is Bram", "I stopped taking metformin", "I live in Ghent", "I take metformin every morning", "My boss is Odile now"], 1)]


def test_only_asked_pairs_are_met(spark):
    said = spark.createDataFrame(SAID, "bank long, ord long, day string, text string")
    f = rules.feature_table(spark, None, {"said": said})
    rows = lambda df: sorted(tuple(r) for r in df.select("bank", "new_ord", "old_ord").collect())
    whole = rows(rules.deciding_pairs(f))
    some = spark.createDataFrame([(1, 5), (2, 2), (2, 7)], "bank long, ord long")
    new, old = {tuple(r) for r in some.collect()}, {tuple(r) for r in some.collect()}
    assert rows(rules.deciding_pairs(f, arrived=some)) == [r for r in whole if (r[0], r[1]) in new] != []
    assert rows(rules.deciding_pairs(f, answers=some.withColumnRenamed("ord", "old_ord"))) == [r for r in whole if (r[0], r[2]) in old] != []


def test_answers_are_judged_in_asked_banks_alone(spark, monkeypatch):
    said = spark.createDataFrame(SAID, "bank long, ord long, day string, text string")
    asked = spark.createDataFrame([(9, 1, "2025-01-01", "Where do I live?", 1), (10, 1, "2025-01-03", "Where do I live?", 1), (11, 1, "2025-01-09", "Who is my boss?", 7)], "qid long, bank long, day string, question string, answer long")
    seen = []
    met = rules.deciding_pairs
    monkeypatch.setattr(rules, "deciding_pairs", lambda f, **k: seen.append(f) or met(f, **k))
    got = {r.qid: r.stands for r in catalog.apply(spark, "reconcile_answers", said=said, asked=asked).collect()}
    assert got == {9: 1, 10: 0, 11: 1}
    assert [f.select(F.collect_set("bank")).first()[0] for f in seen] == [[1]]
