"""Search and prompt over what stands: cases by hand, and chains followed by doubling."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold import catalog
from chronofold.operators import search

QUESTION = "Where do I live now?"


def _found(spark, lines, question=QUESTION, by="2025-12-01", bank=1):
    said = spark.createDataFrame([(bank, k, f"2025-{k:02d}-01", t) for k, t in enumerate(lines, 1)], "bank long, ord long, day string, text string")
    asked = spark.createDataFrame([(7, bank, by, question, 1)], "qid long, bank long, day string, question string, answer long")
    return [lines[r.ord - 1] for r in sorted(catalog.apply(spark, "hybrid_search", said=said, asked=asked).collect(), key=lambda r: r.r)]


def test_what_was_replaced_does_not_answer(spark):
    assert _found(spark, ["I live in Ghent", "I moved to Turin"]) == ["I moved to Turin"]


def test_as_of_a_day_what_stood_then_answers(spark):
    lines = ["I live in Ghent", "My dog Rex sleeps on the sofa", "I moved to Turin", "I moved to Porto"]
    assert _found(spark, lines, by="2025-02-15") == ["I live in Ghent"]
    assert _found(spark, lines, by="2025-03-15") == ["I moved to Turin"]
    assert _found(spark, lines) == ["I moved to Porto"]


def test_the_head_of_the_chain_answers_for_a_retired_hit(spark):
    # no word of the question is in what stands; what it replaced has them
    lines = ["My morning drink is black coffee", "My morning drink is no longer coffee, now tea", "I quit tea for good"]
    got = _found(spark, lines, "black coffee?")
    assert got and got[0] != lines[0] and lines[0] not in got


def test_nothing_found_falls_back_to_statements_that_hold_the_question(spark):
    lines = ["The Lindenhof key is under the mat", "My sister lives in Cork"]
    assert _found(spark, lines, "lindenhof key") [0] == lines[0]
    assert _found(spark, lines, "zzz") == []


def test_the_prompt_shows_what_stands_and_keeps_place_eleven(spark):
    lines = [f"I also like food number{k}" for k in range(1, 11)] + ["I live in Ghent", "I live in Turin now", "I am allergic to walnuts"]
    said = spark.createDataFrame([(1, k, f"2025-01-{k:02d}", t) for k, t in enumerate(lines[:11], 1)], "bank long, ord long, day string, text string")
    (row,) = catalog.apply(spark, "render_prompt", said=said).collect()
    assert row.block.split("\n")[0] == "Known facts:" and "- I live in Ghent" in row.block.split("\n")
    said = spark.createDataFrame([(1, k, f"2025-01-{k:02d}", t) for k, t in enumerate(lines, 1)], "bank long, ord long, day string, text string")
    (row,) = catalog.apply(spark, "render_prompt", said=said).collect()
    assert row.block.split("\n")[:3] == ["Known facts:", "- I am allergic to walnuts", "- I live in Turin now"] and "Ghent" not in row.block


@pytest.mark.parametrize("seed", [1, 2])
def test_heads_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    edges, day = {}, {}
    for bank in range(4):
        for k in range(40):
            day[bank, k] = k // 2
            if k and rng.random() < 0.95:
                edges[bank, rng.randrange(max(0, k - 3), k)] = k
    e = spark.createDataFrame([(b, o, n, day[b, n]) for (b, o), n in edges.items()], "bank long, old_ord long, new_ord long, new_day int")
    hits = [(b, k, by) for b in range(4) for k in range(40) for by in (5, 12, 99) if day[b, k] <= by]
    got = {(r.bank, r.ord, r.by): r.head for r in search.heads(spark.createDataFrame(hits, "bank long, ord long, by int"), e).collect()}
    for b, k, by in hits:
        at = k
        while (b, at) in edges and day[b, edges[b, at]] <= by:
            at = edges[b, at]
        assert got[b, k, by] == at
    assert search.heads(spark.createDataFrame(hits, "bank long, ord long, by int"), e.where(F.lit(False))).where("head <> ord").count() == 0
