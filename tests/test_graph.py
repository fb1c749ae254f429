"""Loops over links against brute force, and operators on the caller's own DataFrames."""

from pathlib import Path

import numpy as np

from chronofold import catalog
from chronofold.operators import graph


def test_pagerank_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(f), int(n)) for f, n in zip(rng.integers(0, 30, 90), rng.integers(0, 12, 90))})
    facts, nodes = sorted({f for f, _ in pairs}), sorted({n for _, n in pairs})
    a = np.zeros((len(facts), len(nodes)))
    for f, n in pairs:
        a[facts.index(f), nodes.index(n)] = 1
    w = a * np.log(1 + len(facts) / a.sum(axis=0))
    out, back = w / w.sum(axis=1, keepdims=True), a / a.sum(axis=0)
    s = np.zeros(len(facts))
    s[:2] = 0.5
    m = s
    for _ in range(20):
        m = 0.5 * s + 0.5 * back @ (out.T @ m)
    got = graph.pagerank(spark.createDataFrame(pairs, "fact long, node long"), spark.createDataFrame([(facts[0], 1.0), (facts[1], 1.0)], "fact long, mass double"))
    scores = {r.fact: r.score for r in got.collect()}
    assert sorted(scores) == facts and np.allclose([scores[f] for f in facts], m)


def test_pagerank_walks_only_where_the_seeds_reach(spark, monkeypatch):
    pairs = [(f + 100 * part, n + 100 * part) for part in range(6) for f in range(9) for n in (f // 2, f % 3)]
    written = []
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: (written.append((out.columns, out.count())), out)[1])(keep(df)))
    got = {r.fact: r.score for r in graph.pagerank(spark.createDataFrame(pairs, "fact long, node long"), spark.createDataFrame([(0, 1.0)], "fact long, mass double"), rounds=4).collect()}
    assert len(got) == 54 and abs(sum(got.values()) - 1) < 1e-9 and all((v > 0) == (f < 100) for f, v in got.items())
    assert [n for columns, n in written if columns == ["fact", "m"]] == [9] * 4


def test_components_leave_one_round_on_disk(spark):
    folder = Path(graph.shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("graph-*"))
    got = graph.components(spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(2, 5, 6)], "bank long, a long, b long"))
    assert len(set(folder.glob("graph-*")) - before) == 1
    assert {(r.bank, r.name): r.component for r in got.collect()} == {**{(1, i): 0 for i in range(41)}, (2, 5): 5, (2, 6): 5}


def test_long_chains_and_cycles(spark):
    steps = [(1, f"f{i}", f"f{i + 1}") for i in range(200)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "a")]
    got = {(r.bank, r.folder): r.canon for r in graph.chain_ends(spark.createDataFrame(steps, "bank long, folder string, into_folder string")).collect()}
    assert all(got[(1, f"f{i}")] == "f200" for i in range(200)) and [got[(2, x)] for x in "abc"] == ["a", "b", "c"]


def test_operators_take_the_callers_rows(spark):
    said = spark.createDataFrame([(5, 1, "2025-01-01", "I live in Oslo"), (5, 2, "2025-02-01", "I moved to Bern last week"), (5, 3, "2025-03-01", "I moved to Bern last week")], "bank long, ord long, day string, text string")
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("events")
    rows = {(r.new_ord, r.old_ord): r.reason for r in catalog.apply(spark, "conflict_resolve", said=said).collect()}
    assert rows == {(2, 1): "slot", (3, 1): "slot", (3, 2): "none"}
    assert [(r.ord, r.duplicate_of) for r in catalog.apply(spark, "suppress_duplicates", said=said).collect()] == [(3, 2)]
    assert spark.table("events").columns == ["x"] and not [t.name for t in spark.catalog.listTables() if t.name.startswith("chronofold_")]
    spark.catalog.dropTempView("events")


def test_components_of_small_banks_make_no_rounds_and_large_ones_do(spark, monkeypatch):
    rng = np.random.default_rng(5)
    links = [(b, f"a{x}", f"b{y}") for b in range(25) for x, y in rng.integers(0, 20, (12, 2))] + [(30, f"n{i}", f"n{i + 1}") for i in range(40)] + [(None, "x", "y"), (3, None, "y")]
    want = {}
    for bank, a, b in links:
        if bank is not None and a is not None:
            one, two = want.get((bank, a), {a}), want.get((bank, b), {b})
            want.update({(bank, x): one | two for x in one | two})
    for most, rounds in ((250_000, 0), (30, 1)):
        made = []
        keep = graph._by_rounds
        monkeypatch.setattr(graph, "BANK", most)
        monkeypatch.setattr(graph, "_by_rounds", lambda rows: (made.append(rows.count()), keep(rows))[1])
        got = graph.components(spark.createDataFrame(links, "bank long, a string, b string"))
        assert {(r.bank, r.name): r.component for r in got.collect()} == {key: min(names) for key, names in want.items()} and made == [40] * rounds
        monkeypatch.undo()
