"""Verdicts by text: equal to the statement over all pairs of statements, and asked for once a pair of texts."""

from chronofold.operators import lifecycle, rules
from chronofold.plans import dialect, pairs

LINES = ["I live in Ghent", "I moved to Turin", "I stopped taking metformin", "I take metformin every morning", "My father must not eat sugar", "Always answer in French", "", None, "I live in Ghent"]


def _said(spark, banks):
    rows = [(b, k // 2 if b == 2 else k, "2025-01-01", t) for b in range(banks) for k, t in enumerate(LINES[b:] + LINES[:b] + LINES[:4])]  # bank 2 says two things at each place
    return spark.createDataFrame(rows + [(None, 1, None, "I live in Ghent"), (1, None, None, "I moved to Turin")], "bank long, ord long, day string, text string")


def test_may_replace_by_text_equals_all_pairs(spark, monkeypatch):
    said = _said(spark, 6)
    rows = lambda df: sorted(tuple(r) for r in df.select("bank", "new_ord", "old_ord").collect())
    want = rows(dialect.run(spark, None, pairs.may_replace, {"said": said}))
    met = []
    judge = rules.judged_texts
    monkeypatch.setattr(rules, "judged_texts", lambda statement, features, pairs_met: met.append((features, pairs_met)) or judge(statement, features, pairs_met))
    assert rows(rules.queries()["may_replace"](spark, None, {"said": said})) == want and len(want) > 100
    assert met[0][0].count() == len(set(LINES)) and met[0][1].distinct().count() <= len(set(LINES)) ** 2


def _operations(spark):
    said = [r for r in _said(spark, 6).collect() if r.bank is not None and r.ord is not None and r.bank != 2]
    rows = [(r.bank, r.ord * 10, "remember", r.ord, r.day, r.text) for r in said]
    for r in said:
        if r.ord % 3 == 1:
            rows += [(r.bank, r.ord * 10 + 21, "forget", r.ord, None, None), (r.bank, r.ord * 10 + 42, "restore", r.ord, None, None)]
        if r.ord % 4 == 2:
            rows.append((r.bank, r.ord * 10 + 33, "update", r.ord, None, LINES[r.ord % len(LINES)]))
    return spark.createDataFrame(rows, lifecycle.OPERATIONS)


def test_lifecycle_judges_a_pair_of_texts_once(spark, monkeypatch):
    met = []
    judge = lifecycle.judged_texts
    monkeypatch.setattr(lifecycle, "judged_texts", lambda statement, features, pairs_met: met.append(pairs_met) or judge(statement, features, pairs_met))
    ops = _operations(spark)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = plain(lifecycle.advance(ops))
    assert sum(r[-1] is not None for r in whole) > 10
    pairs_met = met[0].count()
    texts = len({t for t in LINES if t})
    assert met[0].distinct().count() <= texts**2 < pairs_met  # the banks share their texts
    # banks above the bound meet their texts by what the rules ask for: fewer pairs, the same facts
    monkeypatch.setattr(lifecycle, "FEW", 0)
    assert plain(lifecycle.advance(ops)) == whole and met[1].count() < pairs_met
