"""Set-similarity joins, duplicates and sequence ratios against brute force and the standard matcher."""

import difflib
import random

import pytest

from chronofold import catalog
from chronofold.operators import similarity


def _sets(rng, keys=4, size=60):
    words = [f"w{k}" for k in range(14)] + ["the"] * 6
    out = []
    for key in range(keys):
        for k in range(size):
            base = list(out[-1][2]) if out and rng.random() < 0.5 else []
            t = sorted({*base[: rng.randrange(len(base) + 1)], *(rng.choice(words) for _ in range(rng.randrange(0, 9)))})
            out.append((key, k, t))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 2 / 3, 0.85, 1.0])
def test_jaccard_pairs_equal_brute_force(spark, threshold):
    rows = _sets(random.Random(1))
    df = spark.createDataFrame(rows + [(None, 1, ["w1"]), (None, 2, ["w1"]), (9, 1, None), (9, 2, [])], "key long, id long, t array<string>").repartition(3)
    got = {(r.key, r.a, r.b): r.j for r in similarity.jaccard_join(df, threshold).collect()}
    want = {}
    for key, a, x in rows:
        for other, b, y in rows:
            if key == other and b < a and x and y and (j := len({*x} & {*y}) / len({*x} | {*y})) >= threshold:
                want[key, a, b] = j
    assert len(want) > 5 and got == want


@pytest.mark.parametrize("shared", [1, 3, 5])
def test_overlaps_equal_brute_force(spark, shared):
    rows = _sets(random.Random(2))
    got = {(r.key, r.a, r.b): r.inter for r in similarity.overlap_join(spark.createDataFrame(rows, "key long, id long, t array<string>"), shared).collect()}
    assert got == {(k, a, b): n for k, a, x in rows for o, b, y in rows if k == o and b < a and (n := len({*x} & {*y})) >= shared} and got


def test_sets_of_common_words_alone_do_not_meet_all_with_all(spark):
    """Every set holds the same frequent words; what meets is what shares a rare one."""
    rows = [(0, k, ["a", "b", "c", "d", f"own{k}", f"mine{k}", *(f"{x}{k // 2}" for x in "pqrs")]) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, id long, t array<string>")
    met = similarity._meet(df, similarity.F.lit(10 - 6 + 1), lambda a, b: similarity.F.lit(1))
    assert met.count() == 200  # 79,800 pairs in all
    assert similarity.jaccard_join(df, 0.6).count() == 200


def test_ratio_equals_the_standard_matcher():
    rng = random.Random(3)
    for k in range(10_000):
        words = "abcdefgh"[: rng.randrange(1, 9)]
        a, b = ([rng.choice(words) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        if k % 3 == 0:
            b = a[: rng.randrange(len(a) + 1)] + b[: rng.randrange(4)] + a[rng.randrange(len(a) + 1) :]
        assert similarity.match_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    for _ in range(60):  # long second sequences leave frequent tokens out
        a, b = ([rng.choice("aaabcdefghijklmnopqrstuvwxyz") if rng.random() < 0.7 else str(rng.randrange(90)) for _ in range(rng.randrange(150, 420))] for _ in range(2))
        assert similarity.match_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_of_pairs_and_its_bounds(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice("abcd") for _ in range(rng.randrange(0, 8))], [rng.choice("abcd") for _ in range(rng.randrange(0, 8))]) for k in range(300)] + [(900, None, ["a"]), (901, None, None), (902, [], [])]
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>").repartition(3)
    want = {k: difflib.SequenceMatcher(None, x or [], y or []).ratio() for k, x, y in rows}
    for least in (0.0, 0.5, 0.8):
        assert {r.id: r.ratio for r in similarity.with_ratio(df, "x", "y", least).collect()} == {k: r for k, r in want.items() if r >= least}
    assert similarity.with_ratio(df.where("false"), "x", "y").count() == 0


def test_sequence_matches_on_the_callers_statements(spark):
    lines = ["I live in Ghent near the old harbour", "I live in Ghent, near the old harbour!", "near the old harbour I live in Ghent", "I live in Cork near the old harbour", "something else entirely", "", " ", None]
    said = spark.createDataFrame([(b, k, "2025-01-01", t) for b in (1, 2) for k, t in enumerate(lines)], "bank long, ord long, day string, text string")
    got = {(r.bank, r.new_ord, r.old_ord): r.ratio for r in catalog.apply(spark, "sequence_matches", said=said).collect()}
    assert got == {(b, 3, 0): 0.875 for b in (1, 2)}  # the second line has the words of the first: one class


def test_duplicates_of_many_copies_name_the_newest_before(spark):
    lines = ["my phone is a grey Fairphone with a cracked screen today", "My phone is a grey Fairphone, with a cracked screen today", "my phone is not a grey Fairphone with a cracked screen today", "hello"]
    order = [0, 1, 0, 3, 2, 0, 3, 1, 2]
    said = spark.createDataFrame([(5, 10 + k, "2025-01-01", lines[x]) for k, x in enumerate(order)] + [(6, 1, "2025-01-01", lines[0]), (6, 2, "2025-01-01", None)], "bank long, ord long, day string, text string")
    got = sorted((r.bank, r.ord, r.duplicate_of) for r in catalog.apply(spark, "suppress_duplicates", said=said).collect())
    assert got == [(5, 11, 10), (5, 12, 11), (5, 15, 12), (5, 16, 13), (5, 17, 15), (5, 18, 14)]


def test_scenarios_with_the_names_swapped_are_copies(spark):
    plot = ["I live in {0} these days", "My manager at work is {1}", "I moved to {2} last month", "Lunch with {1} was fine", "I commute by tram to the office"]
    names = [("Ghent", "Bram", "Turin"), ("Cork", "Odile", "Porto"), ("Lyon", "Vera", "Graz")]
    rows = [(b, k, f"2025-01-0{k + 1}", t.format(*n)) for b, n in enumerate(names[:2]) for k, t in enumerate(plot)]
    rows += [(2, k, f"2025-01-0{k + 1}", t) for k, t in enumerate(["I keep bees in the garden", "I live in Lyon these days", "My sister paints boats"])]
    said = spark.createDataFrame(rows, "bank long, ord long, day string, text string")
    questions = ["Where do I live?", "Who leads my team?", "What did I eat?", "How do I commute?"]
    put = [(b * 10 + k, b, "2025-03-01", q, 0) for b, n in ((0, 4), (1, 4), (2, 3)) for k, q in enumerate(questions[:n])]
    asked = spark.createDataFrame(put, "qid long, bank long, day string, question string, answer long")
    got = sorted((r.bank, r.other, r.test, r.shared) for r in catalog.apply(spark, "scenario_copies", said=said, asked=asked).collect())
    assert got == [(1, 0, "pattern", 2), (1, 0, "questions", 4), (1, 0, "statements", 5)]
