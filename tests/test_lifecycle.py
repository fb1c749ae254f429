"""Forgetting, restoring and editing: cases by hand, and one operation at a time against all at once."""

import random

import pytest

from chronofold.operators.lifecycle import OPERATIONS, STATE, advance

PORTO, LISBON, BERLIN = "I live in Porto", "I moved to Lisbon", "I moved to Berlin"

CASES = {
    "a replacement forgotten brings back what it replaced": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("forget", 2)], {1}),
    "a replacement restored replaces again": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("forget", 2), ("restore", 2)], {2}),
    "restored after it was replaced while forgotten": ([("remember", 1, PORTO), ("forget", 1), ("remember", 2, LISBON), ("restore", 1)], {2}),
    "restored and replaced by nothing": ([("remember", 1, "My editor is Vim"), ("remember", 2, LISBON), ("forget", 1), ("restore", 1)], {1, 2}),
    "both forgotten": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("forget", 1), ("forget", 2)], set()),
    "both forgotten, then both restored": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("forget", 1), ("forget", 2), ("restore", 2), ("restore", 1)], {2}),
    "the middle of a chain forgotten": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("remember", 3, BERLIN), ("forget", 2)], {3}),
    "the newest of a chain forgotten": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("remember", 3, BERLIN), ("forget", 3)], {2}),
    "back to an old fact": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("remember", 3, PORTO)], {3}),
    "a repeated fact is not stored": ([("remember", 1, PORTO), ("remember", 2, PORTO)], {1}),
    "an edit away from the slot brings back what it had replaced": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("update", 2, "My editor is Vim")], {1, 2}),
    "an edit into the slot replaces": ([("remember", 1, PORTO), ("remember", 2, "My editor is Vim"), ("update", 2, LISBON)], {2}),
    "an edit into the slot is replaced by what came later": ([("remember", 1, "My editor is Vim"), ("remember", 2, LISBON), ("update", 1, PORTO)], {2}),
    "a replaced fact edited away stands again": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("update", 1, "My editor is Vim")], {1, 2}),
    "an edit to an order changes nothing": ([("remember", 1, PORTO), ("update", 1, "Always answer in French"), ("update", 1, None), ("update", 1, "  ")], {1}),
    "orders and empty texts are not stored": ([("remember", 1, "Always answer in French"), ("remember", 2, ""), ("remember", 3, None)], set()),
    "unknown facts and known ids change nothing": ([("forget", 9), ("restore", 9), ("update", 9, PORTO), ("remember", 1, PORTO), ("remember", 1, LISBON)], {1}),
    "an edit of a forgotten fact waits for its return": ([("remember", 1, PORTO), ("remember", 2, LISBON), ("forget", 1), ("update", 1, "My editor is Vim"), ("restore", 1)], {1, 2}),
}


def _ops(spark, by_bank):
    rows = [(bank, k, op[0], op[1], f"2025-01-{op[1]:02d}", op[2] if len(op) > 2 else None) for bank, ops in by_bank.items() for k, op in enumerate(ops)]
    return spark.createDataFrame(rows, OPERATIONS)


def _standing(rows):
    facts = {(r.bank, r.id): r for r in rows}
    out = {}
    for (bank, fact), r in facts.items():
        at, seen = r.replaced_by, set()
        while at is not None and not facts[bank, at].alive and at not in seen:
            seen.add(at)
            at = facts[bank, at].replaced_by
        if r.alive and (at is None or not facts[bank, at].alive):
            out.setdefault(bank, set()).add(fact)
    return out


def test_cases_by_hand(spark):
    names = list(CASES)
    rows = advance(_ops(spark, {k: CASES[n][0] for k, n in enumerate(names)})).collect()
    got = _standing(rows)
    assert {n: got.get(k, set()) for k, n in enumerate(names)} == {n: CASES[n][1] for n in names}
    texts = {(names[r.bank], r.id): r.text for r in rows}
    assert texts["an edit to an order changes nothing", 1] == PORTO
    links = {(names[r.bank], r.id): r.replaced_by for r in rows}
    assert links["a replacement forgotten brings back what it replaced", 1] == 2  # the link stays, only its reading changes
    assert links["back to an old fact", 1] == 2 and links["back to an old fact", 2] == 3


def test_step_by_step_equals_all_at_once(spark):
    rng = random.Random(12)
    lines = ["I live in {}", "I moved to {}", "My manager is {}", "My boss is {} now", "My favourite colour is {}", "I stopped taking {}", "I take {} every morning", "Always answer in {}"]
    by_bank = {}
    for bank in range(5):
        ops, top = [], 0
        for _ in range(24):
            kind = rng.choice(["remember", "remember", "forget", "restore", "update"])
            text = rng.choice(lines).format(rng.choice(["Ghent", "Turin", "Cork", "green"]))
            top += kind == "remember"
            ops.append((kind, top if kind == "remember" else rng.randrange(0, top + 2), text))
        by_bank[bank] = ops
    ops = _ops(spark, by_bank)
    whole = sorted(map(tuple, advance(ops).collect()), key=repr)
    assert sum(r[-1] is not None for r in whole) > 5 and any(not r[4] for r in whole)
    state = None
    for lo, hi in ((0, 1), (1, 9), (9, 10), (10, 24)):
        state = spark.createDataFrame(advance(ops.where(f"seq >= {lo} AND seq < {hi}"), state).collect(), STATE)
    assert sorted(map(tuple, state.collect()), key=repr) == whole
    # only the banks that are named come back
    assert {r.bank for r in advance(ops.where("bank = 3 AND seq = 23"), state).collect()} == {3}
    assert advance(ops.where("false")).count() == 0
