"""op2 measures only windows that hold a run of bytes from the toxic dictionary, and counts the same."""

import random

from chronofold.llm import toxicity


def test_windows_that_cannot_save_are_not_measured():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(1, 9)))
    model = toxicity.ToxicModel(b" zzyxqueil zzyxqueon  zzyxquest veja ", " ".join(word() for _ in range(3000)).encode(), (0.0,) * 6)
    texts = [" ".join(rng.choice(["zzyxqueil", "vejaZ", "é", "x" * 40]) if rng.random() < 0.02 else word() for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "a", "a b", "zzyxqueil", " zzyxquest a "]
    new, plain = toxicity.WindowScorer(model), toxicity.WindowScorer(model)
    assert new.skips
    plain.skips = False
    assert [new.counts(t) for t in texts] == [plain.counts(t) for t in texts]
    short = [t for t in texts if t and "x" * 40 not in t]
    new.clear(), plain.clear()
    assert [new.counts(t) for t in short] == [plain.counts(t) for t in short] and sum(plain.counts(t)[0] for t in short) > 10
    assert len(new) < len(plain) / 5


def test_a_trained_model_measures_only_windows_with_a_run_that_only_its_toxic_dictionary_holds():
    rng = random.Random(5)
    parts = ["tion", "ment", "able", "over", "ingl", "stra", "ello", "ques", "ara", "bo", "ri"]
    known = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    plain = [" ".join(rng.choice(known) for _ in range(60)) for _ in range(160)]
    # the toxic words are made of the same beginnings, so most of their runs of four bytes are everywhere
    bad = [" ".join([*t.split()[:20], rng.choice(["grunktion", "overblork", "questvex"]), *t.split()[20:], rng.choice(["grunkment", "overblork"])]) for t in plain[:80]]
    model = toxicity.fit(bad[:60], plain[80:140], 0.5)
    assert b"\0" not in model.toxic + model.ordinary  # text only, nothing of a trained dictionary's tables
    texts = [*bad[60:], *plain[140:], bad[61].replace(" ", ""), "é" * 90 + " " + bad[62], "x" * 40 + " grunktion", "questvex " + "y" * 70, "ab\n0123 grunk\0tion b", "ello", "overblork", "", None]
    new, whole = toxicity.WindowScorer(model), toxicity.WindowScorer(model)
    assert new.skips
    whole.telling, whole.skips = set(), False
    assert [new.counts(t) for t in texts] == [whole.counts(t) for t in texts] and sum(whole.counts(t)[0] for t in texts) > 30
    assert len(new) < len(whole) / 5 and any(len(w) == toxicity.RUN for w in new)
    for t in texts:
        words = (t or "").lower().encode().split()
        assert set(new.worth(words) if words else []) == {w for w in (a + b" " + b for a, b in zip(words, words[1:])) if any(g in w for g in new.telling)}
