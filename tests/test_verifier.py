"""The verifier's desk under a fake clock, as a stream over shuffled micro-batches, over a restart, and against a plain simulation."""

import json
import random

import pytest

from chronofold.streaming.verifier import DECISIONS, MESSAGES, Desk, Marks, Message, Policy, Unavailable, Verdict, judge_by_words, messages, replay, verify_stream

OLD, NEW = "Spotify fills my whole day", "Changed over to Tidal, it came with the phone"
YES = Verdict("replaces", 0.99)


def fact(i, text, ms=None):
    return Message("fact", i, i if ms is None else ms, text, -1, "")


def ask(i, text, *candidates):
    return Message("ask", i, i, text, -1, json.dumps([{"id": c, "text": t, "sim": 0.5} for c, t in candidates]))


class Scene:
    """A desk, a clock that the test moves, and a script of answers; the last one is repeated."""

    def __init__(self, *script, policy=Policy()):
        self.script, self.asked, self.seq, self.now = list(script), [], 0, 1000
        self.desk = Desk(7, {}, {}, {}, Marks(), self.answer, policy)

    def answer(self, new, old):
        self.asked.append((self.now, old))
        step = self.script.pop(0) if len(self.script) > 1 else self.script[0]
        if isinstance(step, type) and issubclass(step, Exception):
            raise step("scripted")
        return step

    def say(self, *said):
        out = []
        for m in said:
            self.seq += 1
            out += self.desk.take(self.seq, m, self.now)
        return out

    def wait(self, ms):
        self.now += ms
        return self.desk.work(self.now)


def test_a_confirmed_update_retires_the_old_fact():
    s = Scene(YES)
    assert s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD))) == [(7, 2, 1, 0.5, "replaces", 0.99, True, "answered")]
    assert s.desk.facts[1].successor == 2 and not s.desk.jobs and s.desk.wake_at() is None


@pytest.mark.parametrize("verdict", [Verdict(r, 0.99) for r in ("adds_detail", "another_value", "other_person", "unrelated")] + [Verdict("replaces", 0.79)])
def test_other_and_hesitant_answers_retire_nothing(verdict):
    s = Scene(verdict)
    (row,) = s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD)))
    assert row[4:] == (verdict.relation, verdict.confidence, False, "answered") and s.desk.facts[1].successor == -1


def test_the_first_confirmed_candidate_ends_the_question():
    s = Scene(Verdict("another_value", 1.0), YES)
    rows = s.say(*(fact(i, f"song {i}") for i in (1, 2, 3)), fact(4, NEW), ask(4, NEW, (1, "song 1"), (2, "song 2"), (3, "song 3")))
    assert [(r[2], r[6]) for r in rows] == [(1, False), (2, True)] and len(s.asked) == 2


def test_three_tries_with_growing_waits_then_the_question_ends():
    s = Scene(TimeoutError)
    assert s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD))) == []
    assert s.wait(1999) == [] and len(s.asked) == 1
    assert s.wait(1) == [] and len(s.asked) == 2
    assert s.wait(3999) == [] and len(s.asked) == 2
    assert s.wait(1) == [(7, 2, 1, 0.5, None, None, False, "failed")]
    assert [t for t, _ in s.asked] == [1000, 3000, 7000] and s.desk.wake_at() is None


@pytest.mark.parametrize("bad", [None, ValueError, ConnectionResetError, Verdict("maybe", 1.0)])
def test_an_unusable_answer_is_asked_for_again(bad):
    s = Scene(bad, bad, YES)
    s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD)))
    assert s.wait(2000) == []
    assert [r[6] for r in s.wait(4000)] == [True]


def test_nothing_is_asked_while_the_service_is_down_and_nothing_is_lost():
    s = Scene(Unavailable, YES)
    assert s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD)), fact(3, "I rent a flat"), fact(4, "I bought a house"), ask(4, "I bought a house", (3, "I rent a flat"))) == []
    assert s.wait(59_999) == [] and len(s.asked) == 1
    assert [(r[1], r[2], r[6]) for r in s.wait(1)] == [(2, 1, True), (4, 3, True)]


def test_waiting_goes_on_at_the_candidate_where_it_stopped():
    s = Scene(Verdict("unrelated", 1.0), TimeoutError, YES)
    assert [r[2] for r in s.say(fact(1, "a"), fact(2, "b"), fact(3, "c"), ask(3, "c", (1, "a"), (2, "b")))] == [1]
    assert [(r[2], r[6]) for r in s.wait(2000)] == [(2, True)]
    assert [old for _, old in s.asked] == ["a", "b", "b"]


@pytest.mark.parametrize("meanwhile", [Message("forget", 1, 0, "", -1, ""), Message("edit", 1, 0, "I stream on Deezer", -1, ""), Message("edit", 2, 0, "Reworded", -1, ""), Message("forget", 2, 0, "", -1, "")])
def test_a_late_verdict_does_not_act_on_what_changed(meanwhile):
    s = Scene(TimeoutError, YES)
    s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD)), meanwhile)
    assert [(r[4], r[6]) for r in s.wait(2000)] == [("replaces", False)] and s.desk.facts[1].successor == -1


def test_a_fact_retired_meanwhile_keeps_its_successor_unless_that_is_forgotten():
    for forgotten, applied in ((False, False), (True, True)):
        s = Scene(TimeoutError, YES)
        s.say(fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD)), fact(3, "x"), Message("retire", 3, 3, "", 1, ""))
        if forgotten:
            s.say(Message("forget", 3, 0, "", -1, ""))
        assert [r[6] for r in s.wait(2000)] == [applied] and s.desk.facts[1].successor == (2 if applied else 3)


def test_an_older_statement_never_retires_a_newer_one_and_restored_facts_count_again():
    s = Scene(YES)
    assert [r[6] for r in s.say(fact(1, OLD, 50), fact(2, NEW, 40), ask(2, NEW, (1, OLD)))] == [False]
    s = Scene(YES)
    s.say(fact(1, OLD), Message("forget", 1, 0, "", -1, ""), Message("restore", 1, 0, "", -1, ""), fact(2, NEW))
    assert [r[6] for r in s.say(ask(2, NEW, (1, OLD)))] == [True]


def test_a_verdict_given_elsewhere_is_judged_the_same_way():
    given = lambda text: Message("verdict", 2, 2, NEW, -1, json.dumps({"id": 1, "text": text, "sim": 0.4, "relation": "replaces", "confidence": 0.9}))
    s = Scene(YES)
    s.say(fact(1, OLD), fact(2, NEW))
    assert [r[6] for r in s.say(given("other words"))] == [False]
    assert [r[6] for r in s.say(given(OLD), given(OLD))] == [True, False] and s.asked == []


def test_messages_take_effect_in_order_and_once():
    said = [fact(1, OLD), fact(2, NEW), ask(2, NEW, (1, OLD)), Message("forget", 2, 0, "", -1, ""), Message("forget", 9, 0, "", -1, "")]
    for order in ([5, 4, 3, 2, 1], [3, 1, 1, 2, 2, 5, 4, 3], [1, 2, 3, 4, 5]):
        s = Scene(YES)
        out = [r for k in order for r in s.desk.take(k, said[k - 1], s.now)]
        assert [r[6] for r in out] == [True] and not s.desk.ahead and s.desk.marks.next_seq == 6


def _tables(spark, rng, banks=6, size=25):
    words = "I use like my Vim Emacs Helix tea cola editor drink now these days again".split()
    said = [(b, k, f"2025-01-{1 + k:02d}", " ".join(rng.choice(words) for _ in range(rng.randrange(2, 7)))) for b in range(banks) for k in range(1, size)]
    facts = spark.createDataFrame(said, "bank long, ord long, day string, text string").selectExpr("bank", "ord", "CAST(day AS DATE) AS day", "text")
    jobs = [(b, n, o, 0.5, k) for b in range(banks) for n in range(2, size) for k, o in enumerate(rng.sample(range(1, n), min(n - 1, rng.randrange(4))), 1)]
    retired = [(b, o, n) for b in range(banks) for n in range(2, size) for o in ([rng.randrange(1, n)] if rng.random() < 0.2 else [])]
    return facts, spark.createDataFrame(jobs, "bank long, new_ord long, old_ord long, sim double, k long"), spark.createDataFrame(retired, "bank long, old_ord long, new_ord long"), said, jobs, retired


def _simulated(said, jobs, retired, bar):
    """The plain story: at each statement the rules retire, or else the candidates that stand are asked about until one is retired."""
    text, gone, out = {(b, k): t for b, k, _, t in said}, set(), []
    for b, new, _, _ in sorted(said):
        ruled = sorted(o for x, o, n in retired if (x, n) == (b, new))
        if ruled:
            gone |= {(b, o) for o in ruled}
            continue
        waiting = [o for _, o in sorted((k, o) for x, n, o, _, k in jobs if (x, n) == (b, new)) if (b, o) not in gone]
        for old in waiting:
            v = judge_by_words(text[b, new], text[b, old])
            hit = v.relation == "replaces" and v.confidence >= bar
            out.append((b, new, old, v.relation, v.confidence, hit))
            if hit:
                gone.add((b, old))
                break
    return sorted(out)


def test_replay_equals_the_plain_story(spark):
    facts, jobs, retired, *plain = _tables(spark, random.Random(4))
    got = replay(messages(facts, jobs, retired), judge_by_words, Policy(bar=0.5))
    rows = sorted((r.bank, r.new_id, r.old_id, r.relation, r.confidence, r.applied) for r in got.collect())
    assert rows == _simulated(*plain, 0.5) and sum(r[-1] for r in rows) > 10
    assert replay(messages(facts.where("false"), jobs.where("false"), retired.where("false")), judge_by_words).count() == 0


def test_catalog_runs_on_the_callers_statements(spark):
    from chronofold.streaming.verifier import verified_retirements

    said = spark.createDataFrame([(1, 1, "2025-01-01", "my editor these days is Vim"), (1, 2, "2025-01-02", "my window is open"), (1, 3, "2025-02-01", "my editor these mornings is Helix")],
                                 "bank long, ord long, day string, text string")
    rows = verified_retirements(spark, None, {"said": said}).collect()
    assert all(r.bank == 1 and r.new_id > r.old_id for r in rows)


def flaky(folder=None):
    """Answers by words; the first question about a pair times out, if a folder is there to remember it."""
    def answer(new, old):
        if folder:
            import hashlib
            import os

            mark = os.path.join(folder, hashlib.md5(f"{new}|{old}".encode()).hexdigest())
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise TimeoutError
        return judge_by_words(new, old)

    return answer


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def _drive(spark, folder, fails, until=None, limit=1):
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", limit).parquet(f"{folder}/in")
    out = verify_stream(source, flaky(f"{folder}/marks" if fails else None), Policy(bar=0.5, backoff_ms=20))
    writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append")
    return writer.trigger(availableNow=True).start() if until is None else writer.trigger(processingTime="100 milliseconds").start()


def test_the_stream_equals_the_replay_on_shuffled_batches_and_over_a_restart(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers always ask for one more batch, so the run would not end
    facts, jobs, retired, *plain = _tables(spark, rng, banks=3, size=12)
    rows = [tuple(r) for r in messages(facts, jobs, retired).collect()]
    rng.shuffle(rows)
    (tmp_path / "marks").mkdir()
    third = len(rows) // 3
    for k, part in enumerate((rows[:third], rows[third : 2 * third] + rows[: third // 2], rows[2 * third :])):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k != 1:  # the first run ends here; the second picks up its state, messages ahead of their turn included
            q = _drive(spark, tmp_path, fails=False)
            assert q.awaitTermination(120) and q.exception() is None
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = spark.read.schema(DECISIONS).parquet(f"{tmp_path}/out")
    assert sorted((r.bank, r.new_id, r.old_id, r.relation, r.confidence, r.applied) for r in got.collect()) == _simulated(*plain, 0.5)


def test_timers_bring_questions_back_without_new_messages(rocks, tmp_path):
    import time

    spark = rocks
    (tmp_path / "marks").mkdir()
    said = [(1, "I use Vim now"), (2, "I use Helix now"), (3, "I drink tea"), (4, "I drink cola")]
    rows = [(b, s, "fact", s, s, t, None, None) for b in (1, 2) for s, t in said]
    rows += [(b, 5 + k, "ask", new, new, said[new - 1][1], None, json.dumps([{"id": old, "text": said[old - 1][1], "sim": 0.6}])) for b in (1, 2) for k, (new, old) in enumerate(((2, 1), (4, 3)))]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = _drive(spark, tmp_path, fails=True, until=4)
    try:
        for _ in range(150):
            time.sleep(0.2)
            assert q.exception() is None
            found = spark.read.schema(DECISIONS).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(found) == 4:
                break
    finally:
        q.stop()
    assert sorted((r.bank, r.new_id, r.old_id, r.applied) for r in found) == [(b, n, n - 1, True) for b in (1, 2) for n in (2, 4)]
