"""A second opinion on updates that the rules left alone, asked for in the background and applied late.

A bank's messages (facts, edits, questions to ask) carry dense numbers. ``Desk`` is one bank's state machine:

* messages take effect in the order of their numbers, whenever they arrive; one that comes twice is dropped;
* questions wait in a queue; a question goes through its candidates, most similar first, and ends at the first one that
  is confirmed. Asking goes on at the candidate where it stopped, so no candidate is asked about twice;
* an unusable answer is asked for again after 2 and then 4 seconds, three tries in all; where the service is unavailable
  everything waits for a minute. Nothing that waits is lost: the queue is state;
* a verdict retires a fact only if both facts stand, say what they said when the question was put, and are in order.

``verify_stream`` runs a desk for every bank with ``transformWithStateInPandas``: the queue, the facts, the messages ahead
of their turn and the clock marks are separate state variables, so that a step touches only the entries that it
needs, and waiting is a processing-time timer. ``replay`` runs the same desk over a bounded table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import feature_table, replacements
from ..plans import dialect
from ..plans.ranking import verifier_plan

# fixed values: what an answer may say
RELATIONS = ("replaces", "adds_detail", "another_value", "other_person", "unrelated")
MESSAGES = "bank long, seq long, kind string, id long, ms long, text string, other long, candidates string"
DECISIONS = "bank long, new_id long, old_id long, similarity double, relation string, confidence double, applied boolean, status string"
COLUMNS = [f.split()[0] for f in DECISIONS.split(", ")]


class Verdict(NamedTuple):
    relation: str
    confidence: float


class Unavailable(Exception):
    """The service that answers is down; asking anything else now would fail the same way."""


Ask = Callable[[str, str], "Verdict | None"]


@dataclass(frozen=True)
class Policy:
    """When a verdict counts, and how long to wait before asking again."""

    bar: float = 0.8
    attempts: int = 3
    backoff_ms: int = 2000
    pause_ms: int = 60_000


class Fact(NamedTuple):
    ms: int
    text: str
    alive: bool
    successor: int  # -1: none


class Job(NamedTuple):
    new_id: int
    text: str
    candidates: str  # JSON: [{"id", "text", "sim"}, ...], most similar first


class Message(NamedTuple):
    kind: str
    id: int
    ms: int
    text: str
    other: int
    candidates: str


@dataclass
class Marks:
    next_seq: int = 1
    first_job: int = 0
    end_job: int = 0
    at: int = 0
    tries: int = 0
    wait_until: int = 0
    n_ahead: int = 0


class Desk:
    """One bank: its facts, its queue of questions, what is ahead of its turn, and the clock marks."""

    def __init__(self, bank: int, facts: MutableMapping, jobs: MutableMapping, ahead: MutableMapping, marks: Marks, ask: Ask, policy: Policy):
        self.bank, self.facts, self.jobs, self.ahead, self.marks, self.ask, self.policy = bank, facts, jobs, ahead, marks, ask, policy

    def take(self, seq: int, message: Message, now: int) -> list[tuple]:
        """A message and whatever it unblocks; decisions come out."""
        if seq < self.marks.next_seq or (self.marks.n_ahead and seq in self.ahead):
            return []
        if seq > self.marks.next_seq:
            self.ahead[seq] = message
            self.marks.n_ahead += 1
            return []
        out = []
        while message is not None:
            self.marks.next_seq += 1
            out += self._apply(message)
            out += self.work(now)
            message = self.ahead.pop(self.marks.next_seq, None) if self.marks.n_ahead else None
            self.marks.n_ahead -= message is not None
        return out

    def wake_at(self) -> int | None:
        """When to call ``work`` again, if questions wait."""
        return self.marks.wait_until if self.marks.first_job < self.marks.end_job else None

    def work(self, now: int) -> list[tuple]:
        """Ask on until the queue is empty or something has to wait."""
        m, out = self.marks, []
        while m.first_job < m.end_job and now >= m.wait_until:
            job = self.jobs[m.first_job]
            candidates, done = json.loads(job.candidates), False
            while not done and m.at < len(candidates):
                old_id, old_text, similarity = (candidates[m.at][k] for k in ("id", "text", "sim"))
                try:
                    verdict = self.ask(job.text, old_text)
                except Unavailable:
                    m.wait_until = now + self.policy.pause_ms
                    return out
                except (OSError, ValueError):
                    verdict = None
                if verdict is None or verdict.relation not in RELATIONS:
                    m.tries += 1
                    if m.tries < self.policy.attempts:
                        m.wait_until = now + self.policy.backoff_ms * m.tries
                        return out
                    out.append((self.bank, job.new_id, old_id, similarity, None, None, False, "failed"))
                    done = True
                else:
                    m.tries = 0
                    done = self._retire(job.new_id, job.text, old_id, old_text, verdict)
                    out.append((self.bank, job.new_id, old_id, similarity, verdict.relation, float(verdict.confidence), done, "answered"))
                    m.at += 1
            del self.jobs[m.first_job]
            m.first_job, m.at, m.tries = m.first_job + 1, 0, 0
        return out

    def _apply(self, x: Message) -> list[tuple]:
        own = self.facts.get(x.id)
        if x.kind == "fact":
            self.facts[x.id] = Fact(x.ms, x.text, True, -1)
        elif x.kind == "ask":
            standing = [c for c in json.loads(x.candidates) if self._stands(self.facts.get(c["id"]))]
            if standing:
                self.jobs[self.marks.end_job] = Job(x.id, x.text, json.dumps(standing))
                self.marks.end_job += 1
        elif own is None:
            return []
        elif x.kind == "edit":
            self.facts[x.id] = own._replace(text=x.text)
        elif x.kind in ("forget", "restore"):
            self.facts[x.id] = own._replace(alive=x.kind == "restore")
        elif x.kind == "retire" and self._stands(self.facts.get(x.other)):
            self.facts[x.other] = self.facts[x.other]._replace(successor=x.id)
        elif x.kind == "verdict":  # given elsewhere: one candidate with its relation and confidence
            old_id, old_text, similarity, relation, confidence = (json.loads(x.candidates)[k] for k in ("id", "text", "sim", "relation", "confidence"))
            applied = self._retire(x.id, x.text, old_id, old_text, Verdict(relation, confidence))
            return [(self.bank, x.id, old_id, similarity, relation, float(confidence), applied, "answered")]
        return []

    def _stands(self, fact: Fact | None) -> bool:
        """Not forgotten, and no successor that still counts; a forgotten successor passes on to its own."""
        if fact is None or not fact.alive:
            return False
        seen, at = set(), fact.successor
        while at != -1 and at not in seen:
            seen.add(at)
            after = self.facts.get(at)
            if after is None:
                return True
            if after.alive:
                return False
            at = after.successor
        return True

    def _retire(self, new_id: int, new_text: str, old_id: int, old_text: str, verdict: Verdict) -> bool:
        if verdict.relation != "replaces" or verdict.confidence < self.policy.bar:
            return False
        new, old = self.facts.get(new_id), self.facts.get(old_id)
        if new is None or not new.alive or new.text != new_text or not self._stands(old) or old.text != old_text or old.ms > new.ms:
            return False
        self.facts[old_id] = old._replace(successor=new_id)
        return True


def _message(r) -> Message:
    whole = lambda v: -1 if pd.isna(v) else int(v)
    words = lambda v: v if isinstance(v, str) else ""
    return Message(r.kind, whole(r.id), whole(r.ms), words(r.text), whole(r.other), words(r.candidates))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


class _Entries(MutableMapping):
    """A map state as a mapping of one number to a named tuple: an entry is fetched once and written back once, by ``flush``."""

    def __init__(self, state, kind: type):
        self.state, self.kind = state, kind
        self.here: dict[int, tuple | None] = {}
        self.changed: set[int] = set()

    def __getitem__(self, key):
        if key not in self.here:
            found = self.state.getValue((key,))
            self.here[key] = None if found is None else self.kind(*found)
        if self.here[key] is None:
            raise KeyError(key)
        return self.here[key]

    def __setitem__(self, key, value):
        self.here[key] = value
        self.changed.add(key)

    def __delitem__(self, key):
        self.here[key] = None
        self.changed.add(key)

    def __iter__(self):
        kept = {k[0] for k in self.state.keys()} - self.changed
        return iter(kept | {k for k, v in self.here.items() if v is not None})

    def __len__(self):
        return sum(1 for _ in self)

    def flush(self) -> None:
        for key in sorted(self.changed):
            if self.here[key] is not None:
                self.state.updateValue((key,), tuple(self.here[key]))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.changed.clear()


class Verifier(StatefulProcessor):
    """``Desk`` over Spark's state; a bank's next try is a processing-time timer."""

    def __init__(self, ask: Ask, policy: Policy):
        self.ask, self.policy = ask, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getMapState("facts", "id long", "ms long, text string, alive boolean, successor long")
        self.jobs = handle.getMapState("jobs", "place long", "new_id long, text string, candidates string")
        self.ahead = handle.getMapState("ahead", "seq long", "kind string, id long, ms long, text string, other long, candidates string")
        self.marks = handle.getValueState("marks", "next_seq long, first_job long, end_job long, at long, tries long, wait_until long, n_ahead long")

    def _desk(self, bank: int) -> Desk:
        marks = Marks(*self.marks.get()) if self.marks.exists() else Marks()
        return Desk(bank, _Entries(self.facts, Fact), _Entries(self.jobs, Job), _Entries(self.ahead, Message), marks, self.ask, self.policy)

    def _close(self, desk: Desk, before: int, now: int) -> None:
        m = desk.marks
        for entries in (desk.facts, desk.jobs, desk.ahead):
            entries.flush()
        self.marks.update((m.next_seq, m.first_job, m.end_job, m.at, m.tries, m.wait_until, m.n_ahead))
        again = desk.wake_at()
        if again is not None and again != before:
            self.handle.registerTimer(max(again, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        desk = self._desk(int(key[0]))
        before = desk.wake_at() or 0
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                out += desk.take(int(r.seq), _message(r), now)
        self._close(desk, before, now)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        desk = self._desk(int(key[0]))
        out = desk.work(now)
        self._close(desk, 0, now)
        yield _frame(out)

    def close(self) -> None:
        pass


def verify_stream(messages: DataFrame, ask: Ask, policy: Policy = Policy()) -> DataFrame:
    """Decisions on a stream of ``MESSAGES``; needs the RocksDB state store. ``ask`` must be safe to repeat: after a
    restart a question whose batch was not finished is put again, but its decision comes out once."""
    return messages.groupBy("bank").transformWithStateInPandas(Verifier(ask, policy), DECISIONS, "Append", "ProcessingTime")


def replay(messages: DataFrame, ask: Ask, policy: Policy = Policy()) -> DataFrame:
    """The same decisions over a table of ``MESSAGES``; where something waits, the clock is moved to when it is over.

    A bank is one task's group, as for the other folds: one person's messages. An unavailable service ends the run, as a batch
    has nobody to come back later.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def asking(new: str, old: str) -> Verdict | None:
            try:
                return ask(new, old)
            except Unavailable as e:
                raise RuntimeError("the service that answers is unavailable") from e

        desk, now, out = Desk(int(key[0]), {}, {}, {}, Marks(), asking, policy), 0, []
        for r in pdf.sort_values("seq").itertuples():
            out += desk.take(int(r.seq), _message(r), now)
            while desk.wake_at() is not None:
                now = desk.wake_at()
                out += desk.work(now)
        return _frame(out)

    return messages.groupBy("bank").applyInPandas(run, DECISIONS)


def messages(facts: DataFrame, jobs: DataFrame, retired: DataFrame) -> DataFrame:
    """Numbered ``MESSAGES`` of every bank: each fact ``(bank, ord, day, text)``, then what the rules retire by it ``(bank, old_ord, new_ord)``,
    or else its question with all candidates ``(bank, new_ord, old_ord, sim, k)``."""
    ms = F.unix_date("day").cast("long") * F.lit(86_400_000)
    stated = facts.select("bank", F.col("ord").alias("id"), ms.alias("ms"), "text")
    none = F.lit(None)
    told = stated.select("bank", F.lit(0).alias("step"), F.lit("fact").alias("kind"), "id", "ms", "text", none.cast("long").alias("other"), none.cast("string").alias("candidates"))
    gone = retired.select("bank", F.lit(1).alias("step"), F.lit("retire").alias("kind"), F.col("new_ord").alias("id"), F.col("old_ord").alias("other"))
    gone = gone.join(stated.select("bank", "id", "ms"), ["bank", "id"]).select("bank", "step", "kind", "id", "ms", none.cast("string").alias("text"), "other", none.cast("string").alias("candidates"))
    judged = retired.select("bank", F.col("new_ord").alias("id")).distinct()
    named = jobs.join(stated.select("bank", F.col("id").alias("old_ord"), F.col("text").alias("old_text")), ["bank", "old_ord"])
    listed = F.sort_array(F.collect_list(F.struct("k", "old_ord", "old_text", "sim")))
    asked = named.groupBy("bank", F.col("new_ord").alias("id")).agg(listed.alias("c")).join(judged, ["bank", "id"], "left_anti").join(stated, ["bank", "id"])
    one = lambda x: F.struct(x["old_ord"].alias("id"), x["old_text"].alias("text"), x["sim"].alias("sim"))
    asked = asked.withColumn("candidates", F.to_json(F.transform("c", one)))
    asked = asked.select("bank", F.lit(2).alias("step"), F.lit("ask").alias("kind"), "id", "ms", "text", none.cast("long").alias("other"), "candidates")
    order = W.partitionBy("bank").orderBy("ms", "id", "step", "other")
    return told.unionByName(gone).unionByName(asked).withColumn("seq", F.row_number().over(order).cast("long")).select("bank", "seq", "kind", "id", "ms", "text", "other", "candidates")


def judge_by_words(new: str, old: str) -> Verdict:
    """A stand-in for a model, for tables at hand: what shares no word is unrelated, what repeats all words adds detail, and
    the rest replaces, the surer the more of the older words come back."""
    a, b = (set(re.findall(r"[a-z0-9]+", t.lower())) for t in (new, old))
    if not a & b:
        return Verdict("unrelated", 1.0)
    return Verdict("adds_detail", 1.0) if b <= a else Verdict("replaces", len(a & b) / len(b))


def verified_retirements(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None, ask: Ask = judge_by_words, bar: float = 0.5) -> DataFrame:
    """Every question that the rules left open, answered bank by bank in order, and whether its verdict retired a fact."""
    known = {**(inputs or {}), "features": feature_table(spark, sf_dir, inputs)}
    jobs, retired = dialect.run(spark, sf_dir, verifier_plan, known), replacements(spark, sf_dir, known)
    return replay(messages(known["features"].select("bank", "ord", "day", "text"), jobs, retired), ask, Policy(bar=bar))


def queries() -> dict:
    return {"verified_retirements": verified_retirements}
