"""Facts that are remembered, forgotten, restored and edited, and what that does to who replaces whom.

Operations on a bank's facts come in order: ``remember`` (id, day, text), ``forget``, ``restore`` and ``update`` (id, text). Facts are
told apart by their ids, which rise with the time they were learned.

* A fact stands if it is not forgotten and nothing that counts replaced it; a forgotten replacement passes on to its own.
* ``remember`` drops orders and empty texts, names a standing fact that it repeats, or is stored and replaces standing facts.
* ``restore`` asks again what was learned later: the first such fact that replaces the one that comes back does.
* ``update`` judges the new words as if they had been said then: what the fact replaced and no longer would comes back, what it
  now would goes, and so for what replaced it. Words that may not be stored change nothing.

What two wordings mean for each other depends on their texts alone, so all verdicts are computed set-wise, once for each pair of texts that
meets in any bank and holds one which the operations touch; the fold over a bank's operations only moves links. It reads
banks one after another from a sorted stream. ``advance`` starts from a state and gives the next, at the cost of the banks that the operations name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..plans.pairs import DUPLICATE, REPLACES, judged
from ..sources.relations import said
from .graph import cut
from .rules import by_number, deciding_pairs, judged_texts, numbered, text_features

OPERATIONS = "bank long, seq long, op string, id long, day string, text string"
STATE = "bank long, id long, day string, text string, alive boolean, replaced_by long"


#: Texts of a bank up to which all its pairs of texts are judged; in a larger bank they are met by what the rules ask for.
FEW = 256
#: Rows that a task hands on at a time.
HELD = 20_000
KINDS = ("bank", pa.int64()), ("id", pa.int64()), ("day", pa.string()), ("text", pa.string()), ("alive", pa.bool_()), ("replaced_by", pa.int64())


class _Bank:
    """One bank's facts, and what its texts, by number, mean for each other."""

    def __init__(self):
        self.facts: dict[int, list] = {}  # id -> [day, text, alive, replaced by or -1, number of the text]
        self.having: defaultdict[int, set[int]] = defaultdict(set)  # facts of a text
        self.behind: defaultdict[int, set[int]] = defaultdict(set)  # facts that a fact replaced
        self.meant: set[tuple[int, int]] = set()  # (new, old) text where the first replaces the second
        self.olds, self.news, self.repeats = defaultdict(list), defaultdict(list), defaultdict(list)

    def learn(self, new: list[int], old: list[int], replaces: list[bool]) -> None:
        for n, o, r in zip(new, old, replaces):
            if r:
                self.meant.add((n, o))
                self.olds[n].append(o)
                self.news[o].append(n)
            else:
                self.repeats[n].append(o)

    def hold(self, fact: int, day: str | None, text: str | None, alive: bool, to: int, number: int) -> None:
        self.facts[fact] = [day, text, alive, to, number]
        self.having[number].add(fact)
        if to != -1:
            self.behind[to].add(fact)

    def link(self, fact: int, to: int) -> None:
        self.behind[self.facts[fact][3]].discard(fact)
        self.facts[fact][3] = to
        if to != -1:
            self.behind[to].add(fact)

    def replaces(self, newer: int, older: int) -> bool:
        return newer > older and (self.facts[newer][4], self.facts[older][4]) in self.meant

    def successor(self, fact: int) -> int:
        """The replacement that counts, or -1."""
        at, seen = self.facts[fact][3], set()
        while at in self.facts and at not in seen and not self.facts[at][2]:
            seen.add(at)
            at = self.facts[at][3]
        return at if at in self.facts and self.facts[at][2] else -1

    def earlier(self, fact: int, texts: list[int]) -> list[int]:
        """The facts with these texts that stand and were learned before this one."""
        return [k for old in texts for k in self.having.get(old, ()) if k < fact and self.facts[k][2] and self.successor(k) == -1]

    def apply(self, op: str, fact: int, day: str | None, text: str | None, number: int, refused: bool) -> None:
        if op == "remember":
            if refused or fact in self.facts or self.earlier(fact, self.repeats.get(number, [])):
                return
            replaced = self.earlier(fact, self.olds.get(number, []))
            self.hold(fact, day, text, True, -1, number)
            for k in replaced:
                self.link(k, fact)
        elif fact not in self.facts:
            return
        elif op == "forget":
            self.facts[fact][2] = False
        elif op == "restore":
            self.facts[fact][2] = True
            self._ask_later(fact)
        elif op == "update" and not refused and number != self.facts[fact][4]:
            self.having[self.facts[fact][4]].discard(fact)
            self.having[number].add(fact)
            self.facts[fact][1], self.facts[fact][4] = text, number
            if self.facts[fact][2]:
                self._ask_earlier(fact)
                self._ask_later(fact)

    def _ask_earlier(self, fact: int) -> None:
        for k in [k for k in self.behind.get(fact, ()) if k != fact and self.facts[k][2] and not self.replaces(fact, k)]:
            self.link(k, -1)
        for k in self.earlier(fact, self.olds.get(self.facts[fact][4], [])):
            self.link(k, fact)

    def _ask_later(self, fact: int) -> None:
        now = self.successor(fact)
        if now != -1 and not self.replaces(now, fact):
            self.link(fact, now := -1)
        if now == -1:
            later = min((k for new in self.news.get(self.facts[fact][4], ()) for k in self.having.get(new, ()) if k > fact and self.facts[k][2]), default=None)
            if later is not None:
                self.link(fact, later)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Banks follow each other; of each come its verdicts (kind 0: new text, old text, whether it replaces), its state (1), its operations (2)."""
    out: list[tuple] = []
    at, bank = None, _Bank()

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out), KINDS)]
        out.clear()
        return pa.record_batch(columns, names=[name for name, _ in KINDS])

    def done() -> None:
        out.extend((at, k, day, text, alive, None if to == -1 else to) for k, (day, text, alive, to, _) in sorted(bank.facts.items()))

    for batch in batches:
        if not batch.num_rows:
            continue
        banks, kinds = batch.column("bank"), batch.column("kind").to_numpy()
        keys = banks.fill_null(np.iinfo(np.int64).min).to_numpy()
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        lo = 0
        for hi in ends:
            if (key := banks[lo].as_py()) != at:
                done()
                at, bank = key, _Bank()
                if len(out) >= HELD:
                    yield flush()
            mid = lo + int(np.searchsorted(kinds[lo:hi], 1))
            if mid > lo:
                bank.learn(*(batch.column(c)[lo:mid].to_pylist() if c == "alive" else batch.column(c)[lo:mid].to_numpy().tolist() for c in ("id", "number", "alive")))
            rows = batch.slice(mid, hi - mid)
            columns = (rows.column(c).to_pylist() for c in ("kind", "op", "id", "day", "text", "alive", "replaced_by", "number", "refused"))
            for kind, op, fact, day, text, alive, to, number, refused in zip(*columns):
                if kind == 1:
                    bank.hold(fact, day, text, alive, -1 if to is None else to, number)
                else:
                    bank.apply(op, fact, day, text, number, refused)
            lo = hi
    done()
    if out:
        yield flush()


def met_in_banks(held: DataFrame, features: DataFrame, touched: str = "new_touched OR old_touched") -> DataFrame:
    """``bank, new, old`` of the texts ``held(bank, number, first, last, touched)`` that a rule may speak about, ``touched`` as asked (one of them) and the old one learned before."""
    held = cut(held.join(held.groupBy("bank").agg(F.count("*").alias("texts")), "bank"))
    side = lambda rows, s: rows.select("bank", F.col("number").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("first", "last", "touched")))
    asked = f"old_first < new_last AND ({touched})"
    few, many = held.where(F.col("texts") <= FEW), held.where(F.col("texts") > FEW)
    met = side(few, "new").join(side(few, "old"), "bank").where(asked).select("bank", "new", "old")
    if not many.isEmpty():
        f = cut(many.select("bank", "number").join(features.drop("bank").withColumnRenamed("ord", "number"), "number").withColumnRenamed("number", "ord"))
        pairs = deciding_pairs(f, ordered=False).withColumnsRenamed({"new_ord": "new", "old_ord": "old"})
        pairs = pairs.join(side(many, "new"), ["bank", "new"]).join(side(many, "old"), ["bank", "old"]).where(asked)
        met = met.unionByName(cut(pairs.select("bank", "new", "old")))
    return met


def spoken(features: DataFrame, met: DataFrame) -> DataFrame:
    """``new, old, replaces`` of the texts ``met(new, old)`` where the new one replaces the old one, or repeats it."""
    tail = f"SELECT new_ord AS new, old_ord AS old, reason IN {REPLACES} AS replaces FROM verdicts WHERE reason IN {REPLACES} OR (reason = 'none' AND j >= {DUPLICATE})"
    return cut(judged_texts(lambda d: f"WITH {said(d)}, {judged(d)} {tail}", features, met.select("new", "old")))


def advance(operations: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The ``STATE`` after ``OPERATIONS``, of the banks that they name, from an earlier ``STATE`` (none: empty).

    An operation on an unknown fact changes nothing, nor does remembering an id again; null texts are refused.
    """
    none = F.lit(None)
    ops = operations.selectExpr("CAST(bank AS BIGINT) AS bank", "CAST(seq AS BIGINT) AS seq", "op", "CAST(id AS BIGINT) AS id", "CAST(day AS STRING) AS day", "text")
    ops = cut(ops.where("seq IS NOT NULL AND id IS NOT NULL").select(F.lit(2).alias("kind"), "*", none.cast("boolean").alias("alive"), none.cast("long").alias("replaced_by")))
    named = ops.select("bank", "id").distinct()
    events = ops.withColumn("touched", F.lit(True))
    if state is not None:
        old = state.select(F.lit(1).alias("kind"), "bank", none.cast("long").alias("seq"), none.cast("string").alias("op"), "id", "day", "text", "alive", "replaced_by")
        old = old.join(named.select("bank").distinct(), "bank", "left_semi").join(named.withColumn("touched", F.lit(True)), ["bank", "id"], "left").na.fill({"touched": False})
        events = cut(old.unionByName(events))
    # a text is a number from here on; operations without one have that of null
    features = text_features(numbered(events))
    texts = features.select("text", F.col("ord").alias("number"), F.expr("directive = 1 OR text IS NULL OR trim(text) = ''").alias("refused"))
    events = cut(by_number(events, texts))
    wordings = events.where("(kind = 1 OR op IN ('remember', 'update')) AND NOT refused")
    held = wordings.groupBy("bank", "number").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("touched").alias("touched"))
    met = met_in_banks(held, features)
    verdicts = met.join(spoken(features, met), ["new", "old"]).select(F.lit(0).alias("kind"), "bank", F.col("new").alias("id"), F.col("old").alias("number"), F.col("replaces").alias("alive"))
    rows = events.drop("touched").unionByName(verdicts, allowMissingColumns=True)
    return rows.repartition("bank").sortWithinPartitions("bank", "kind", "seq").mapInArrow(_fold, STATE)


def lifecycle_replay(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """All statements remembered in order, while some are forgotten, some of these restored, and some edited to what was said next: what is stored at the end."""
    rows = cut(dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord AS id, day, text, lead(text) OVER (PARTITION BY bank ORDER BY ord) AS next FROM said", inputs))
    step = lambda op, when, after, text: rows.where(when).select("bank", (F.col("id") * 10 + after).alias("seq"), F.lit(op).alias("op"), "id", "day", text)
    bare = F.lit(None).cast("string").alias("text")
    ops = step("remember", "true", 0, F.col("text"))
    for more in (step("forget", "id % 7 = 3", 21, bare), step("restore", "id % 14 = 3", 52, bare), step("update", "id % 11 = 5 AND next IS NOT NULL", 33, F.col("next").alias("text"))):
        ops = ops.unionByName(more)
    return advance(ops).select("bank", "id", "text", "alive", "replaced_by")


def queries() -> dict:
    return {"lifecycle_replay": lifecycle_replay}
