"""Operators whose order decides the result: exact folds, one bank per group.

What two facts mean for each other depends neither on the store's state nor on anything but their texts, so Catalyst computes the
verdicts set-wise (``plans.pairs.judged``), once a pair of texts; the fold over a bank's facts only keeps the set that still
stands. A bank is one person's facts and so bounded; banks are spread over the cluster, and a task reads them one after another.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from ..sources.relations import said
from .graph import cut
from .lifecycle import met_in_banks, spoken
from .rules import by_number, numbered, text_features

TRACE = "bank long, ord long, status string, duplicate_of long, retired string"
TOLD = ("bank", pa.int64()), ("ord", pa.int64()), ("status", pa.string()), ("duplicate_of", pa.int64()), ("retired", pa.string())
#: Rows that a task holds before it hands them on, to the end of a batch.
HELD = 20_000
#: A text of white space alone, as Python's ``strip`` knows it.
BLANK = r"^[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\z"


class _Standing:
    """What stands in one bank, by the number of its text, and what the bank's texts mean for each other."""

    def __init__(self):
        self.olds, self.repeats = defaultdict(list), defaultdict(list)  # text -> texts that it replaces, that it repeats
        self.having: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # text -> (place in time, statement)
        self.place = 0

    def earlier(self, new: int, texts: list[int]) -> list[tuple[int, int, int]]:
        return [(place, o, text) for text in texts for place, o in self.having.get(text, ()) if o < new]

    def keep(self, new: int, text: int) -> None:
        self.having[text].append((self.place, new))
        self.place += 1

    def tell(self, new: int, text: int) -> tuple[str, int | None, str]:
        if same := self.earlier(new, self.repeats.get(text, [])):
            return "duplicate", max(same)[1], ""
        gone = sorted(self.earlier(new, self.olds.get(text, [])))
        for place, o, of in gone:
            self.having[of].remove((place, o))
        self.keep(new, text)
        return "stored", None, ",".join(str(o) for _, o, _ in gone)


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay banks in order: a statement is rejected, a duplicate of a standing one, or stored and retires others.

    Only standing statements are judged, so a retired one neither blocks a duplicate nor retires twice. Banks follow each other; of each come
    its verdicts (kind 0: new text, old text, whether it replaces), what stands from before (1), and what is written (2), both in order of time.
    """
    out: list[tuple] = []
    at, bank = None, _Standing()

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out), TOLD)]
        out.clear()
        return pa.record_batch(columns, names=[name for name, _ in TOLD])

    for batch in batches:
        for key, kind, ord_, number, flag in zip(*(batch.column(c).to_pylist() for c in ("bank", "kind", "ord", "number", "flag"))):
            if key != at:
                at, bank = key, _Standing()
            if kind == 0:
                (bank.olds if flag else bank.repeats)[ord_].append(number)
            elif kind == 1:
                bank.keep(ord_, number)
            else:
                out.append((key, ord_, "rejected", None, "") if flag else (key, ord_, *bank.tell(ord_, number)))
        if len(out) >= HELD:
            yield flush()
    if out:
        yield flush()


def remember_trace(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """What happened to every statement as it was written, bank by bank.

    ``inputs`` may hold ``said``, and ``arrived(bank, ord)``: then only these statements are written, onto the others, which stand.
    What two statements mean for each other is asked once for each pair of texts that meets in any bank, the newer one among what is written.
    """
    rows = dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, CAST(day AS DATE) AS day, text FROM said", inputs)
    fresh = F.lit(True)
    if inputs and "arrived" in inputs:
        rows, fresh = rows.join(inputs["arrived"].select("bank", "ord", F.lit(True).alias("fresh")), ["bank", "ord"], "left"), F.coalesce("fresh", F.lit(False))
    rows = cut(rows.select("bank", "ord", "day", "text", fresh.alias("fresh")))
    features = text_features(numbered(rows))
    refused = (F.col("directive") == 1) | F.coalesce(F.col("text").rlike(BLANK), F.lit(False))
    rows = cut(by_number(rows, features.select("text", F.col("ord").alias("number"), refused.alias("refused"))).drop("text"))
    held = rows.where("NOT (fresh AND refused)").groupBy("bank", "number").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.max("fresh").alias("touched"))
    met = met_in_banks(held, features, "new_touched")
    # only what can block or retire travels to the fold
    verdicts = met.join(spoken(features, met), ["new", "old"]).select("bank", F.lit(0).alias("kind"), F.lit(None).cast("date").alias("day"), F.col("new").alias("ord"), F.col("old").alias("number"), F.col("replaces").alias("flag"))
    told = rows.select("bank", F.when(F.col("fresh"), 2).otherwise(1).alias("kind"), "day", "ord", "number", F.col("refused").alias("flag"))
    ordered = verdicts.unionByName(told).repartition("bank").sortWithinPartitions("bank", "kind", F.col("day").asc_nulls_last(), "ord")
    return ordered.mapInArrow(replay, TRACE)


def import_summary(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Counts of a bulk import per bank."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    retired = F.sum(F.size(F.filter(F.split("retired", ","), lambda x: x != "")))
    return remember_trace(spark, sf_dir, inputs).groupBy("bank").agg(count("stored").alias("stored"), count("duplicate").alias("duplicates"), count("rejected").alias("rejected"), retired.alias("superseded"))


def live_set_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in time order; a newer one of the slot with P >= 0.5 takes its standing predecessors out of the live set."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("bank"), F.col("event_type").alias("slot"), F.col("event_id").alias("id"), "ts", (F.col("value") / 100).alias("p"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        live: list[int] = []
        out = []
        for row in pdf.sort_values(["ts", "id"]).itertuples():
            if row.p >= 0.5:
                out += [(row.bank, row.slot, old, row.id) for old in live]
                live = []
            live.append(row.id)
        return pd.DataFrame(out, columns=["bank", "slot", "old_id", "new_id"])

    return events.groupBy("bank", "slot").applyInPandas(replay, "bank long, slot string, old_id long, new_id long")


def budget_fill(spark: SparkSession, sf_dir: str, budget: int = 150) -> DataFrame:
    """Fill each conversation's token budget in turn order: a turn that does not fit is skipped, later ones may fit."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for row in pdf.sort_values("turn").itertuples():
            if row.tokens <= left:
                left -= row.tokens
                keep.append((row.conv_id, row.turn, row.tokens))
        return pd.DataFrame(keep, columns=["conv_id", "turn", "tokens"])

    return turns.groupBy("conv_id").applyInPandas(fill, "conv_id long, turn long, tokens long")


def queries() -> dict:
    return {f.__name__: f for f in (remember_trace, import_summary, live_set_replay, budget_fill)}
