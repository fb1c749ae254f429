"""Every plan against DuckDB on the smallest tables, and the behaviour cases by hand."""

import datetime as dt
import os

import duckdb
import pytest

from chronofold import catalog
from chronofold.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    def one(x):
        return float(x) if type(x).__name__ in ("Decimal", "float") else int(x) if isinstance(x, bool) else x

    return sorted(repr(tuple(map(one, r))) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_plan_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]}) x").fetchall()
    assert _plain(got.select(*columns).collect()) == _plain(want)


def _rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_time_phrases(spark):
    span = {r.id: (r.lo, r.hi) for r in _rows(spark, "resolve_time_phrase")}
    day = dt.date
    assert span[3] == (day(2023, 4, 1), day(2023, 4, 30))  # a month still running is last year's
    assert span[5] == span[6] == (day(2022, 12, 1), day(2023, 2, 28))
    assert span[7] == (day(2024, 2, 5), day(2024, 3, 6))
    assert span[9] == (day(2023, 2, 18), day(2023, 8, 19))
    assert span[16] == (day(2023, 6, 11), day(2023, 6, 20))
    assert span[14] == (day(2024, 5, 20), day(2024, 5, 20))  # now is a span of one day
    assert span[20] == span[21] == span[22] == span[23] == (None, None)  # no span outside the years 1 to 9999
    edge = spark.createDataFrame([(1, "2023 years ago", "2024-05-20"), (2, "on 9999-12-31", "2024-05-20"), (3, "in 9999-12", "2024-05-20"), (4, "4000001 days ago", "2024-05-20"), (5, "4000000 years ago", "2024-05-20")], "id long, phrase string, today string")
    got = {r.id: (r.lo, r.hi) for r in catalog.apply(spark, "resolve_time_phrase", phrases=edge).collect()}
    assert got == {1: (day(1, 2, 18), day(1, 8, 19)), 2: (day(9999, 12, 31),) * 2, 3: (day(9999, 12, 1), day(9999, 12, 31)), 4: (None, None), 5: (None, None)}


def test_supersession_cases(spark):
    reason = {(r.bank, r.old_ord, r.new_ord): r.reason for r in _rows(spark, "conflict_resolve")}
    assert reason[(1, 1, 3)] == "slot" and reason[(1, 2, 3)] == "other_actor"
    assert reason[(1, 4, 5)] == "slot" and reason[(1, 6, 7)] == "reversal" and reason[(1, 8, 9)] == "many"
    assert reason[(2, 1, 3)] == "key_value" and reason[(2, 1, 2)] == "none"
    assert reason[(2, 4, 6)] == "attribute" and reason[(2, 4, 5)] == "other_scope" and reason[(2, 7, 8)] == "refinement"


def test_fold_agrees_with_cases(spark):
    trace = {(r.bank, r.ord): r for r in _rows(spark, "remember_trace")}
    assert trace[(1, 12)].status == "duplicate" and trace[(1, 12)].duplicate_of == 11
    assert trace[(3, 3)].status == "rejected" and trace[(3, 4)].status == "rejected"
    assert trace[(1, 3)].retired == "1" and trace[(1, 5)].retired == "4"


def test_window_successor_equals_chain_walk(spark):
    rows = {r.id: r.superseded_by for r in _rows(spark, "effective_successor")}
    for r in _rows(spark, "effective_successor"):
        at, seen = r.superseded_by, set()
        while at is not None and at % 7 == 0 and at not in seen:
            seen.add(at)
            at = rows.get(at)
        assert r.successor == at


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronofold.streaming.store import supersession_stream

    facts = spark.read.parquet(f"{SF}/events.parquet").where("event_type IN ('signup', 'purchase')").select(
        F.col("user_id").alias("bank"), F.col("event_type").alias("slot"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"))
    facts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = supersession_stream(stream).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.old_id, r.new_id) for r in spark.table("edges").collect()}
    assert got == {(r.old_id, r.new_id) for r in _rows(spark, "slot_supersession")}
