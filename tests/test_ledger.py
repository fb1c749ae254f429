"""The write path: batches equal one write, killed and repeated batches leave one copy, compaction changes nothing."""

import random

import pytest

from chronofold.operators import lifecycle
from chronofold.operators.folds import remember_trace
from chronofold.streaming.ledger import FactStore, remembered_in_batches

SCHEMA = "bank long, ord long, day string, text string"


def _said(rng, banks=4, size=18):
    lines = ["I live in {}", "I moved to {}", "My manager is {}", "My boss is {} now", "My favourite colour is {}", "I take {} every morning", "I stopped taking {}", "My phone is an iPhone {}", "I also like {}", " ",
             "Always answer in {} from now on"]
    fills = ["Ghent", "Turin", "Cork", "green", "12", "13"]
    return [(b, k, f"2025-01-{k:02d}", rng.choice(lines).format(rng.choice(fills))) for b in range(banks) for k in range(1, size)]


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _whole(spark, rows):
    told = remember_trace(spark, None, {"said": _rows(spark, rows)}).collect()
    return sorted((r.bank, r.ord, r.status, r.duplicate_of) for r in told), sorted((r.bank, int(o), r.ord) for r in told for o in r.retired.split(",") if o)


def _stored(store):
    return sorted((r.bank, r.ord, r.status, r.duplicate_of) for r in store.trace().collect()), sorted((r.bank, r.old_ord, r.new_ord) for r in store.edges().collect())


@pytest.fixture(scope="module")
def made():
    return _said(random.Random(11))


@pytest.fixture(scope="module")
def whole(spark, made):
    return _whole(spark, made)


def test_batches_equal_one_write_whatever_is_killed_or_repeated(spark, made, whole, tmp_path, monkeypatch):
    assert len(whole[1]) > 5 and {s for _, _, s, _ in whole[0]} == {"stored", "duplicate", "rejected"}
    parts = [[r for r in made if lo < r[1] <= hi] for lo, hi in ((0, 6), (6, 7), (7, 20))]
    store = FactStore(spark, str(tmp_path))
    assert store.trace().count() == store.standing().count() == 0
    store.write(_rows(spark, parts[0]), 0)
    seen = _stored(store)
    # cut off between the tables, then before the ledger: nothing shows, and the next try replaces what was left
    for broken in ("_write_edges", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(store, broken, lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError):
                store.write(_rows(spark, parts[1][:2]), 1)
        assert _stored(FactStore(spark, str(tmp_path))) == seen
    store.write(_rows(spark, parts[1] + parts[1]), 1)
    seen = _stored(store)
    store.write(_rows(spark, parts[1]), 1)  # delivered again after its commit
    assert _stored(store) == seen
    store.write(_rows(spark, parts[1][:3] + parts[2]), 2)  # a producer that repeats itself
    assert _stored(store) == whole
    standing = {(r.bank, r.ord) for r in store.standing().collect()}
    assert standing == {(b, o) for b, o, s, _ in whole[0] if s == "stored"} - {(b, o) for b, o, _ in whole[1]}
    store.compact()
    assert len(store.parts()) == 1 and _stored(store) == whole
    store.write(_rows(spark, parts[0]), 0)  # older than what was compacted
    store.compact()
    assert _stored(store) == whole and len(list((tmp_path / "trace").glob("*"))) == 1
    more = [(0, 40, "2025-03-01", "I live in Porto"), (99, 1, "2025-03-01", "I live in Porto")]
    store.write(_rows(spark, more), 3)
    assert _stored(store) == _whole(spark, made + more)


def test_a_stream_writes_through_the_ledger_over_a_restart(spark, made, whole, tmp_path):
    for k, part in enumerate(([r for r in made if r[1] <= 9], [r for r in made if r[1] > 9])):
        _rows(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        store = FactStore(spark, f"{tmp_path}/store")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = source.writeStream.foreachBatch(store.write).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None
    assert _stored(store) == whole


def test_the_query_equals_one_write(spark, made, whole):
    got = remembered_in_batches(spark, None, {"said": _rows(spark, made)}, batches=2).collect()
    assert sorted((r.bank, r.ord, r.status, r.duplicate_of) for r in got) == whole[0]
    assert sorted((r.bank, int(o), r.ord) for r in got for o in r.retired.split(",") if o) == whole[1]


def test_a_pair_of_texts_is_judged_once_whatever_the_banks(spark, monkeypatch):
    judged = []
    keep = lifecycle.judged_texts
    monkeypatch.setattr(lifecycle, "judged_texts", lambda statement, features, met: (judged.append(met.distinct().count()), keep(statement, features, met))[1])
    lines = ["I live in Ghent", "I moved to Turin", "I moved to Turin", " \t", "I live in Ghent"]
    told = remember_trace(spark, None, {"said": _rows(spark, [(b, k, f"2025-01-{k:02d}", x) for b in range(40) for k, x in enumerate(lines, 1)])}).collect()
    rows = [("stored", None, ""), ("stored", None, "1"), ("duplicate", 2, ""), ("rejected", None, ""), ("stored", None, "2")]
    assert len(judged) == 1 and judged[0] <= 4
    assert sorted((r.bank, r.ord, r.status, r.duplicate_of, r.retired) for r in told) == [(b, k, *x) for b in range(40) for k, x in enumerate(rows, 1)]
