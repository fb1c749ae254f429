"""Equal values where a plan's order has to decide by itself."""

import datetime as dt
import itertools

from chronofold import catalog


def test_the_earliest_of_equal_purchases_is_the_anchor(spark):
    at = lambda day: dt.datetime(2024, 1, day, 9)
    events = [(1, at(2), 7, "view", 1.0), (2, at(4), 7, "purchase", 5.0), (3, at(6), 7, "view", 2.0), (4, at(8), 7, "purchase", 5.0), (5, at(9), 7, "purchase", None), (6, at(1), 8, "view", 1.0), (8, at(3), 8, "purchase", None)]
    for order in itertools.islice(itertools.permutations(events), 0, None, 1009):
        rows = spark.createDataFrame(list(order), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1)
        got = catalog.apply(spark, "event_anchor_asof", events=rows).collect()
        assert [(r.bank, r.slot, r.id) for r in got] == [(7, "view", 1)]
