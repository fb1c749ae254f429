"""Incremental operation: one state per (bank, slot), updated as facts arrive.

The state holds the standing fact; a newer event time replaces it and emits an edge dated by the newer
fact; a late fact is judged against the state and emits its own retirement instead. One key is one
serialised writer; edges are keyed by the old fact, so a sink that overwrites by key is idempotent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "bank long, slot string, old_id long, new_id long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = [r for pdf in batches for r in pdf.itertuples()]
    standing = state.get if state.exists else None
    out = []
    for r in sorted(rows, key=lambda r: (r.ms, r.id)):
        if standing is None:
            standing = (int(r.ms), int(r.id))
        elif (r.ms, r.id) > standing:
            out.append((*key, standing[1], int(r.id)))
            standing = (int(r.ms), int(r.id))
        elif r.id != standing[1]:
            out.append((*key, int(r.id), standing[1]))
    if standing is not None:
        state.update(standing)
    yield pd.DataFrame(out, columns=["bank", "slot", "old_id", "new_id"])


def supersession_stream(facts: DataFrame) -> DataFrame:
    """Edges (old, new) of a stream ``facts(bank, slot, id, ms)`` of one-value slots."""
    return facts.groupBy("bank", "slot").applyInPandasWithState(_advance, EDGES, "ms long, id long", "append", GroupStateTimeout.NoTimeout)
