"""Searches over whole tables, by brute force."""

import numpy as np

from chronofold import catalog

SF = "/root/testdata/sf0.001"


def test_vector_searches_see_every_row(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    ask = np.flatnonzero(ids % 50 == 0)
    dot, norm = x[ask] @ x.T, np.sqrt((x * x).sum(axis=1))
    dot[ids[ask][:, None] == ids[None, :]] = -9e9
    got = catalog.queries()["vector_search"](spark, SF).collect()
    assert len(got) == (np.round(dot, 6) >= 0.3).sum()
    best = {(r.query_id, r.r): r.sim for r in catalog.queries()["cosine_topk"](spark, SF).collect()}
    want = -np.sort(-dot / norm[None, :] / norm[ask][:, None], axis=1)[:, :10]
    assert len(best) == 10 * len(ask) and all(abs(best[(int(ids[q]), k + 1)] - want[n, k]) < 2e-5 for n, q in enumerate(ask) for k in range(10))


def test_candidates_are_ten_earlier_turns(spark):
    said = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").select("conv_id", "turn").collect()
    want = {(a.conv_id, a.turn): min(10, sum(b.conv_id == a.conv_id and b.turn < a.turn for b in said)) for a in said}
    got = {}
    for r in catalog.queries()["candidate_generation"](spark, SF).where("why = 'similar'").collect():
        got[(r.bank, r.new_ord)] = got.get((r.bank, r.new_ord), 0) + 1
    assert max(got.values()) > 2 and got == {k: n for k, n in want.items() if n}
