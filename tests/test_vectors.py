"""Vector searches by tiles against the plans' own statements: several stripes, copies, near ties, odd vectors; and at a size that all pairs in SQL do not reach."""

import time

import duckdb
import numpy as np
import pytest

from chronofold import catalog
from chronofold.operators import vectors

NAMES = ["semantic_supersession", "vector_search", "cosine_topk"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def _table(rng, n=700):
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[: n // 2] = x[rng.integers(0, 40, n // 2)]  # copies
    x[-60:] = x[rng.integers(0, 40, 60)] + np.float32(1e-6) * rng.normal(size=(60, 8)).astype(np.float32)  # near ties
    x[-90:-60] *= 1000
    return [(int(i), [float(v) for v in row], 0) for i, row in zip(rng.permutation(3 * n)[:n], x)]


def _equal(spark, rows, name, path):
    table = spark.createDataFrame(rows, SCHEMA)
    table.coalesce(1).write.parquet(path)
    got = catalog.apply(spark, name, embeddings=table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]}) x").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    return len(want)


@pytest.mark.parametrize("name", NAMES)
def test_tiles_equal_all_pairs(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(vectors, "SMALL", 90)
    assert _equal(spark, _table(np.random.default_rng(5)), name, f"{tmp_path}/a") > 5
    # vectors without a direction or a value: compared by the plan's own expression
    monkeypatch.setattr(vectors, "SMALL", 2048)
    odd = [(4000, [0.0] * 8, 0), (4050, [0.0] * 8, 0), (4100, None, 0), (3999, None, 0), (None, [1.0] * 8, 0), (4150, [float("nan")] + [1.0] * 7, 0)]
    _equal(spark, _table(np.random.default_rng(6), 60) + odd, name, f"{tmp_path}/b")


def test_ten_thousand_vectors_are_quick(spark):
    """53 million pairs: minutes by a lambda over every pair."""
    x = np.random.default_rng(7).normal(size=(10_256, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5000] = x[10]
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)
    began = time.time()
    got = {r.new_id: (r.old_id, r.sim) for r in catalog.apply(spark, "semantic_supersession", embeddings=table).collect()}
    assert got[5000] == (10, 1.0) and time.time() - began < 60
