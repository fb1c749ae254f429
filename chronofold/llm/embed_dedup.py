"""Embedding near-dedup with spherical-cap filters.

Filter directions are a random product code: a vector is cut into two halves, each half has B random
unit codewords, and every pair of codewords is one of B*B directions. A vector belongs to each filter
whose direction it exceeds ``alpha`` on; list decoding finds these from the two score lists, without
going through all B*B sums. Vectors meet in shared filters and are verified exactly, in double
precision; a pair counts at the smallest codeword of the first half under which it shares a filter.

B grows with the square root of the row count, so a filter's expected population stays constant.
Vectors of one filter are shuffled by the first half's codeword; crowded codewords are cut into chunks
whose pairs are separate groups, so no group outgrows ``CHUNK`` rows a side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .components import connected_components

#: Filters that a random vector is expected to exceed, and those that every vector gets at least: lists of a
#: product code vary, and short ones would lose links (simulated recall at cosine 0.9: 0.93 without the floor
#: and lists of 40, all of 1500 pairs with these values).
LIST_SIZE, LEAST = 80, 48
#: Vectors expected in one filter, for random data.
POPULATION = 96
#: Rows of one side of a group.
CHUNK = 4000
SLICE = 512
#: Filters looked at together when a chunk's pairs are told from those of smaller codewords.
COLUMNS = 4096


def code_size(rows: int) -> int:
    """Codewords of a half so that B*B filters hold ``POPULATION`` vectors each; a power of two, at least 32."""
    return max(32, 1 << math.ceil(math.log2(math.sqrt(max(rows, 1) * LIST_SIZE / POPULATION))))


class CapFilters:
    """Structured random directions for one dimension, with list decoding."""

    def __init__(self, dim: int, size: int, seed: int = 20):
        rng = np.random.default_rng([seed, dim, size])
        self.cut, self.size = max(1, dim // 2), size
        self.codes = []
        for width in (self.cut, dim - self.cut):
            c = rng.standard_normal((size, width))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) if width else c)
        # the sum of two unit codewords' products has variance 2/dim on the sphere
        self.alpha = NormalDist().inv_cdf(1 - min(0.5, LIST_SIZE / size**2)) * math.sqrt(2 / max(dim, 2))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row the sorted ids (i * size + j) of all filters exceeded; where these are fewer than
        ``LEAST`` the threshold falls to that many."""
        one = unit[:, : self.cut] @ self.codes[0].T
        two = unit[:, self.cut :] @ self.codes[1].T if unit.shape[1] > self.cut else np.zeros((len(unit), self.size))
        top = min(LEAST, self.size)
        best_one, best_two = -np.sort(-one, axis=1)[:, :top], -np.sort(-two, axis=1)[:, :top]
        out = []
        for a, b, x, y in zip(one, two, best_one, best_two):
            sums = (x[:, None] + y[None, :]).reshape(-1)
            alpha = min(self.alpha, np.partition(sums, -min(LEAST, len(sums)))[-min(LEAST, len(sums))])
            i, j = np.flatnonzero(a >= alpha - y[0]), np.flatnonzero(b >= alpha - x[0])
            p, q = np.nonzero(a[i][:, None] + b[j][None, :] >= alpha)
            out.append(np.sort(i[p] * self.size + j[q]).astype(np.int64))
        return out


def _usable(column: str):
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _name(column: str) -> list:
    """``h1, h2``: 128 bits that name a vector."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(column, F.lit(1)).alias("h2")]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that keep the same parts together as the pairs (a, b) over 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _unit(vec: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no finite vector overflows or vanishes."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def _met_before(x: np.ndarray, y: np.ndarray, lists: list[np.ndarray], bound: int) -> np.ndarray:
    """Which of the pairs (x, y) of rows share a filter below ``bound``."""
    rows, inverse = np.unique(np.r_[x, y], return_inverse=True)
    x, y = inverse[: len(x)], inverse[len(x) :]
    low = [lists[r][: np.searchsorted(lists[r], bound)] for r in rows]
    flat, owner = np.concatenate(low), np.repeat(np.arange(len(rows)), [len(f) for f in low])
    name, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    column, owner = column[often[column] > 1], owner[often[column] > 1]  # a filter of one row is shared by none
    used, column = np.unique(column, return_inverse=True)
    met = np.zeros(len(x), dtype=bool)
    for at in range(0, len(used), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        bits = np.zeros((len(rows), COLUMNS // 8), dtype=np.uint8)
        np.bitwise_or.at(bits, (owner[here], (column[here] - at) // 8), (1 << ((column[here] - at) % 8)).astype(np.uint8))
        words = bits.view(np.uint64)
        step = max(1, (1 << 22) // words.shape[1])
        for k in range(0, len(x), step):
            left = np.flatnonzero(~met[k : k + step]) + k
            met[left] = (words[x[left]] & words[y[left]]).any(axis=1)
    return met


def _link_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Verify one group (codeword of the first half, chunk pair): link weights and a spanning forest."""
    pdf = pdf.sort_values("node", kind="stable")
    nodes, mult, dim = pdf["node"].to_numpy(dtype=np.int64), pdf["mult"].to_numpy(dtype=np.int64), int(pdf["dim"].iloc[0])
    vec = np.frombuffer(b"".join(pdf["vec"]), dtype="<f8").reshape(-1, dim)
    side = (pdf["chunk"] != pdf["left"]).to_numpy()  # True: the right-hand chunk
    across = pdf["left"].iloc[0] != pdf["right"].iloc[0]
    lists = [np.frombuffer(f, dtype="<i8") for f in pdf["filters"]]
    size, code = int(pdf["size"].iloc[0]), int(pdf["code"].iloc[0])
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    here = flat // size == code
    order = np.argsort(flat[here], kind="stable")
    keys, rows = flat[here][order], owner[here][order]
    # which rows of the left have met which of the right, in any filter of this codeword
    one_side, two_side = (np.flatnonzero(~side), np.flatnonzero(side)) if across else (np.arange(len(nodes)),) * 2
    place = np.zeros(len(nodes), dtype=np.int64)
    place[one_side] = np.arange(len(one_side))
    place[two_side] = np.arange(len(two_side))
    met = np.zeros((len(one_side), len(two_side)), dtype=bool)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist() if len(starts) else []):
        if e - s < 2:
            continue
        member = rows[s:e]
        one, two = (member[~side[member]], member[side[member]]) if across else (member, member)
        if not len(one) or not len(two):
            continue
        for at in range(0, len(one), SLICE):
            part = one[at : at + SLICE]
            x, y = np.nonzero(vec[part] @ vec[two].T >= threshold)
            if len(x) > (0 if across else len(part)):
                met[place[part[x]], place[two[y]]] = True
    x, y = np.nonzero(met if across else np.triu(met, 1))
    x, y = one_side[x], two_side[y]
    if len(x):
        fresh = ~_met_before(x, y, lists, code * size)
        x, y = x[fresh], y[fresh]
    weight = np.bincount(x, mult[y], len(nodes)).astype(np.int64) + np.bincount(y, mult[x], len(nodes)).astype(np.int64)
    got = np.flatnonzero(weight)
    node, root = _forest(len(nodes), x, y)
    return pd.DataFrame({"a": np.r_[nodes[got], nodes[node]], "b": np.r_[nodes[got], nodes[root]], "w": np.r_[weight[got], np.zeros(len(node), dtype=np.int64)]})


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Link all vectors with cosine >= ``threshold``.

    Returns one row per input row: the id, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable by links) and ``kept`` (id = component_id). Vectors that are null, empty, all
    zero or hold null or non-finite parts link with nothing. Vectors of different lengths never link.
    Equal vectors link with each other and are compared once. Repeated rows are rows of their own; rows
    whose id is null are given back with a null component. An empty table gives an empty result; other
    columns of the input are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = dict(df.dtypes)[vec_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    # adding zero makes a negative zero positive: equal vectors have equal hashes
    base = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col).cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1])).alias("vec"))
    base = base.withColumn("ok", F.coalesce(_usable("vec") & F.col("id").isNotNull(), F.lit(False)))
    # a vector's node is its row number, not an id: ids may repeat
    reps = base.where("ok").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("mult"))
    reps = materialise(reps.select("*", *_name("vec"), F.monotonically_increasing_id().alias("node")), "caps-reps")
    rows = reps.count()
    size = code_size(rows)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, CapFilters] = {}
        for pdf in batches:
            dims = pdf["vec"].map(len).to_numpy()
            for dim in np.unique(dims):
                part = pdf[dims == dim]
                unit = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]]))
                lists = codes.setdefault(int(dim), CapFilters(int(dim), size)).decode(unit)
                yield pd.DataFrame({"node": part["node"], "mult": part["mult"], "vec": [v.astype("<f8").tobytes() for v in unit], "dim": int(dim),
                                    "filters": [f.astype("<i8").tobytes() for f in lists], "codes": [np.unique(f // size) for f in lists]})

    routed = materialise(reps.select("node", "mult", "vec").mapInPandas(route, "node long, mult long, vec binary, dim int, filters binary, codes array<long>"), "caps-routed")
    placed = routed.withColumn("code", F.explode("codes")).drop("codes")
    # one count for each codeword: at most dims * B rows, B ~ sqrt(rows)
    load = placed.groupBy("dim", "code").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    placed = placed.join(load, ["dim", "code"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = (placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("left", F.least("chunk", "mate").cast("int")).withColumn("right", F.greatest("chunk", "mate").cast("int"))
             .withColumn("size", F.lit(size)))
    found = (pairs.groupBy("dim", "code", "left", "right")
             .applyInPandas(lambda pdf: _link_block(pdf, threshold), "a long, b long, w long"))
    found = materialise(found, "caps-links")
    links = found.where("w > 0").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    comps = connected_components(found.where("a <> b").select("a", "b"), "caps-components")
    known = reps.drop("vec").join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = materialise(known, "caps-known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id")
    # rows meet their vector by its hashes, without the vector
    mine = base.where("ok").select("id", *_name("vec"))
    fine = mine.join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("id", "n_links", "component_id")
    rest = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (fine.unionByName(rest)
            .select(F.col("id").alias(id_col), "n_links", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))
