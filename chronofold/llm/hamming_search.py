"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes are cut into segments; an index orders the codes of a block by each segment's value. A query
searches its segments with growing radius: once every segment was searched to radius r, and the first a of
m segments to r + 1, all codes within m*r + m - 1 + a bits were seen (pigeonhole). It stops as soon as its
k-th verified distance is at most that bound, so the answer is proven, not approximate.

Codes are dealt into blocks by a hash, each once. Every query visits every block: a task reads a block's codes
first, indexes them once, and then answers the queries as they stream by, so it holds one block and one batch.
The blocks' top-k lists are merged. Equal codes are kept once with their k + 1 smallest ids, which is all that
a top-k list can ask for. Blocks grow with the table, so that there are ``MOST_BLOCKS`` copies of a query until a
block has ``LARGE_BLOCK`` codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

SEGMENTS, WIDTH = 4, 16
#: Codes of a block while there are at most ``MOST_BLOCKS`` of them; codes that a block may grow to before there are more.
BLOCK_ROWS, MOST_BLOCKS, LARGE_BLOCK = 16_384, 64, 1_000_000


def sign_code(column: str):
    """A 64-bit code from the signs of a vector's first 64 parts (bit i: part i > 0; missing, null and not-a-number parts: 0)."""
    part = lambda i: F.try_element_at(F.col(column), F.lit(i + 1))
    bits = [F.when((part(i) > 0) & ~F.isnan(part(i)), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return F.when(F.col(column).isNotNull(), total)


def _masks() -> list[np.ndarray]:
    return [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], dtype=np.int64) for r in range(WIDTH + 1)]


class SegmentIndex:
    """One block's codes, ordered by each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.start = [], []
        for s in range(SEGMENTS):
            value = ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            self.order.append(np.argsort(value, kind="stable"))
            self.start.append(np.r_[0, np.cumsum(np.bincount(value, minlength=1 << WIDTH))])

    def search(self, query: np.uint64, enough, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (positions, distances) seen when ``enough(distances, positions, bound)`` first holds."""
        seen = np.zeros(len(self.codes), dtype=bool)
        found, far = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                value = int(query >> np.uint64(WIDTH * s)) & ((1 << WIDTH) - 1)
                probe = masks[radius] ^ value
                a, b = self.start[s][probe], self.start[s][probe + 1]
                size = b - a
                take = size > 0
                if take.any():
                    a, size = a[take], size[take]
                    at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    new = self.order[s][at]
                    new = new[~seen[new]]
                    seen[new] = True
                    found = np.r_[found, new]
                    far = np.r_[far, np.bitwise_count(self.codes[new] ^ query).astype(np.int64)]
                # segments 0..s searched to radius, the others to radius - 1
                bound = SEGMENTS * radius + s
                if enough(far, found, bound):
                    return found, far
        return found, far


class Block:
    """The codes of one block, each with its ids, and the proven top k of a query among them."""

    def __init__(self, codes: np.ndarray, ids: list, k: int, masks: list[np.ndarray]):
        self.index, self.k, self.masks = SegmentIndex(codes), k, masks
        self.many = np.array([len(x) for x in ids], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(self.many)]
        self.ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in ids)])
        self.by_id = np.argsort(self.ids, kind="stable")

    def _place(self, qid: int) -> int:
        """Position of the code that has this id, -1 if none here."""
        at = np.searchsorted(self.ids, qid, sorter=self.by_id)
        if at == len(self.ids) or self.ids[self.by_id[at]] != qid:
            return -1
        return int(np.searchsorted(self.first, self.by_id[at], side="right")) - 1

    def nearest(self, qid: int, code: np.uint64) -> list[tuple[int, int]]:
        mine, k = self._place(qid), self.k

        def enough(far, found, bound) -> bool:
            near = found[far <= bound]
            return self.many[near].sum() - bool(mine >= 0 and (near == mine).any()) >= k

        found, far = self.index.search(code, enough, self.masks)
        if not len(found):
            return []
        order = np.argsort(far, kind="stable")
        last = far[order[min(len(order), k + 1) - 1]]  # each code has an id, and one of them may be the query's own
        rows = [(int(far[x]), int(i)) for x in order[far[order] <= last] for i in self.ids[self.first[found[x]] : self.first[found[x] + 1]] if i != qid]
        return sorted(rows)[:k]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest index rows of every query, nearest first, ties by id.

    ``index(id, code)`` and ``queries(id, code)`` hold 64-bit codes as longs. A query is not its own
    neighbour (rows with its id are left out). Returns ``query_id``, ``rank`` (1..k), ``id``,
    ``distance``. Rows with a null id or code are ignored; fewer rows than k give fewer neighbours;
    index rows repeated with one id count once, by their smallest code.
    """
    index = index.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    queries = queries.where("id is not null and code is not null").select("id", "code").distinct()
    # a query's own id may be among the smallest ids of a code, so one more than k is kept
    ranked = index.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    codes = materialise(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-codes")
    total = codes.count()
    blocks = max(1, min(math.ceil(total / BLOCK_ROWS), max(MOST_BLOCKS, math.ceil(total / LARGE_BLOCK))))
    left = (codes.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"))
            .select("block", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("id"), "code", "ids"))
    right = (queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select("block", F.lit(True).alias("asks"), "id", "code", F.array().cast("array<bigint>").alias("ids")))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, here, codes_of, ids_of, block = _masks(), None, [], [], None
        for pdf in batches:
            out: list[tuple[int, int, int]] = []
            for at, part in pdf.groupby("block", sort=False):
                if at != here:
                    here, codes_of, ids_of, block = at, [], [], None
                asks = part["asks"].to_numpy(dtype=bool)
                codes_of.append(part["code"].to_numpy(dtype=np.int64)[~asks].view(np.uint64))
                ids_of += part["ids"][~asks].tolist()
                if asks.any():  # the block's codes have all come
                    block = block or Block(np.concatenate(codes_of), ids_of, k, masks)
                    for qid, code in zip(part["id"][asks].tolist(), part["code"].to_numpy(dtype=np.int64)[asks].view(np.uint64)):
                        out += [(qid, i, d) for d, i in block.nearest(qid, code)]
            yield pd.DataFrame(out, columns=["query_id", "id", "distance"]).astype("int64")

    dealt = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "code", "id")
    local = dealt.mapInPandas(answer, "query_id long, id long, distance long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


ORACLE = """
WITH bits AS (
  SELECT vec_id, CAST(sum(CASE WHEN x > 0 AND NOT isnan(x) THEN 1::HUGEINT << CAST(i - 1 AS INT) ELSE 0 END) AS HUGEINT) AS code
  FROM (SELECT vec_id, unnest(embedding[1:64]) AS x, generate_subscripts(embedding[1:64], 1) AS i FROM embeddings) GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.code, v.code)) AS BIGINT) AS distance
  FROM bits q JOIN bits v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
