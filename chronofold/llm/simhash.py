"""SimHash near-dedup with vantage-point trees over Hamming distance.

A fingerprint has one or more 64-bit words; each word is cut into four blocks of 16 bits. With one word, two
fingerprints at most 4 bits apart differ by at most one bit in some block (4 differences over 4 blocks), so
one vantage-point tree per block, searched with radius 1, reaches every pair. A tree's nodes hold a vantage
value and a median radius fitted on a bounded sample of fingerprints; every fingerprint is routed to its
home leaf and, by the triangle bounds, to the leaves that its ball overlaps. A leaf is a shard: homes are
compared with homes and with the boundary visitors of lower leaves, so each pair meets once per tree, and
each pair met is verified on all bits. Inside a shard, rows find each other by looking up their block's value and
those one bit away; for a wider radius a large shard is cut further by local vantage points. Shards give back a
spanning forest of their links, not the pairs.

For a similarity threshold below what 4 bits of 64 mean, ``similar_groups`` takes fingerprints of eight
words over the set of shingles, whose distance estimates the Jaccard similarity, and trees over all 32
blocks. There the fingerprints only propose: the parts that their links connect are looked through again
with the shingle sets themselves, and only pairs of the exact similarity link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .components import connected_components
from .embed_dedup import _forest

SEED = 42
BITS, WIDTH = 64, 16
#: Fingerprints on which vantage points and medians are fitted, at most.
SAMPLE = 8192
#: Distinct fingerprints a leaf is meant to be home of.
LEAF = 16384
#: Pairs that a shard looks up at once.
LOOKUPS = 1 << 22
#: Comparisons a shard makes directly; above it is split by local vantage points.
DIRECT = 1 << 26
#: Words, and blocks with a tree, of the wide fingerprint; bits apart of a candidate pair. Sets of similarity 0.8 are
#: 77 bits apart, 96 at worst (four shingles among five, where ties of the majority count), with a spread of 8 to 9.
WIDE_WORDS, WIDE_TREES, WIDE_LIMIT = 8, 32, 128
#: The exact Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
#: Shingles in a chunk of the exact comparison; each set counts some more, so that a chunk has 8192 sets at most.
LOAD, LOAD_SET = 1 << 21, 1 << 8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit. Eight counters share a word: 255 rows cannot overflow a byte."""
    out = np.zeros((8, 8), dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    rows = np.zeros((-(-len(hashes) // 255), 255), dtype=np.uint64)
    rows.reshape(-1)[: len(hashes)] = hashes
    for bit in range(8):
        sums = ((rows >> np.uint64(bit)) & lanes).sum(axis=1, dtype=np.uint64).astype("<u8")
        out[:, bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(-1)


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(parts) - words + 1)


def _majority(hashes: np.ndarray) -> int:
    bits = (2 * _bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; zero for a null text or one without words."""
    return _majority(_shingle_hashes(text, words))


def wide_fingerprint(text: str | None, words: int, size: int) -> bytes:
    """``size`` words over the set of shingles, each from a hash of its own derived from the shingle's."""
    return _wide(np.unique(_shingle_hashes(text, words)), size)


def _wide(h: np.ndarray, size: int) -> bytes:
    out = []
    for k in range(size):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return np.array(out, dtype=">u8").tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; fp is the SimHash as a big-endian word."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": [fingerprint(t, words).to_bytes(8, "big") for t in pdf["text"]]})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp binary")


def _shingle_sets(keyed: DataFrame, words: int) -> DataFrame:
    """``id, k1, k2`` of every row with its wide fingerprint, a digest of its shingle set and the set's size."""
    small_batches(keyed.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(_shingle_hashes(t, words)) for t in pdf["text"]]
            out = pdf[["id", "k1", "k2"]].copy()
            out["fp"] = [_wide(h, WIDE_WORDS) for h in sets]
            out["digest"] = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64).view(np.int64)
            out["size"] = np.array([len(h) for h in sets], dtype=np.int64)
            yield out

    return keyed.mapInPandas(run, "id long, k1 long, k2 long, fp binary, digest long, size long")


class VantageTree:
    """A complete tree over one block's values: vantage value and median radius of each inner node."""

    def __init__(self, values: np.ndarray, depth: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth, self.width = depth, width
        self.vantage = rng.integers(0, 1 << width, size=1 << depth, dtype=np.uint64)
        self.radius = np.full(1 << depth, width // 2, dtype=np.int64)
        parts = {1: values}
        for node in range(1, 1 << depth):
            own = parts.pop(node, values[:0])
            if len(own) >= 8:
                self.vantage[node] = own[rng.integers(len(own))]
                far = np.bitwise_count(own ^ self.vantage[node]).astype(np.int64)
                self.radius[node] = int(np.median(far))
            else:
                far = np.bitwise_count(own ^ self.vantage[node]).astype(np.int64)
            inside = far <= self.radius[node]
            parts[2 * node], parts[2 * node + 1] = own[inside], own[~inside]

    def route(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, leaves and whether it is the row's home, for the home leaf and the higher leaves its ball overlaps."""
        home = np.ones(len(x), dtype=np.int64)
        row, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            home = 2 * home + (np.bitwise_count(x ^ self.vantage[home]) > self.radius[home])
            far = np.bitwise_count(x[row] ^ self.vantage[node]).astype(np.int64)
            inside, outside = far - reach <= self.radius[node], far + reach > self.radius[node]
            row, node = np.r_[row[inside], row[outside]], np.r_[2 * node[inside], 2 * node[outside] + 1]
        keep = node >= home[row]
        row, node = row[keep], node[keep]
        return row, node, node == home[row]


def _lookups(home: np.ndarray, visit: np.ndarray, reach: int):
    """The pairs of ``_pairs`` for a radius of at most one: every home row looks up its own value and those one bit away."""
    everyone = np.r_[home, visit]
    order = np.argsort(everyone, kind="stable")
    ordered = everyone[order]
    for mask in [0, *(1 << b for b in range(WIDTH if reach else 0))]:
        target = home ^ np.uint16(mask)
        first = np.searchsorted(ordered, target, side="left")
        many = np.searchsorted(ordered, target, side="right") - first
        upto = np.cumsum(many)
        at = 0
        while at < len(home):  # runs of rows that meet a bounded number of others
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOKUPS, side="right")))
            n = many[at:end]
            a = np.repeat(np.arange(at, end), n)
            b = order[np.repeat(first[at:end] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            keep = a < b  # homes come first, so each pair counts once
            if keep.any():
                yield a[keep], b[keep]
            at = end


def _pairs(home: np.ndarray, visit: np.ndarray, reach: int, depth: int = 0):
    """Index pairs of block values at most ``reach`` bits apart: home with home (once), home with visitors."""
    if reach <= 1:
        yield from _lookups(home, visit, reach)
        return
    work = len(home) * (len(home) // 2 + len(visit))
    if work > DIRECT and depth < 24:
        point = home[np.random.default_rng(depth).integers(len(home))]
        far, vis = np.bitwise_count(home ^ point).astype(np.int64), np.bitwise_count(visit ^ point).astype(np.int64)
        mid = int(np.median(far))
        near, rest = np.flatnonzero(far <= mid), np.flatnonzero(far > mid)
        if len(near) and len(rest):
            # pairs inside the near side, its boundary with the far side, and inside the far side
            edge = rest[far[rest] <= mid + reach]
            low, high = np.flatnonzero(vis <= mid + reach), np.flatnonzero(vis > mid - reach)
            at = np.r_[near, edge, low + len(home)]
            for a, b in _pairs(home[near], np.r_[home[edge], visit[low]], reach, depth + 1):
                yield near[a], at[b]
            at = np.r_[rest, high + len(home)]
            for a, b in _pairs(home[rest], visit[high], reach, depth + 1):
                yield rest[a], at[b]
            return
    everyone = np.r_[home, visit]
    step = max(1, (1 << 22) // max(1, len(everyone)))
    for at in range(0, len(home), step):
        a, b = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ everyone[None, at:]) <= reach)
        keep = a < b
        if keep.any():
            yield a[keep] + at, b[keep] + at


def _shard(words: np.ndarray, block: np.ndarray, home: np.ndarray, reach: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of row numbers) of one shard's verified links."""
    order = np.r_[np.flatnonzero(home), np.flatnonzero(~home)]
    words, block, many = words[order], block[order], int(home.sum())
    label = np.arange(len(order))
    out_a, out_b = [], []
    for a, b in _pairs(block[:many], block[many:], reach):
        apart = label[a] != label[b]  # what is joined already needs no proof
        a, b = a[apart], b[apart]
        far = np.zeros(len(a), dtype=np.int64)
        for k in range(words.shape[1]):
            far += np.bitwise_count(words[a, k] ^ words[b, k])
        a, b = a[far <= limit], b[far <= limit]
        node, root = _forest(len(order), label[a], label[b])
        if len(node):
            out_a.append(order[node])
            out_b.append(order[root])
            move = np.arange(len(order))
            move[node] = root
            label = move[label]
    if not out_a:
        return order[:0], order[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def hamming_links(prints: DataFrame, limit: int, trees: int = 4, reach: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` of nodes that connect the parts which pairs within ``limit`` bits connect.

    ``prints(node, fp)`` has one row for each distinct fingerprint. Every pair is reached if ``reach`` is at
    least limit // trees (its default), as some block then differs by no more than that.
    """
    reach = limit // trees if reach is None else reach
    total = prints.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / LEAF)))
    sample = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    mask = np.uint64((1 << WIDTH) - 1)

    def unpack(column) -> np.ndarray:
        words = np.frombuffer(b"".join(column), dtype=">u8").astype(np.uint64)
        return words.reshape(len(column), -1)

    def block(words: np.ndarray, tree: int) -> np.ndarray:
        return ((words[:, tree // 4] >> np.uint64(WIDTH * (tree % 4))) & mask).astype(np.uint16)

    known = unpack([bytes(r["fp"]) for r in sample]) if sample else np.zeros((0, max(1, trees // 4)), np.uint64)
    forest = [VantageTree(block(known, k), depth, WIDTH, SEED + k) for k in range(trees)]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, nodes, fp = unpack(pdf["fp"]), pdf["node"].to_numpy(), pdf["fp"].to_numpy()
            for k, tree in enumerate(forest):
                row, leaf, home = tree.route(block(words, k), reach)
                yield pd.DataFrame({"leaf": leaf * trees + k, "node": nodes[row], "fp": fp[row], "home": home})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        words, nodes = unpack(pdf["fp"]), pdf["node"].to_numpy(dtype=np.int64)
        a, b = _shard(words, block(words, int(pdf["leaf"].iloc[0]) % trees), pdf["home"].to_numpy(dtype=bool), reach, limit)
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    routed = prints.select("node", "fp").mapInPandas(route, "leaf long, node long, fp binary, home boolean")
    return routed.groupBy("leaf").applyInPandas(join, "a long, b long")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``LEAST`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _exact_forest(words: np.ndarray, sets: list[np.ndarray], right: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the alike pairs among the rows, or between rows left and right of a pair of chunks."""
    size, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    for a in range(len(sets)) if right is None else np.flatnonzero(~right).tolist():
        b = np.arange(a + 1, len(sets)) if right is None else np.flatnonzero(right)
        # what is joined already needs no proof, and sets of too different sizes cannot be alike
        b = b[(label[b] != label[a]) & (LEAST[1] * np.minimum(size[b], size[a]) >= LEAST[0] * np.maximum(size[b], size[a]))]
        far = np.bitwise_count(words[b] ^ words[a]).sum(axis=1, dtype=np.int64)
        for c in b[np.argsort(far, kind="stable")[: np.count_nonzero(far <= WIDE_LIMIT)]].tolist():
            if label[c] != label[a] and _alike(sets[a], sets[c]):
                out.append((a, c))
                label[label == label[c]] = label[a]
    return out


def _exact_links(groups: DataFrame, loose: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what pairs with alike shingle sets connect, inside the parts ``loose(node, component)``.

    A part's sets are dealt into chunks of bounded size and every two chunks meet; small parts share a task.
    Only texts of nodes in a part are cut into shingles again, one text of each node.
    """
    members = materialise(groups.join(loose, "node").select("component", "node", "fp", "k1", "k2", (F.col("size") + LOAD_SET).alias("load")), "simhash-members")
    total = members.agg(F.sum("load")).first()[0] or 0
    tasks = max(1, math.ceil(total / LOAD))
    chunks = members.groupBy("component").agg(F.ceil(F.sum("load") / LOAD).cast("int").alias("chunks"))
    placed = (members.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
              .withColumn("bucket", F.when(F.col("chunks") > 1, F.col("component")).otherwise(F.pmod(F.col("component"), F.lit(tasks)))))
    # a merge join at every size: the members grow with the documents
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = texts.hint("merge").join(placed, ["k1", "k2"]).select("bucket", "component", "chunks", "chunk", "node", "fp", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [np.unique(_shingle_hashes(t, words)).tobytes() for t in pdf["text"]]
            yield pdf.rename(columns={"text": "shingles"})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values(["component", "node"], kind="stable").groupby("component", sort=False):
            nodes = part["node"].tolist()
            fps = np.frombuffer(b"".join(part["fp"]), dtype=">u8").astype(np.uint64).reshape(len(part), -1)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
            right = None if part["i"].iloc[0] == part["j"].iloc[0] else (part["chunk"] == part["j"]).to_numpy()
            out += [(nodes[a], nodes[b]) for a, b in _exact_forest(fps, sets, right)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    sets = found.mapInPandas(cut, "bucket long, component long, chunks int, chunk int, node long, fp binary, shingles binary")
    met = (sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
           .select("bucket", "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "fp", "shingles",
                   (F.col("chunks") > 1).alias("alone")))
    return met.groupBy("alone", "bucket", "i", "j").applyInPandas(compare, "a long, b long")


def _named(docs: DataFrame, groups: DataFrame, comps: DataFrame, by: list[str]) -> DataFrame:
    """``docs`` with ``component_id``, the smallest id of the component that their group's node is in, and ``part``, its smallest node."""
    placed = groups.join(comps.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    least = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("joint"))
    named = placed.join(least, "component", "left").select(*by, F.coalesce("joint", "least").alias("component_id"), F.coalesce("component", "node").alias("part"))
    return docs.join(named, by)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, limit: int = 4) -> DataFrame:
    """Group documents whose 64-bit SimHash fingerprints link at ``limit`` or fewer differing bits; exact.

    Returns ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest id
    reachable, itself included), one row per input row. Null, empty and word-less texts have fingerprint
    zero and link like any other. Equal fingerprints are compared once, so groups of copies cost one
    row. Repeated ids are rows of their own; a null id gets its group's component. An empty table gives
    an empty result; further columns are ignored.
    """
    docs = materialise(fingerprints(df, id_col, text_col, words), "simhash-docs")
    groups = materialise(docs.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")), "simhash-groups")
    comps = connected_components(hamming_links(groups, limit), "simhash-components")
    return _named(docs, groups, comps, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """Group documents that pairs with a Jaccard similarity of 0.8 or more of their shingle sets connect.

    Candidates are pairs at most ``WIDE_LIMIT`` bits apart by the wide fingerprint, met in trees over all its
    blocks searched with radius 1: a pair at the threshold is missed with a probability of 0.0001, in texts of
    a few shingles 0.003. Only candidates whose sets have the exact similarity link, so no others are
    grouped. Returns ``id_col`` and ``component_id``; the other rules are those of ``near_duplicates``.
    """
    return similar_rows(df, id_col, text_col, words).select(id_col, "component_id")


def text_key(text_col: str) -> list:
    """``k1, k2``: 128 bits that name a text."""
    return [F.xxhash64(text_col).alias("k1"), F.xxhash64(text_col, F.lit(1)).alias("k2")]


def similar_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``similar_groups`` with the ``text_key`` of every row and its group's own name ``part``, as ids may be null or repeated."""
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *text_key(text_col))
    docs = materialise(_shingle_sets(keyed, words), "simhash-docs")
    groups = docs.groupBy("fp", "digest").agg(F.min("id").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), F.max("size").alias("size"))
    groups = materialise(groups.select("fp", "digest", "least", "k.k1", "k.k2", "size", F.xxhash64("fp", "digest").alias("node")), "simhash-groups")
    loose = connected_components(hamming_links(groups, WIDE_LIMIT, WIDE_TREES, 1), "simhash-loose")
    comps = connected_components(_exact_links(groups, loose, keyed, words), "simhash-components")
    return _named(docs, groups, comps, ["fp", "digest"]).select(F.col("id").alias(id_col), "k1", "k2", "component_id", "part")
