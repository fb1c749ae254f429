"""Packing by lexical retrieval: documents that share words share windows.

1. Texts are tokenised once; the ids go to the shared folder as compressed 16-bit words, with a route: two
   min-hashes of the document's token set. Ordered by route, similar documents are neighbours.
2. The table is dealt by ranges of the route that hold equally many ids (a crowded route is cut by a hash),
   and each task packs its range in shards of about ``SHARD_TOKENS`` ids. A shard has a BM25 inverted index
   of its documents; a seed asks it, with all its terms, for unused neighbours, which fill the seed's window.
   The document that no longer fits is cut, and its rest starts the next window. Every id lands in exactly
   one piece; only the last window of a task is left with padding.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small_batches

WINDOW, END = 2048, 1
TOKENS_PER_TASK = 8_000_000
SHARD_TOKENS = 1_000_000
#: Leading bits of the route whose ids are counted for the cuts.
CELL_BITS = 12
#: Neighbours fetched at once; when they are used up and the window is not full, the seed asks again.
FETCH = 64
K1, B = 1.2, 0.75
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of a byte-level BPE vocabulary as little-endian 16-bit words.

    Texts of Latin letters, digits and punctuation go through the same vocabulary as merge ranks, which is
    several times faster; where all white space is lone spaces and newlines the pre-tokeniser also needs no
    look-ahead. All other texts go through ``tokenizers`` itself. The ids are the same (tested).
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        char_of = _byte_alphabet()
        ranks = {bytes(char_of[c] for c in w): i for w, i in vocab.items() if w != "<|endoftext|>" and all(c in char_of for c in w)}
        # fixed value: the pieces of this vocabulary's pre-tokeniser, then its two rules for white space
        pieces = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        self.simple = tiktoken.Encoding("simple", pat_str=pieces + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pieces + r"|\s+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if _SIMPLE(text):
            ids = (self.plain if _plain(text) else self.simple).encode_ordinary(text)
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        return array("H", ids).tobytes()


_SIMPLE = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*").fullmatch


def _plain(text: str) -> bool:
    """Whether all white space of a simple text is lone spaces and newlines between words."""
    return text.count(" ") + text.count("\n") == len(text.split()) - 1 and "\t" not in text and "\r" not in text


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenise(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, route, ids``: token count with the end id, lexical route, compressed ids."""
    small_batches(df.sparkSession)
    rng = np.random.default_rng(9)
    order = [rng.permutation(1 << 16).astype(np.uint16) for _ in range(2)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, press = Tokens(path), zstandard.ZstdCompressor(level=1)
        end = np.array([END], dtype="<u2").tobytes()
        for pdf in batches:
            n, route, ids = [], [], []
            for t in pdf["text"]:
                raw = (tokens.ids(t) if t else b"") + end
                a = np.frombuffer(raw, dtype="<u2")
                n.append(len(a))
                route.append((int(order[0][a].min()) << 16) | int(order[1][a].min()))
                ids.append(press.compress(raw))
            yield pd.DataFrame({"doc_id": pdf["id"], "n": n, "route": route, "ids": ids})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n long, route long, ids binary")


class Shard:
    """BM25 over the token sets of one shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        term, doc, count = [], [], []
        for k, a in enumerate(docs):
            c = np.bincount(a, minlength=1 << 16) if len(a) > 20_000 else None
            t, f = (np.flatnonzero(c), c[c > 0]) if c is not None else np.unique(a, return_counts=True)
            term.append(t.astype(np.uint16))
            count.append(f.astype(np.float64))
            doc.append(np.full(len(t), k))
        self.own = term
        length = np.array([len(a) for a in docs], dtype=np.float64)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        flat, owner, tf = np.concatenate(term), np.concatenate(doc), np.concatenate(count)
        at = np.argsort(flat, kind="stable")
        self.start = np.r_[0, np.cumsum(np.bincount(flat, minlength=1 << 16))]
        df = np.diff(self.start)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        self.doc = owner[at]
        self.weight = idf[flat[at]] * tf[at] * (K1 + 1) / (tf[at] + norm[owner[at]])
        self.value = np.where(df > 1, idf, 0.0)  # a term of one document finds no neighbour

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of the seed that another document has."""
        terms = self.own[seed]
        terms = terms[self.value[terms] > 0].astype(np.int64)
        size = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(terms) else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)

    def neighbours(self, score: np.ndarray, used: np.ndarray, most: int = FETCH) -> np.ndarray:
        """Unused documents by their scores, best first; ties in shard order."""
        found = np.flatnonzero((score > 0) & ~used)
        if len(found) > 4 * most:  # whatever ties with the last of the best stays
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return found[np.argsort(-score[found], kind="stable")[:most]]


class Packer:
    """Fills windows one after the other and records the pieces."""

    def __init__(self, first_sequence: int):
        self.rows: list[tuple] = []
        self.begin(first_sequence)

    def begin(self, sequence: int) -> None:
        self.sequence, self.filled = sequence, 0

    def place(self, doc_id, ids: np.ndarray) -> bool:
        """Add a whole document; True if it closed at least one window."""
        start, closed = 0, False
        while start < len(ids):
            take = min(WINDOW - self.filled, len(ids) - start)
            crc = zlib.crc32(ids[start : start + take].astype("<u4").tobytes())
            self.rows.append((doc_id, start, take, crc, len(ids), self.sequence, self.filled))
            start, self.filled = start + take, self.filled + take
            if self.filled == WINDOW:
                self.sequence, self.filled, closed = self.sequence + 1, 0, True
        return closed

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        index, used = Shard(docs), np.zeros(len(docs), dtype=bool)
        fresh, seed, score, asked = 0, None, None, None
        while True:
            if seed is None:
                while fresh < len(docs) and used[fresh]:
                    fresh += 1
                if fresh == len(docs):
                    return
                seed = fresh
                used[seed] = True
                self.place(doc_ids[seed], docs[seed])
            if self.filled == 0:
                seed = None
                continue
            if seed != asked:
                score, asked = index.scores(seed), seed
            near = index.neighbours(score, used)
            if not len(near):
                seed = None
                continue
            for k in near:
                used[k] = True
                if self.place(doc_ids[k], docs[k]):
                    seed = int(k) if self.filled else None  # its rest starts the next window
                    break


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``WINDOW`` ids.

    Returns one row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit words), ``doc_tokens`` (all ids of the
    document, its end id 1 included), ``sequence_id`` and ``offset`` in the sequence. A null or empty text
    is the end id alone. Rows repeated with one id are documents of their own. Sequence ids are unique, not
    dense: each range counts from its own 2**32 block. An empty table gives an empty result; further columns are ignored.
    """
    spark = df.sparkSession
    tokens = materialise(tokenise(df, tokenizer or default_tokenizer(), id_col, text_col), "pack-tokens")
    cell = F.shiftright("route", 32 - CELL_BITS).cast("int")
    # at most 2 ** CELL_BITS rows
    cells = tokens.groupBy(cell.alias("cell")).agg(F.sum("n").alias("size"))
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = materialise(cells.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))), "pack-cells")
    total = cells.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, math.ceil(total / TOKENS_PER_TASK))
    parts = F.ceil(F.col("size") / F.lit(TOKENS_PER_TASK))
    place = F.col("start") + (F.pmod(F.xxhash64("doc_id", "n", "ids"), parts) + 0.5) / parts * F.col("size")
    task = F.least(F.floor(place / F.lit(TOKENS_PER_TASK)), F.lit(tasks - 1)).cast("int")
    dealt = tokens.withColumn("cell", cell).join(F.broadcast(cells), "cell").withColumn("task", task).select("task", "route", "doc_id", "n", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, press = Packer(0), zstandard.ZstdDecompressor()
        doc_ids: list = []
        docs: list[np.ndarray] = []
        size, here = 0, None

        def flush() -> pd.DataFrame:
            packer.shard(doc_ids, docs)
            out = pd.DataFrame(packer.rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            packer.rows = []
            return out

        for pdf in batches:
            for at, doc_id, raw in zip(pdf["task"], pdf["doc_id"], pdf["ids"]):
                if at != here:
                    if docs:
                        yield flush()
                        doc_ids, docs, size = [], [], 0
                    here = at
                    packer.begin(int(at) << 32)
                a = np.frombuffer(press.decompress(raw), dtype="<u2")
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                docs.append(a)
                size += len(a)
                if size >= SHARD_TOKENS:
                    yield flush()
                    doc_ids, docs, size = [], [], 0
        if docs:
            yield flush()

    small_batches(spark)
    ordered = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "route", "doc_id", "n", "ids")
    return ordered.mapInPandas(run, FIELDS)
