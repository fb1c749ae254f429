"""Exact BPE by dynamic programming over prefixes, and its inverse.

A merge vocabulary gives every byte string one encoding. Every prefix of a piece of text has an encoding too,
and its last token alone tells the rest: cut that token off and the same holds for the shorter prefix. So one
token a prefix is stored, and no merge is ever replayed on the text:

1. An automaton over the vocabulary reads the piece; at each byte its suffix links list the tokens that end
   there, longest first.
2. A token is the prefix's last one if it may stand after the last token of the prefix before it. Two tokens may
   stand side by side if, while both were being built, no merge across their border came first: only the pieces
   on the right edge of the left one and on the left edge of the right one can take part (``Vocabulary.stays``).
3. The first token to pass is the only one; from the end, each token's length points back to the next.

Encoding is a map over rows without a shuffle. Pieces repeat, so their ids are remembered, up to a bound that
changes memory and time alone. A piece of any length takes one pass and one integer a byte.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import small_batches

#: Remembered pieces and pairs of tokens a Python worker, the longest piece that is remembered and the texts that are cut together (characters).
PIECES, PAIRS, LONGEST, TOGETHER = 400_000, 1_000_000, 40, 1 << 21
NEVER = 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens as byte strings, each with the two it was merged from; parts always come before what is made of them."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        import ahocorasick

        self.bytes_of = {i: b for b, i in tokens.items()}
        self.size_of = {i: len(b) for b, i in tokens.items()}
        self.made: dict[int, dict[int, int]] = {}  # left token -> right token -> when the two are merged
        born = {tokens[bytes([b])]: -1 for b in range(256)}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            a, b, whole = tokens[a], tokens[b], tokens[a + b]
            if a not in born or b not in born:
                raise ValueError("a merge uses a token that no earlier merge makes")
            self.made.setdefault(a, {})[b] = k
            if whole not in born:
                born[whole], self.parts[whole] = k, (a, b)
        self.born = born
        self.found = ahocorasick.Automaton()
        for i in born:
            piece = self.bytes_of[i]
            self.found.add_word(piece.decode("latin-1"), (i, len(piece)))
        self.found.make_automaton()
        self._left: dict[int, tuple] = {}
        self._right: dict[int, tuple] = {}
        self._stays: dict[int, bool] = {}

    def _edge(self, token: int, side: int, known: dict[int, tuple]) -> tuple:
        """The pieces at one edge of a token while it is built, each with the moment at which it goes into the next."""
        out = known.get(token)
        if out is None:
            out, gone, piece = [], NEVER, token
            while True:
                out.append((piece, gone))
                if piece not in self.parts:
                    break
                piece, gone = self.parts[piece][side], self.born[piece]
            out = known[token] = tuple(out)
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether the encoding of both texts together is just these two tokens."""
        key = left << 32 | right
        out = self._stays.get(key)
        if out is None:
            if len(self._stays) >= PAIRS:
                self._stays.clear()
            out = self._stays[key] = self._apart(left, right)
        return out

    def _apart(self, left: int, right: int) -> bool:
        for a, a_gone in self._edge(left, 1, self._right):
            after = self.made.get(a)
            if after:
                for b, b_gone in self._edge(right, 0, self._left):
                    when = after.get(b, NEVER)
                    # equal moments mean the same pair thrice in a row, where the leftmost is merged first
                    if when < a_gone and when <= b_gone:
                        return False
        return True

    def encode(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The ids of each piece: the last token of every prefix, then back from the end.

        What the tokens of a prefix are does not depend on what follows, so a piece starts where it parts from the one before it.
        """
        known, size_of, found = self._stays, self.size_of, self.found.iter
        before, last = b"", [0]
        for piece in pieces:
            done, most = 0, min(len(before), len(piece))
            while done < most and before[done] == piece[done]:
                done += 1
            before, last = piece, last[: done + 1] + [0] * (len(piece) - done)
            for at, (token, size) in found(piece.decode("latin-1")):
                if at < done:  # this prefix has its token
                    continue
                if size <= at:
                    left = last[at + 1 - size]
                    fits = known.get(left << 32 | token)
                    if not (self.stays(left, token) if fits is None else fits):
                        continue
                done = at + 1
                last[done] = token
            out, end = [], len(piece)
            while end:
                token = last[end]
                out.append(token)
                end -= size_of[token]
            out.reverse()
            yield out


class Pieces(dict):
    """Ids of pieces of text as little-endian 32-bit words, made when asked for and remembered within a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, lists: list[list[str]]) -> None:
        """Encode what is new in lists of pieces at once, in order, so that like beginnings are read once."""
        asked = {p for p in set().union(*lists) if len(p) <= LONGEST}
        if len(self) + len(asked.difference(self)) > PIECES:
            self.clear()
        new = sorted(p.encode("utf-8") for p in asked.difference(self))
        for piece, ids in zip(new[:PIECES], self.vocabulary.encode(new[:PIECES])):
            self[piece.decode("utf-8")] = _words(ids)

    def __missing__(self, piece: str) -> bytes:
        return _words(next(self.vocabulary.encode([piece.encode("utf-8")])))


def _words(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _character_class(kinds: str, end: int) -> str:
    """The characters below ``end`` whose Unicode category starts with one of ``kinds`` (or is one of two letters), as a class body."""
    hit = [unicodedata.category(chr(c)).startswith(tuple(kinds.split())) for c in range(end)] + [False]
    out, start = [], None
    for c, h in enumerate(hit):
        if h and start is None:
            start = c
        elif not h and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Tokenizer:
    """A byte-level BPE file: how it cuts text into pieces, the added tokens that it takes whole, and the vocabulary."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer as File

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE file")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError("this kind of BPE model is not supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be matched as they stand")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = {k: struct.pack("<I", i) for k, i in self.added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.vocabulary = Vocabulary({raw(t): i for t, i in model["vocab"].items() if t not in self.added}, [(raw(a), raw(b)) for a, b in pairs])
        bytes_of = self.vocabulary.bytes_of | {i: raw(t) if all(c in byte_of for c in t) else t.encode() for t, i in self.added.items()}
        self.text_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.pieces = Pieces(self.vocabulary)
        self.stop = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # fixed value: the pieces of byte-level vocabularies of this kind
        rule = r" ?{L}+| ?{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
        self.cut = regex.compile(rule.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}")).findall
        letters, numbers = _character_class("L", 0x250), _character_class("N", 0x250)
        self.cut_latin = re.compile(rule.format(L=f"[{letters}]", N=f"[{numbers}]", l=letters, n=numbers)).findall
        #: Python's re takes U+001C to U+001F for white space, Unicode does not
        self.latin = re.compile("[\x00-\x1b\x20-ɏ]*").fullmatch
        self.unassigned = re.compile(f"[{_character_class('Cn', 0x110000)}]").search
        self.file_pieces = File.from_file(path).pre_tokenizer.pre_tokenize_str

    def cuts(self, text: str) -> list[str]:
        """The pieces of a text without added tokens. Characters too new for Python's Unicode tables are cut as the file's own library does."""
        if self.latin(text):
            return self.cut_latin(text)
        if self.unassigned(text):
            return [text[a:b] for _, (a, b) in self.file_pieces(text)]
        return self.cut(text)

    def parts(self, text: str) -> tuple[list[list[str]], list[str]]:
        """The pieces of each stretch between added tokens, and these tokens."""
        if self.stop is None or not self.stop.search(text):
            return [self.cuts(text)], []
        out, marks, at = [], [], 0
        for hit in self.stop.finditer(text):
            out.append(self.cuts(text[at : hit.start()]))
            marks.append(hit.group())
            at = hit.end()
        return [*out, self.cuts(text[at:])], marks

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """All ids of each text as little-endian unsigned 32-bit words; texts are cut together up to ``TOGETHER`` characters."""
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(self.parts(text or ""))
            size += len(text or "")
            if size >= TOGETHER or k == len(texts) - 1:
                self.pieces.learn([cut for cuts, _ in held for cut in cuts])
                for cuts, marks in held:
                    ids = [b"".join(map(self.pieces.__getitem__, cut)) for cut in cuts]
                    yield ids[0] + b"".join(self.words[m] + rest for m, rest in zip(marks, ids[1:]))
                held, size = [], 0

    def decode(self, raw: bytes) -> str:
        """The text of ids; ids outside the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD."""
        ids = array("I", raw)
        if sys.byteorder == "big":
            ids.byteswap()
        try:
            return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(self.text_of[i] for i in ids if i < len(self.text_of)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    """One a Python worker and file: Spark uses a worker for many tasks."""
    out = Tokenizer(path)
    gc.freeze()  # it lives as long as the worker: the collector need not walk it again and again
    return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id_col, ids``: each whole text's ids, as little-endian unsigned 32-bit words in one binary.

    A null or empty text has no ids (an empty binary, not null); null and repeated row ids stay as they are; an empty
    table gives an empty result; further columns are ignored, whatever their names. Special tokens in a text become
    their ids, as the file's added tokens say; none is added.
    """
    small_batches(df.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for batch in batches:
            ids = pa.array(own.encode(batch.column(1).to_pylist()), pa.binary())
            yield pa.record_batch([batch.column(0), ids], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ids_col: str = "ids", into: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the text of its ids (as ``encode`` gives them) in column ``into``; null ids give a null text.

    Special tokens are written out. Raises where a binary is not made of whole 32-bit words.
    """
    small_batches(df.sparkSession)
    path = tokenizer or default_tokenizer()
    kept = df.drop(into)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for batch in batches:
            texts = [None if raw is None else own.decode(raw) for raw in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], schema=batch.schema.append(pa.field(into, pa.string())))

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, StringType())]))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: digests of every text's ids and of the text that they give back."""
    both = decode(encode(df, id_col, text_col, tokenizer), "ids", "decoded", tokenizer)
    return both.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
