"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language owns one Bloom filter, holding its most frequent n-grams. The filters are stored sliced: cell
h of the table is a bitmask of the languages whose filter has bit h set, so that one lookup per hash, and
the AND of the looked-up masks, returns every language that contains an n-gram. A text's n-grams are
counted by language bit; each count is corrected for the chance hits that its filter's fill predicts, and
the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, unit_hash

#: Labelled rows used for training, about; every language's n-gram counts come from these.
TRAIN_ROWS = 20_000
SIZES = (3, 4)
#: N-grams kept for one language, over all sizes.
PROFILE = 3000
CELLS, HASHES = 1 << 17, 2
#: Characters handled at once, so that a long text needs bounded memory.
STRETCH = 1 << 18
UNDETERMINED = "und"
_letters = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _stretches(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Code points of the lower-cased text, letters kept and all else one space, in stretches of bounded size.

    A stretch ends at a space, so no n-gram is cut; inside a word longer than a stretch it repeats the last
    letters of the one before, and ``fresh`` says whether it does not.
    """
    low = text.lower()
    at, fresh = 0, True
    while at < len(low):
        end = min(len(low), at + STRETCH)
        part = np.frombuffer(low[at:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letter_table()[part]
        whole = True
        if end < len(low):
            gaps = np.flatnonzero(~letter)
            whole = bool(len(gaps))
            if whole:
                end = at + int(gaps[-1]) + 1
                part, letter = part[: gaps[-1] + 1], letter[: gaps[-1] + 1]
        c = np.where(letter, part, 32).astype(np.uint64)
        c = c[np.r_[True, letter[1:] | letter[:-1]]] if len(c) else c
        yield np.r_[np.full(int(fresh), 32, np.uint64), c, np.full(int(whole), 32, np.uint64)], fresh
        at, fresh = (end, True) if whole else (end - max(SIZES) + 1, False)


def _grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the text's words that hold a letter, stretch by stretch; sizes do not collide."""
    for c, fresh in _stretches(text or ""):
        for n in SIZES:
            own = c if fresh else c[max(SIZES) - n :]  # n-grams of repeated letters alone were given before
            if len(own) < n:
                continue
            h = np.full(len(own) - n + 1, n, dtype=np.uint64)
            space = np.ones(len(h), dtype=bool)
            for k in range(n):
                piece = own[k : len(own) - n + 1 + k]
                h = (h ^ piece) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    space &= piece != 32  # n-grams do not cross from word to word
            yield h[space]


def gram_hashes(text: str | None) -> np.ndarray:
    """All n-gram hashes of a text at once."""
    return np.concatenate([np.zeros(0, dtype=np.uint64), *_grams(text)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageMasks:
    """The sliced filters: ``cells[w][h]`` has bit l % 64 of word w = l // 64 set for each language l with bit h set."""

    languages: list[str]
    cells: np.ndarray
    chance: np.ndarray
    fallback: str

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], fallback: str) -> LanguageMasks:
        languages = sorted(grams)
        cells = np.zeros((max(1, -(-len(languages) // 64)), CELLS), dtype=np.uint64)
        chance = np.zeros(len(languages))
        for k, name in enumerate(languages):
            for at in cls._at(np.asarray(grams[name], dtype=np.uint64)):
                cells[k // 64][at] |= np.uint64(1 << (k % 64))
            chance[k] = float((cells[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) ** HASHES
        return cls(languages, cells, chance, fallback)

    @staticmethod
    def _at(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(20 * i)) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(HASHES)]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds: the popcount of its bit over the looked-up masks."""
        at = self._at(hashes)
        hits = np.zeros(len(self.languages))
        for w in range(len(self.cells)):
            mask = self.cells[w][at[0]]
            for a in at[1:]:
                mask &= self.cells[w][a]
            for k in range(64 * w, min(len(self.languages), 64 * w + 64)):
                hits[k] = np.count_nonzero(mask & np.uint64(1 << (k % 64)))
        return hits

    def _corrected(self, hits: np.ndarray, total: int) -> np.ndarray:
        """(hits - n p) / (1 - p), at least 0: what is left of the hits without the false positives expected of n n-grams."""
        return np.maximum(0.0, (hits - total * self.chance) / np.maximum(1e-9, 1 - self.chance))

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        return self._corrected(self.hits(hashes), len(hashes))

    def text_counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """Corrected counts of a text and the number of its n-grams, stretch by stretch."""
        hits, total = np.zeros(len(self.languages)), 0
        for h in _grams(text):
            hits += self.hits(h)
            total += len(h)
        return self._corrected(hits, total), total

    def decide(self, text: str | None, least: float = 0.0) -> tuple[str, float]:
        """Language and score: the best corrected count over the sum of the two best (1 if there is no second).

        Where ``least`` is given, a text of which the best language holds a smaller share of the n-grams is undetermined.
        """
        if not has_letter(text):
            return UNDETERMINED, 0.0
        c, total = self.text_counts(text)
        if not len(c) or c.max() <= 0:
            return self.fallback if least <= 0 else UNDETERMINED, 0.0
        if c.max() < least * total:
            return UNDETERMINED, 0.0
        best = int(c.argmax())  # ties: first by name
        rival = float(np.partition(c, -2)[-2]) if len(c) > 1 else 0.0
        return self.languages[best], float(c[best] / (c[best] + rival))


def fit(df: DataFrame, where, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageMasks:
    """Build the filters from rows that satisfy ``where`` and have a language; about ``rows`` of them, by hash of the id.

    N-gram counts are summed on the executors; only each language's ``PROFILE`` most frequent ones come to
    the driver. Without any labelled row all texts are undetermined.
    """
    spark = df.sparkSession
    small_batches(spark)
    known = df.where(where & F.col(lang_col).isNotNull())
    sizes = {r["l"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageMasks([], np.zeros((1, CELLS), np.uint64), np.zeros(0), UNDETERMINED)
    share = min(1.0, rows / sum(sizes.values()))
    sample = known.where(unit_hash(id_col, seed=3) < F.lit(share)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            for lang, parts in seen.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n})
            seen.clear()

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for t in part["text"]:
                    for h in _grams(t):
                        seen.setdefault(lang, []).append(h)
                        held += len(h)
                        if held > 8 * STRETCH:
                            yield from flush()
                            held = 0
        yield from flush()

    grams = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("r", rank).where(F.col("r") <= PROFILE).select("lang", "gram").collect()
    by: dict[str, list[int]] = {}
    for r in top:
        by.setdefault(r["lang"], []).append(r["gram"])
    fallback = min(sizes, key=lambda x: (-sizes[x], x))
    return LanguageMasks.build({k: np.array(v, dtype=np.int64).view(np.uint64) for k, v in by.items()}, fallback)


def identify(df: DataFrame, masks: LanguageMasks, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (0..1) for every row, and the columns named in ``keep``.

    'und' with score 0 where the text is null or has no letter. A text whose letters match no filter gets
    the most frequent training language, score 0; with ``least``, 'und' where no language holds that share of
    the n-grams. Repeated rows are judged each; an empty table gives an
    empty result.
    """
    small_batches(df.sparkSession)
    schema = df.select(F.col(id_col), F.col(text_col).alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema if f.name != "_text")
    table = df.sparkSession.sparkContext.broadcast(masks)  # CELLS words for 64 languages: about 1 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = table.value
        for pdf in batches:
            got = [own.decide(t, least) for t in pdf["_text"]]
            out = pdf.drop(columns="_text")
            out["lang_pred"], out["score"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    return schema.mapInPandas(run, fields + ", lang_pred string, score double")
