"""Runs of repeated words, found by probing a harmonic grid.

A run is a stretch of words with smallest period ``q`` that cannot be extended, of at least ``LEAST_WORDS`` words
and ``LEAST_TIMES`` periods. Whatever its start, such a run covers three neighbouring points ``jq, (j+1)q, (j+2)q`` of the grid of
its period, and each word from the first to the second equals the one a period later:

1. For every period p up to n / 3, the words at all jp and (j + 1)p are compared, the points of many periods in one
   array operation. There are n / 1 + n / 2 + ... probes, n log n in all.
2. A point that passes is probed again at a few places up to its neighbour. Points that lie, with two periods, within a run
   that was found before are skipped: two periods that agree so long agree only as multiples, which gives that run again.
3. What is left is extended to both sides by comparing chunks that double in size, and kept if it is long enough.

Periods are tried in rising order, so a stretch that comes up again with a multiple of its period is known.
Documents are independent: the work is a map without a shuffle, each text whole, in arrays of one integer a word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST_WORDS, LEAST_TIMES = 24, 3
#: First and largest chunk of words that are compared at once while a run is extended.
CHUNK, LARGEST = 64, 1 << 16
#: Grid points that are probed in one array operation.
GRID = 1 << 17
FIELDS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def numbered(words: list[str]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _reach(a: np.ndarray, p: int, at: int) -> int:
    """The first place from ``at`` on that differs from the one a period later (or has none)."""
    size, end = CHUNK, len(a) - p
    while at < end:
        stop = min(end, at + size)
        same = a[at:stop] == a[at + p : stop + p]
        if not same.all():
            return at + int(same.argmin())
        at, size = stop, min(2 * size, LARGEST)
    return end


def _reach_back(a: np.ndarray, p: int, at: int) -> int:
    """The first place of the stretch before ``at`` all of which equals what is a period later."""
    size = CHUNK
    while at > 0:
        stop = max(0, at - size)
        differs = a[stop:at] != a[stop + p : at + p]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, size = stop, min(2 * size, LARGEST)
    return 0


def _blocks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid of all periods up to a third of ``n``: points and their periods, ``GRID`` points at a time (or one period's)."""
    first, most = 1, n // LEAST_TIMES
    while first <= most:
        last = min(most, first + max(0, GRID * first // n))
        periods = np.arange(first, last + 1)
        count = (n - 1) // periods
        p = np.repeat(periods, count)
        yield (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p, p
        first = last + 1


def _survivors(a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each period with its grid points that may lie in a run: equal to the next point, as are four words up to there."""
    for at, p in _blocks(len(a)):
        for step in (None, 0, 1, 2, 3):
            off = 0 if step is None else (p, 1, p // 2, p - 1)[step]
            near = at + off + p < len(a)
            at, p = at[near], p[near]
            off = 0 if step is None else (p, 1, p // 2, p - 1)[step]
            same = a[at + off] == a[at + off + p]
            at, p = at[same], p[same]
        cuts = np.flatnonzero(p[1:] != p[:-1]) + 1
        if len(p):
            for here, points in zip(p[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                yield here, points


def runs_of(a: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of numbered words, by start, then period."""
    found: dict[tuple[int, int], list[int]] = {}
    wide: list[tuple[int, int]] = []  # found runs of two periods and more, as periods rise
    for p, hits in _survivors(a) if len(a) >= LEAST_WORDS else ():
        wide = sorted((start, end) for start, end in wide if end - start >= 2 * p)
        if wide:
            starts, ends = np.array(wide).T
            reached = np.r_[0, np.maximum.accumulate(ends)][np.searchsorted(starts, hits, side="right")]
            # two periods within a run of a smaller one: they cannot agree but as that very run
            hits = hits[hits + 2 * p > reached]
        done = 0
        for at in hits.tolist():
            if at < done:
                continue
            last = _reach(a, p, at)
            done = last
            if last <= at + p:
                continue
            first = _reach_back(a, p, at)
            length = last + p - first
            known = found.setdefault((first, length), [])
            if length >= max(LEAST_WORDS, LEAST_TIMES * p) and not any(p % q == 0 for q in known):
                known.append(p)
                wide.append((first, first + length))
    return sorted(((start, length, p) for (start, length), periods in found.items() for p in periods), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period alone."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most repetitions; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[str], doc_id) -> list[str]:
    """A repeatable test input: some documents, chosen by their id, repeat a stretch to their end."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _row(text: str | None, doc_id, plant: bool) -> tuple:
    words = words_of(text or "")
    if plant:
        words = planted(words, doc_id)
    runs = runs_of(numbered(words))
    best = strongest(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join([w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays] if runs else words)
    numbers = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *numbers, listed, left)


def _map(df: DataFrame, id_col: str, text_col: str, plant: bool, fields: str, finish) -> DataFrame:
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield finish(batch.column(0), [_row(t, i, plant) for i, t in zip(ids, batch.column(1).to_pylist())])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _numbers(ids, rows: list[tuple]) -> list:
    return [ids] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its runs cut to one period.

    Returns ``id_col, n_runs, start, length, period, exponent_milli`` (of the run that repeats most; null without one),
    ``runs`` (a line ``start,length,period`` for every run) and ``text`` (the kept words joined by one space). A null text counts as
    empty and gives an empty one; null and repeated ids are rows of their own; an empty table gives an empty result; further columns are ignored.
    """
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"]

    def finish(ids, rows):
        return pa.record_batch([*_numbers(ids, rows), pa.array([r[5] for r in rows], pa.string()), pa.array([r[6] for r in rows], pa.string())], names=names)

    return _map(df, id_col, text_col, False, "n_runs long, start long, length long, period long, exponent_milli long, runs string, text string", finish)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """``collapse`` with digests in place of its texts; ``plant`` first rewrites some documents (``planted``), a null id none."""
    names = ["id", *(f.split()[0] for f in FIELDS.split(", "))]
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def finish(ids, rows):
        return pa.record_batch([*_numbers(ids, rows), *(pa.array([digest(r[k]) for r in rows], pa.string()) for k in (5, 6))], names=names)

    return _map(df, id_col, text_col, plant, FIELDS, finish)
