"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Training, on a bounded sample of labelled rows. Labels mark documents, not passages, so the passages that make
a document toxic are found first: word beginnings that stand beside many different words in toxic documents and
beside few in ordinary ones (copies repeat the words beside it, so groups of copies count once). One zstandard
dictionary is trained on these passages, another on the windows of ordinary text.

Scoring, on whole texts: every window of ``WINDOW`` words (a long run without spaces is cut) is compressed
twice, with the ordinary dictionary alone and with the toxic one in front of it; what the toxic dictionary
saves is the window's distance. A document's score is a logistic function of how many of its windows save at
least each of the ``GAPS``. It is calibrated on a quarter of the training texts, measured with dictionaries of
the others, so that no text is judged by a dictionary that holds it; the final dictionaries hold all.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labelled rows of each class used for training, at most, and the characters that they may hold together. Rows are
#: taken in hash order, leaving out those that do not fit; the texts taken are read whole.
MAX_DOCS = 2500
MAX_TRAIN_CHARS = 24_000_000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 32768
#: Bytes saved that the windows are counted by; one in so many training texts calibrates instead of training.
GAPS = (2, 3, 4, 5)
FOLDS = 4
#: Windows of ordinary text that its dictionary is trained on, at most; evenly spread over all.
MOST_SAMPLES = 100_000
#: The same search for both dictionaries, thorough enough that neither misses a match that it holds.
SEARCH = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 4, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY}
#: What ends the entropy tables that a trained dictionary begins with: its first three offsets, 1, 4 and 8.
OFFSETS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"
#: Bytes of the shortest match, and bits of the places in the table of the beginnings, so long, of the toxic dictionary's telling runs.
GRAM, PLACES = SEARCH["min_match"], 20
#: Words of a window and between the starts of two; characters of a window of a run without spaces.
WINDOW, STEP, RUN = 2, 1, 32
#: Both dictionaries end with this and every window stands between two of it: inputs of a few bytes are stored raw, and
#: a match is not looked for in an input's last eight bytes.
LEAD = b"\n0123456789ab\n"
#: Windows that a worker remembers before it starts anew; a window has ``WINDOW * RUN`` characters at most.
CACHE = 300_000
EDGES = ".,;:!?\"'()[]{}<>*$%&#|-¿¡«»"
SHORTEST, LONGEST = 3, 12
#: Places around a word whose words are counted: a phrase that always repeats varies at its edges only.
AROUND = (-2, -1, 1, 2)


def _words(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


def windows(text: str | None) -> Iterator[bytes]:
    """The lower-cased text's windows as UTF-8; they overlap and cover all of it."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    for at in range(0, max(1, len(words) - WINDOW + STEP) if words else 0, STEP):
        part = b" ".join(words[at : at + WINDOW])
        if len(part) <= WINDOW * RUN:
            yield part
        else:
            for k in range(0, len(part), RUN // 2):
                yield part[k : k + RUN]


def _beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


def _beside(texts: list[str], wanted: set[str]) -> dict[str, int]:
    """For each of the wanted word beginnings that occur the most different words that stand at one of the places around it."""
    near: dict[str, tuple[set[str], ...] | None] = {}
    for t in texts:
        words = ["", "", *_words(t), "", ""]
        for k in range(2, len(words) - 2):
            w = words[k]
            if w not in near:
                near[w] = tuple(set() for _ in AROUND) if any(g in wanted for g in _beginnings(w)) else None
            if near[w] is not None:
                for place, seen in zip(AROUND, near[w]):
                    seen.add(words[k + place])
    begins: defaultdict[str, list[tuple[set[str], ...]]] = defaultdict(list)
    for w, seen in near.items():
        if seen is not None:
            for g in _beginnings(w):
                if g in wanted:
                    begins[g].append(seen)
    return {g: max(len(set().union(*(seen[k] for seen in all_seen))) for k in range(len(AROUND))) for g, all_seen in begins.items()}


def _toxic_beginnings(toxic: list[str], ordinary: list[str]) -> set[str]:
    na, nb = max(1, len(toxic)), max(1, len(ordinary))
    least = max(4, 0.01 * na)
    often: Counter[str] = Counter()  # no more different words stand beside one than it occurs
    for w, n in Counter(w for t in toxic for w in _words(t)).items():
        for g in _beginnings(w):
            often[g] += n
    a = {g: n for g, n in _beside(toxic, {g for g, n in often.items() if n >= least}).items() if n >= least}
    b = _beside(ordinary, set(a))
    return {g for g, n in a.items() if n / na >= 8 * max(b.get(g, 0), 0.5) / nb}


def _train(samples: list[bytes], size: int) -> bytes:
    """The text of a zstandard dictionary of the samples, without its tables; of too few for training, the samples themselves."""
    flat = b"".join(samples)
    if len(samples) >= 100:
        try:
            return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes().partition(OFFSETS)[2] or flat[-size:]
        except zstandard.ZstdError:
            pass
    return flat[-size:]


def _gram_places(data: bytes) -> np.ndarray:
    """A place in a table for each run of ``GRAM`` bytes."""
    places = np.ndarray(max(0, len(data) - GRAM + 1), dtype="<u4", buffer=data, strides=(1,)) * np.uint32(0x9E3779B1)
    places >>= np.uint32(32 - PLACES)
    return places


def _telling_runs(toxic: bytes, rest: bytes) -> set[bytes]:
    """The shortest runs that begin in the toxic dictionary, fit a window and are nowhere in the rest; none begins with another."""
    data, out = toxic + rest, set()
    for at in range(len(toxic)):
        for n in range(GRAM, WINDOW * RUN + 1):
            run = data[at : at + n]
            if run.count(b" ") >= WINDOW:
                break
            if run not in rest:
                out.add(run)
                break
    return out


@dataclass
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # intercept, and one weight for log(1 + windows) of each gap and of all

    def compressors(self):
        out = []
        for data in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(data + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return out


class WindowScorer(dict):
    """Measures the windows of texts with both dictionaries; a window's saving is remembered, as copies repeat theirs.

    A match is ``min_match`` bytes at least, and the toxic dictionary's places are tried after all others, so that one of them is
    taken only if it is longer than every other. A window without a run of bytes that only the toxic dictionary holds is
    therefore compressed alike by both and saves nothing: only the other windows are measured."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        ordinary, toxic = model.compressors()
        self.weights, self.ordinary, self.toxic = np.array(model.weights), ordinary.compress, toxic.compress
        # a match must not run on into what stands around a window
        self.skips = len(model.ordinary) >= WINDOW * RUN and b"\n" not in model.toxic + model.ordinary[: WINDOW * RUN]
        self.telling, lengths = _telling_runs(model.toxic, model.ordinary + LEAD) if self.skips else set(), defaultdict(set)
        self.places = np.zeros(1 << PLACES, dtype=bool)
        for run in self.telling:
            lengths[run[:GRAM]].add(len(run))
            self.places[_gram_places(run[:GRAM])] = True
        self.lengths = dict(lengths)

    def _tell(self, data: bytes) -> np.ndarray:
        """Where the telling runs in it start and end."""
        found = []
        for at in np.flatnonzero(self.places[_gram_places(data)]).tolist():
            for n in self.lengths.get(data[at : at + GRAM], ()):
                if data[at : at + n] in self.telling:
                    found.append((at, at + n))
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def worth(self, words: list[bytes]) -> list[bytes]:
        """The windows of two words, none long, that hold a telling run."""
        data = b" ".join(words)
        starts, ends = self._tell(data).T
        if not len(starts):
            return []
        spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
        # the last window that begins at or before the run, and the first one that ends at or after it
        both = np.union1d(np.searchsorted(spaces, starts), np.searchsorted(spaces, ends) - 1)
        return [words[k] + b" " + words[k + 1] for k in both.tolist() if 0 <= k < len(words) - 1]

    def worth_of(self, parts: list[bytes]) -> list[bytes]:
        """The same of any windows."""
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        return [parts[k] for k in np.unique(np.searchsorted(ends, self._tell(b"\n".join(parts))[:, 0], side="right")).tolist()]

    def __missing__(self, window: bytes) -> int:
        framed = LEAD + window + LEAD
        saved = len(self.ordinary(framed)) - len(self.toxic(framed))
        if len(self) >= CACHE:
            self.clear()
        self[window] = saved
        return saved

    def savings(self, text: str | None) -> list[int]:
        return list(map(self.__getitem__, windows(text)))

    def counts(self, text: str | None) -> list[int]:
        """How many windows save at least each of the gaps, and how many windows there are."""
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        if self.skips and len(words) >= WINDOW and max(map(len, words)) < RUN:
            told, n = self.worth(words), len(words) - WINDOW + STEP
        else:
            told = list(windows(text))
            n = len(told)
            if self.skips:
                told = self.worth_of(told)
        saved = list(map(self.__getitem__, told))
        return [*(sum(s >= gap for s in saved) for gap in GAPS), n]

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.log1p(counts) @ self.weights[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and weights of a slightly regularised logistic fit."""
    d = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(d.shape[1]), np.r_[1e-4, np.full(x.shape[1], 1e-3)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        w -= np.linalg.solve((d.T * (p * (1 - p))) @ d / len(y) + np.diag(ridge), d.T @ (p - y) / len(y) + ridge * w)
    return w


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The dictionary of the toxic passages of the toxic texts, and that of the ordinary texts' windows."""
    begins = _toxic_beginnings(toxic, ordinary)
    bad = [b" " + w.encode("utf-8", "surrogatepass") + b" " for t in toxic for w in _words(t) if any(g in begins for g in _beginnings(w))]
    good = {w: None for t in ordinary for w in windows(t)}  # each once: copies say nothing new
    step = max(1, len(good) // MOST_SAMPLES)
    return _train(bad, TOXIC_BYTES), _train(list(good)[::step], ORDINARY_BYTES)


def fit(toxic: list[str], ordinary: list[str], prior: float | None = None) -> ToxicModel:
    """Train on two lists of texts. ``prior`` is the share of toxic rows among all labelled ones."""
    none = (0.0,) * (2 + len(GAPS))
    model = ToxicModel(*dictionaries(toxic, ordinary), none)
    if not toxic or not ordinary:
        p = 0.999 if toxic else 0.001
        model.weights = (math.log(p / (1 - p)), *none[1:])
        return model
    x: list[list[int]] = []
    y: list[float] = []
    part = ToxicModel(*dictionaries(*([t for k, t in enumerate(texts) if k % FOLDS] for texts in (toxic, ordinary))), none)
    for label, texts in ((1.0, toxic[::FOLDS]), (0.0, ordinary[::FOLDS])):
        x += map(WindowScorer(part).counts, texts)
        y += [label] * len(texts)
    truth = np.array(y)
    weights, share = _logistic(np.log1p(np.array(x, dtype=float)), truth), truth.mean()
    if prior is not None and 0 < prior < 1:  # the sample is balanced anew
        weights[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    model.weights = tuple(weights.tolist())
    return model


def training_texts(docs: DataFrame, labels: DataFrame, where, id_col: str, text_col: str, label_col: str, limit: int = MAX_DOCS, chars: int = MAX_TRAIN_CHARS):
    """Up to ``limit`` whole texts of each class, and ``chars`` characters, among labelled rows that satisfy ``where``, first by hash; and the toxic share.

    A text that alone exceeds the bound is left out and does not count. Rows without a text or with an id that is null are ignored.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).alias("y"))
             .withColumn(id_col, F.col("lid")).where(where))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(limit).select("lid", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("did"), F.col(text_col).alias("text"))
    known_texts = texts.join(F.broadcast(chosen), texts["did"] == chosen["lid"]).where(F.col("text").isNotNull()).select("lid", "y", "text")
    # only lengths are ordered; texts that would exceed the bound are left out before anything is collected
    so_far = F.sum("n").over(W.partitionBy("y").orderBy(F.xxhash64("lid"), "lid", "crc").rowsBetween(W.unboundedPreceding, W.currentRow))
    sizes = known_texts.select("lid", "y", F.length("text").cast("long").alias("n"), F.crc32(F.col("text").cast("binary")).alias("crc")).where(F.col("n") <= chars)
    fits = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("lid", "crc").distinct()
    rows = known_texts.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(F.broadcast(fits), ["lid", "crc"]).select("lid", "y", "text").collect()
    rows.sort(key=lambda r: (r["lid"], r["text"]))
    texts = {y: [r["text"] for r in rows if r["y"] == y] for y in (0, 1)}
    total = sum(counts.values())
    return texts[1], texts[0], counts.get(1, 0) / total if total else None


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` (0..1), ``predicted`` (1 if score >= threshold) and ``toxic_windows`` for every row.

    Null and empty texts have no window and get the score of a text without toxic windows. Ties do not
    arise: rows are scored one by one, repeated ones each. Further columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = WindowScorer(model)
        for pdf in batches:
            counts = np.array([scorer.counts(t) for t in pdf["text"]], dtype=np.int64).reshape(len(pdf), 1 + len(GAPS))
            yield pd.DataFrame({"id": pdf["id"], "score": scorer.score(counts), "toxic_windows": counts[:, 0]})

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, score double, toxic_windows long")
    return out.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "toxic_windows")
