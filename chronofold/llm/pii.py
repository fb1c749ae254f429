"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each (1 personal, -1 not, 0 no opinion): formats and
checksums, gazetteers of prefixes and domains, and the words in front of the span. Expectation-maximisation
over the counts of vote patterns, gathered from the whole corpus, estimates how reliable each labeler is
and how likely each candidate is personal. These soft labels train a logistic span classifier that reads the
text: the span's shape, length and beginning, the words in front and the character behind. Spans of the four
base kinds always stay; the classifier decides about all other candidates.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "masked_email", "local_phone", "number")
KINDS = BASE + EXTRA
ORDER = {k: i for i, k in enumerate(KINDS)}
THRESHOLD = 0.5
#: Characters in front of a span that context labelers read.
CONTEXT = 24
LABELERS = ("format", "checksum", "gazetteer", "context", "shape")
#: Hashed features of the span classifier, and candidates that it is trained on, at most: the first by hash.
FEATURES, TRAIN_SPANS = 4096, 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<==)[0-9a-f]{16,}(?![0-9A-Za-z])|(?<=")[0-9a-f]{32,}(?="))""")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{2,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]+(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{2,4}\)\s?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_RUNS = re.compile(r"(.)\1+", re.S)
_SHAPE = {**{ord(c): "9" for c in "0123456789"}, **{ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
_CUE = re.compile(r"(?:password|passwd|pwd|token|secret|key|e-?mail|mail|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|ip|address|contact)\W*\Z", re.I)
_NOT_CUE = re.compile(r"(?:version|isbn|page|pages|chapter|figure|year|total|no\.|number|id|rev)\W*\Z", re.I)
#: First digits of card issuers, mail hosts' common endings and key prefixes.
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "2221", "2720")
_ENDINGS = (".com", ".org", ".net", ".edu", ".de", ".fr", ".es", ".uk", ".io")
_KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "xoxb-", "sk_live_")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a match starts where the run of local characters before its '@' starts, but not inside the match before
    end = 0
    if "@" not in text:
        return
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base kinds, by start, then kind; leftmost and non-overlapping per kind."""
    text = text or ""
    out = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


def extra_candidates(text: str | None, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans of other kinds that touch no base span and none of each other; first kind first."""
    text = text or ""
    out: list[tuple[int, str, int]] = []
    taken: list[tuple[int, int]] = []  # sorted and disjoint
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    found = [(m.start(), "secret", m.end()) for m in _SECRET.finditer(text)] if ("AKIA" in text or "=" in text or '"' in text) else []
    if "at" in text and ("[" in text or "(" in text):
        found += [(m.start(), "masked_email", m.end()) for m in _MASKED.finditer(text)]
    found += [(m.start(), "local_phone", m.end()) for m in _LOCAL_PHONE.finditer(text)]
    found += [(m.start(), "number", m.end()) for m in _CARD.finditer(text) if 9 <= len(_digits(m[0])) <= 19]
    for a, kind, b in found:
        k = bisect.bisect_left(taken, (b, -1))  # of disjoint intervals only the one before can reach into this
        if k == 0 or taken[k - 1][1] <= a:
            taken.insert(k, (a, b))
            out.append((a, kind, b))
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


def votes(text: str, start: int, kind: str, end: int) -> tuple[int, ...]:
    """The labelers' votes on one span, in the order of ``LABELERS``."""
    span, front = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _digits(span)
    fmt = -1 if kind == "number" else 1
    if kind == "card":
        checksum = 1
    elif kind == "number" and len(digits) >= 12:
        checksum = 1 if luhn(digits) else -1
    elif kind in ("phone", "local_phone"):
        checksum = 1 if 10 <= len(digits) <= 15 else -1
    else:
        checksum = 0
    if kind in ("email", "masked_email"):
        gaz = 1 if span.lower().endswith(_ENDINGS) else 0
    elif kind == "card":
        gaz = 1 if digits.startswith(_ISSUERS) else -1
    elif kind == "secret":
        gaz = 1 if span.startswith(_KEY_PREFIXES) else 0
    elif kind == "ip":
        gaz = -1 if span.startswith(("0.", "127.", "255.")) else 1
    elif kind == "number":
        gaz = 1 if len(digits) >= 14 and digits.startswith(_ISSUERS) else -1
    else:
        gaz = 0
    context = 1 if _CUE.search(front) else -1 if _NOT_CUE.search(front) else 0
    if kind == "secret":
        letters = sum(c.isalpha() for c in span)
        shape = 1 if len(set(span)) >= 8 and 0 < letters < len(span) else -1
    else:
        shape = -1 if len(set(digits)) <= 2 and len(digits) >= 6 else 1 if kind in BASE else 0
    return fmt, checksum, gaz, context, shape


def _key(kind: str, v: tuple[int, ...]) -> str:
    return kind + ":" + "".join("-0+"[x + 1] for x in v)


def span_features(text: str, start: int, kind: str, end: int) -> list[int]:
    """What the classifier reads of a span and the text around it, as hashed feature numbers."""
    span, front = text[start:end], text[max(0, start - CONTEXT) : start]
    shape = _RUNS.sub(r"\1", span[:64].translate(_SHAPE))
    near = front.lower().split()[-2:]
    marks = [kind, f"{kind}|{shape}", f"{kind}|n{min(len(span), 40)}", f"{kind}|d{len(_digits(span))}", f"{kind}|{span[:2].lower()}", f"{kind}|>{text[end : end + 1]}", f"<{front[-1:]}",
             *(f"w{k}|{w.strip('.,;:()')}" for k, w in enumerate(reversed(near)))]
    return [zlib.crc32(m.encode("utf-8", "surrogatepass")) % FEATURES for m in marks]


def estimate(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """EM over vote patterns: P(personal) of each pattern, and P(vote | class) as [labeler, class, vote + 1].

    Each labeler is assumed to be better than chance at the start; classes are votes' common cause.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = np.array([["-0+".index(c) for c in k.split(":")[1]] for k in keys], dtype=int).reshape(len(keys), len(LABELERS))
    q = 1 / (1 + np.exp(-1.5 * (v - 1).sum(axis=1)))
    rates = np.full((len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds if len(keys) else 0):
        prior = (q @ n + 1) / (n.sum() + 2)
        for j in range(len(LABELERS)):
            for c, w in ((1, q * n), (0, (1 - q) * n)):
                rates[j, c] = (np.bincount(v[:, j], weights=w, minlength=3) + 1) / (w.sum() + 3)
        log1, log0 = np.log(prior), np.log(1 - prior)
        a = log1 + sum(np.log(rates[j, 1, v[:, j]]) for j in range(len(LABELERS)))
        b = log0 + sum(np.log(rates[j, 0, v[:, j]]) for j in range(len(LABELERS)))
        q = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
    return dict(zip(keys, q.tolist())), rates


def train(spans: list[tuple[list[int], float]], rounds: int = 300) -> np.ndarray:
    """Weights of the logistic span classifier (the last is the intercept), fitted on feature lists and soft labels."""
    w = np.zeros(FEATURES + 1)
    if not spans:
        return w
    sizes = np.array([len(f) for f, _ in spans])
    flat, row = np.array([i for f, _ in spans for i in f]), np.repeat(np.arange(len(spans)), sizes)
    y, step = np.array([q for _, q in spans]), np.ones(FEATURES + 1) * 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(row, w[flat], len(spans)), -30, 30)))
        g = np.r_[np.bincount(flat, (p - y)[row], FEATURES), (p - y).sum()] / len(spans) + 1e-6 * w
        step += g * g
        w -= 0.5 * g / np.sqrt(step)
    return w


def personal(weights: np.ndarray, features: list[int]) -> bool:
    return bool(1 / (1 + np.exp(-np.clip(weights[-1] + weights[features].sum(), -30, 30))) >= THRESHOLD)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans, other candidates and all vote patterns of every text, written to the shared folder."""
    small_batches(df.sparkSession)

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                base = base_spans(t)
                extra = extra_candidates(t, base)
                n = [sum(k == kind for _, k, _ in base) for kind in BASE]
                joined = [f"{k}:{a}:{b}" for a, k, b in base]
                spans = [(_key(k, votes(t, a, k, b)), span_features(t, a, k, b)) for a, k, b in base + extra]
                rows.append((*n, hashlib.sha256(",".join(joined).encode()).hexdigest(), joined, [f"{k}:{a}:{b}" for a, k, b in extra], [key for key, _ in spans], [f for _, f in spans]))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "base", "extra", "keys", "features"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    fields = "id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, base array<string>, extra array<string>, keys array<string>, features array<array<int>>"
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(propose, fields)
    return materialise(docs, "pii-candidates")


def fit(found: DataFrame) -> np.ndarray:
    """The span classifier: soft labels by EM over the vote patterns of all candidates, trained on ``TRAIN_SPANS`` of them."""
    # at most 3 ** labelers patterns for each kind
    patterns = {r["key"]: r["n"] for r in found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).collect()}
    soft, _ = estimate(patterns)
    total = sum(patterns.values())
    if not total:
        return train([])
    spans = found.select("id", "base_sha256", F.posexplode(F.arrays_zip("keys", "features")).alias("place", "span"))
    mark = F.xxhash64("id", "base_sha256", "place", F.lit(11))
    some = spans.where(F.pmod(mark, F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * 1.2 * TRAIN_SPANS / total) + 1)))
    rows = some.select(mark.alias("h"), "span.keys", "span.features").orderBy("h", "keys").limit(TRAIN_SPANS).collect()
    return train([(list(r["features"]), soft[r["keys"]]) for r in rows])


def spans_of(text: str | None, weights: np.ndarray) -> str:
    """All spans of one text: the base ones and the candidates that the classifier accepts."""
    base = base_spans(text)
    more = [(a, k, b) for a, k, b in extra_candidates(text, base) if personal(weights, span_features(text, a, k, b))]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base + more, key=lambda s: (s[0], ORDER[s[1]])))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every text.

    Returns one row per input row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans),
    ``base_sha256`` (of the base spans as kind:start:end, comma-joined), ``spans`` (base and added ones,
    joined likewise). Positions are code points, end exclusive. A null text is empty; texts without spans
    have the digest of the empty string. Repeated rows are read each; an empty table gives an empty result.
    Spans that start together are ordered by kind.
    """
    docs = candidates(df, id_col, text_col)
    weights = fit(docs)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = []
            for base, extra, features in zip(pdf["base"], pdf["extra"], pdf["features"]):
                take = list(base) + [s for s, f in zip(extra, list(features)[len(base) :]) if personal(weights, list(f))]
                take.sort(key=lambda s: (int(s.split(":")[1]), ORDER[s.split(":")[0]]))
                spans.append(",".join(take))
            out = pdf.drop(columns=["base", "extra", "keys", "features"])
            out["spans"] = spans
            yield out

    fields = "id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.mapInPandas(decide, fields).withColumnRenamed("id", id_col)


def redact(text: str | None, spans: str | None) -> str | None:
    """The text with every span replaced by its kind in square brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans.split(","):
        kind, a, b = s.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]
