"""op12's terms: the definition's on any characters, and counted without a Python step a word."""

import re
import time
from collections import Counter

import pyarrow as pa

from chronofold.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SHIFT = {c: c + 32 for c in range(0x41, 0x5B)}


def _plain(rows):
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        here = {"": 1}
        for term in TERM.findall(text.translate(SHIFT) if not text.isascii() else text.lower()):
            here[term] = here.get(term, 0) + 1
        for term, k in here.items():
            n[lang, source, term] += k
            docs[lang, source, term] += 1
    return {key: (k, docs[key]) for key, k in n.items()}


def _counted(rows, most=divergence.HELD):
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence.counted(iter([batch]), most):
        for lang, source, term, k, d in zip(*(c.to_pylist() for c in out.columns)):
            n[lang, source, term] += k
            docs[lang, source, term] += d
    return {key: (k, docs[key]) for key, k in n.items()}


def test_terms_are_the_definition_s():
    every = "".join(map(chr, range(0x250))) + "İẞ 　 \U0001d400A﻿Z"
    rows = [("en", "a", every), ("", "", ""), ("en", "a", "It's THE the-TheÉé \x00x\x1fy\x85z"), ("en", "b", "the"), ("de", "a", " \t\n1 2_3")]
    want = _plain(rows)
    assert _counted(rows) == want
    assert _counted(rows, 3) == want


def test_words_cost_no_python_step():
    rows = [("en", str(k % 3), " ".join(f"w{chr(97 + (k * j) % 26)}{chr(97 + j % 26)}x{chr(97 + (k + j * j) % 26)}" for j in range(2000))) for k in range(200)]
    cost = []
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=["lang", "source", "text"])
    for count in (lambda: _plain(rows), lambda: list(divergence.counted(iter([batch]), divergence.HELD))):
        at = []
        for _ in range(5):
            t = time.process_time()
            count()
            at.append(time.process_time() - t)
        cost.append(min(at))
    assert cost[1] < 0.7 * cost[0]
