"""BPE by prefixes, source divergence and periodic runs: against the library, the definition and brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("chronofold.llm")
from chronofold.llm import bpe, divergence, periodic  # noqa: E402

ODD = [None, "", " ", "\n\n \t", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "it's we'll 'tis 'S", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|endoftext", "naïve Straße  Ωmega 東京 🙂🙂 é",
       "\x00\x1c\x85\xa0 　​", "࢏\U0001e5ea1Ᲊ", "½²3 ٣٤", "ab" * 40000, "é" * 3000, " " * 5000 + "x", "0" * 999, "....!!!!\r\n\r\n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def _ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_bpe_equals_the_library_on_odd_texts_and_tables(spark, library):
    rng = random.Random(5)
    made = ["".join(chr(rng.randrange(0x20, 0x250)) for _ in range(80)) for _ in range(40)] + ["".join(rng.choice("aeinrst  '\n") for _ in range(200)) for _ in range(60)]
    rows = list(enumerate(ODD + made)) + [(3, ODD[3]), (None, "null id"), (None, None)]
    df = spark.createDataFrame([(i, t, "c", "d", b"e") for i, t in rows], "doc_id long, text string, ids string, id string, decoded binary").repartition(3)
    coded = bpe.encode(df)
    assert coded.columns == ["doc_id", "ids"]
    got = Counter((r.doc_id, bytes(r.ids)) for r in coded.collect())
    assert got == Counter((i, _ids(library, t)) for i, t in rows)
    back = Counter((r.doc_id, r.text) for r in bpe.decode(coded).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    digests = Counter(tuple(r) for r in bpe.round_trip(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert digests == Counter((i, len(_ids(library, t)) // 4, hashlib.sha256(_ids(library, t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert bpe.round_trip(df.where("false")).count() == 0


def test_bpe_decodes_what_is_no_text(spark, library):
    lists = [[], [50256], [200, 201, 202], [222, 17, 300, 50256, 171], list(range(150, 260))]
    df = spark.createDataFrame([(k, np.array(x, dtype="<u4").tobytes()) for k, x in enumerate(lists)] + [(9, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode(df).collect()}
    assert got == {k: library.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)} | {9: None}


def test_bpe_pairs_stay_apart_as_the_library_has_them(library):
    own = bpe.Tokenizer(bpe.default_tokenizer())
    rng = random.Random(6)
    tokens = [t for t in own.vocabulary.born if own.vocabulary.bytes_of[t].isalpha()]
    near = rng.sample(tokens, 300)
    for a, b in zip(near, rng.sample(tokens, 300)):
        text = (own.vocabulary.bytes_of[a] + own.vocabulary.bytes_of[b]).decode("ascii", "ignore")
        if len(text) == own.vocabulary.size_of[a] + own.vocabulary.size_of[b]:
            assert own.vocabulary.stays(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_bpe_memory_of_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    own = bpe.Tokenizer(bpe.default_tokenizer())
    texts = [t for t in ODD if t] * 2
    assert list(own.encode(texts)) == [_ids(library, t) for t in texts]
    assert len(own.pieces) <= 7


def _audit_by_definition(rows):
    docs = defaultdict(list)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang or ""].append((source or "", terms))
    out = []
    for lang, own in docs.items():
        seen = Counter(t for _, terms in own for t in set(terms))
        kept = sorted((t for t, n in seen.items() if n >= 30), key=str.encode)
        counts = {s: Counter() for s, _ in own}
        for s, terms in own:
            counts[s].update(t for t in terms if seen[t] >= 30)
        total = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(total, t) for t in kept}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms)]
    return Counter(out)


@pytest.mark.parametrize("groups, terms, heavy", [(64, 512, 4), (3, 8, 4), (5, 16, 1), (4, 8, 1000)])
def test_divergence_equals_the_definition(spark, monkeypatch, groups, terms, heavy):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "HEAVY", heavy)
    rng = random.Random(7)
    rows = []
    for k in range(1500):
        source = f"s{rng.randrange(17)}" if rng.random() < 0.7 else "s0"
        common = [f"w{chr(97 + rng.randrange(12))}" for _ in range(rng.randrange(8))]
        local = [f"{source}x{rng.randrange(2)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(3)]
        rows.append((rng.choice(["en", "en", "de"]), source, " ".join(common + local + ["Éa", "éa", "UP", "up-per", "東"][: rng.randrange(6)])))
    rows += [("en", "bare", ""), ("en", "bare", None), ("en", None, "wa wb"), (None, "s1", "few words"), (None, None, None), ("xx", "only", "wa"), ("en", "s1", "wa " * 20000)]
    rows += [("en", "s2", "wa wc wd")] * 40
    df = spark.createDataFrame([(k, t, lang, s, 1, "x", 2) for k, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, p long, term string, n long").repartition(4)
    got = Counter(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _audit_by_definition(rows)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(df).count() == 0


def test_divergence_hands_on_counts_in_between(spark, monkeypatch):
    df = spark.createDataFrame([("en", f"s{k % 3}", f"alpha beta {chr(97 + k % 20)}z") for k in range(300)], "lang string, source string, text string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD", 5)
    got = {(r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(df, "lang", "source", "text").collect()}
    assert got[("s0", "alpha")] == (100, 100) and got[("s1", "")] == (100, 100) and sum(n for (_, t), (n, _) in got.items() if t.endswith("z")) == 300


def _runs_by_definition(words):
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(24, 3 * p):
                part = words[i : i + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repetitive(rng, size):
    a = []
    while len(a) < size:
        block = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(1, 30))]
        a += block * rng.randrange(1, 12) + block[: rng.randrange(len(block) + 1)] + [rng.randrange(4) for _ in range(rng.randrange(4))]
    return a


@pytest.mark.parametrize("grid", [1 << 17, 64])
def test_runs_equal_the_definition(monkeypatch, grid):
    monkeypatch.setattr(periodic, "GRID", grid)
    monkeypatch.setattr(periodic, "CHUNK", 4)
    rng, total = random.Random(8), 0
    for _ in range(400):
        a = _repetitive(rng, rng.randrange(1, 250))
        runs = _runs_by_definition(a)
        assert periodic.runs_of(np.array(a, dtype=np.int32)) == runs
        total += len(runs)
        stays = [not any(s + q <= k < s + n for s, n, q in runs) for k in range(len(a))]
        assert periodic.kept_words(len(a), runs).tolist() == stays
    assert total > 500


def test_runs_of_documents_and_their_digests(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "one", "ha " * 24, "ha " * 23, "a b c d e f g h " * 3, "a b c d e f g h " * 3 + "a", "x y x y " * 12, "ab " * 60000]
    texts += [" ".join(f"w{x}" for x in _repetitive(rng, rng.randrange(20, 300))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "la " * 30), (-7, "la " * 30)]
    df = spark.createDataFrame([(i, t, "z", 4, 5) for i, t in rows], "doc_id long, text string, id string, start long, n_runs long").repartition(3)

    def expected(i, t, plant):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        if plant and i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = _runs_by_definition(words) if len(words) < 5000 else [(0, len(words), 1)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        left = " ".join(w for k, w in enumerate(words) if k not in drop)
        return (i, len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], "".join(f"{s},{n},{q}\n" for s, n, q in runs), left)

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fields = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    got = Counter(tuple(r) for r in periodic.collapse(df).select(*fields, "runs", "text").collect())
    assert got == Counter(expected(i, t, False) for i, t in rows)
    got = Counter(tuple(r) for r in periodic.digests(df, plant=True).select(*fields, "runs_sha256", "collapsed_sha256").collect())
    assert got == Counter((*e[:6], sha(e[6]), sha(e[7])) for e in (expected(i, t, True) for i, t in rows))
    assert periodic.collapse(df.where("false")).count() == 0
