"""Brute force of whole results, and inputs that once broke an operator or could."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

pytest.importorskip("chronofold.llm")
from chronofold.llm import common, components, embed_dedup, hamming_search, kd_shard, language_id, mixing, packing, pii, pipeline, site_style, toxicity  # noqa: E402

WORDS = "amber birch cedar delta ember fjord grove heath islet jetty knoll lagoon marsh north ocean pine quarry river stone tide".split()


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Unset:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Unset(), Context

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_components_with_a_hot_end(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_LEAST", 3)
    monkeypatch.setattr(components, "HOT_SHARE", 2)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(50)] + [(7, 7), (None, 3), (39, 0)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 151)}}


def test_vectors_under_one_id_and_huge_ones_link(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(16)
    near = (a + 1e-3 * rng.standard_normal(16)).tolist()
    vecs = [(1, a.tolist()), (1, near), (5, (1e200 * a).tolist()), (6, (-0.0 * a).tolist()), (7, [0.0, -0.0, 1.0]), (8, [-0.0, 0.0, 1.0]), (9, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(vecs, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    got = sorted(tuple(r)[:3] for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (5, 2, 1), (6, 0, 6), (7, 2, 7), (8, 2, 7), (9, 2, 7)]


def test_embedding_recall_on_near_copies(spark, monkeypatch):
    """All links of clusters at the threshold, with chunks cut so that they meet in pairs; floor 0.9, none below the threshold."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((80, 64))
    m = np.concatenate([base[k] + rng.uniform(0.2, 0.5) * rng.standard_normal((12, 64)) for k in range(80)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    f = m.astype(np.float32).astype(np.float64)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    want = ((f @ f.T >= 0.9) & ~np.eye(len(f), dtype=bool)).sum(axis=1)
    for chunk in (4000, 40):
        monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
        got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
        assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() > 1000


def test_language_prediction_by_brute_force():
    rng = np.random.default_rng(6)
    texts = {"a": [" ".join(rng.choice(WORDS[:12], 30)) for _ in range(5)], "b": [" ".join(rng.choice(WORDS[8:], 30)) for _ in range(5)]}
    grams = {k: set(language_id.gram_hashes(" ".join(v)).tolist()) for k, v in texts.items()}
    masks = language_id.LanguageMasks.build({k: np.array(sorted(v), dtype=np.uint64) for k, v in grams.items()}, "a")
    for t in [x for v in texts.values() for x in v] + ["quarry river", "amber", "zz9 plural", "12 é"]:
        h = language_id.gram_hashes(t).tolist()
        exact = {k: sum(g in s for g in h) for k, s in grams.items()}
        lang, score = masks.decide(t)
        best = max(exact.values())
        assert (lang == "a" and score == 0.0) if best == 0 else lang == min(k for k in exact if exact[k] == best)
        assert best == 0 or math.isclose(score, best / sum(sorted(exact.values())[-2:]), abs_tol=0.05)


@pytest.mark.parametrize("stretch", [16, 50, 1000])
def test_stretches_leave_the_ngrams_alone(monkeypatch, stretch):
    rng = np.random.default_rng(7)
    text = " ".join("".join(rng.choice(list("abcdé1 ."), rng.integers(1, 30))) for _ in range(300)) + "x" * 300 + " end"
    whole = np.sort(language_id.gram_hashes(text))
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    assert np.array_equal(whole, np.sort(language_id.gram_hashes(text)))


def test_pipeline_keeps_a_corpus_without_languages(spark):
    docs = _docs(spark, [(1, "some words here", None, "s", 1), (2, "other words", None, "s", 1), (3, "12 34", None, None, 1), (4, None, None, None, None)])
    assert sorted(r.doc_id for r in pipeline.keep_known_languages(spark, docs, "").collect()) == [1, 2]


def test_stages_with_clashing_columns_and_long_texts(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(WORDS, 40 if i else 40000)), "en", f"s{i % 2}", 1) for i in range(12)]
    rows += [(3, rows[4][1], "en", "s0", 1), (3, rows[4][1], "en", "s0", 1), (None, rows[5][1], None, None, None)]
    docs = _docs(spark, rows)
    wide = docs
    for c in ("k", "copies", "_id", "_copies", "k1", "part", "size", "u", "lang_pred", "score", "row", "_n", "_text", "_body"):
        wide = wide.withColumn(c, F.lit("x"))
    for _, stage in pipeline.STAGES:
        plain, odd = (sorted(map(tuple, stage(spark, d, "").collect()), key=str) for d in (docs, wide))
        assert plain == odd and len(plain) > 0


def test_odd_numbers_are_no_addresses():
    assert pii.base_spans("0" * 5000 + ".0.0.1") == [(0, "ip", 5006)] and pii.base_spans("9" * 5000 + ".0.0.1")[:1] == []
    assert pii.base_spans("256.1.1.1") == []


def test_cards_and_phones_equal_their_patterns():
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: [int(c) for c in s if c.isascii() and c.isdigit()]

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(reversed(d))) % 10 == 0

    rng, seen = np.random.default_rng(10), 0
    for _ in range(6000):
        t = "".join(rng.choice(list("0123456789- +(.)x"), rng.integers(10, 45), p=[0.08] * 10 + [0.05, 0.05, 0.04, 0.01, 0.01, 0.02, 0.02]))
        spans = pii.base_spans(t)
        cards = [m.span() for m in card.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        assert [(a, b) for a, k, b in spans if k == "card"] == cards
        assert [(a, b) for a, k, b in spans if k == "phone"] == [m.span() for m in phone.finditer(t) if 10 <= len(digits(m[0])) <= 15]
        seen += len(cards)
    assert seen > 50


def test_added_spans_touch_no_other():
    rng = np.random.default_rng(12)
    for _ in range(2000):
        t = "".join(rng.choice(list("0123456789-+ ().=\"ab@.at[]"), rng.integers(20, 90)))
        base = pii.base_spans(t)
        extra = pii.extra_candidates(t, base)
        for n, (a, _, b) in enumerate(extra):
            assert all(b <= c or d <= a for c, _, d in base + extra[:n] + extra[n + 1 :])


def test_classifier_reads_the_text(spark):
    rng = np.random.default_rng(13)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 32))
    rows = [(i, f"set token={key()} and go" if i % 2 else f"order {rng.integers(10**9, 10**10)} was sent") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(("secret:" in got[i]) == bool(i % 2) for i, _ in rows) and not any("number:" in s for s in got.values())


PAGES = [
    ("http://a.example/%d", "<body><div class='top'>Daily Post est. 1900</div><div class=story><h1>{t}</h1><p>{p}</p></div><div class='legal'>Imprint and terms</div></body>", "{t}\n\n{p}"),
    ("http://b.example/%d", "<body><nav>Home</nav><main><section class=social>{p}</section><div class='ad'>Buy {t}</div><div class='comments'><p>first! {t}</p></div><div class=note>Same note on all</div><p>end {t}</p></main><footer>f</footer></body>", "{p}\n\nend {t}"),
    ("http://c.example/%d", "<body><header>Logo</header><p class=lead>{t} lead</p><article><header><h1>{t}</h1></header><p>{p}</p></article><div class=more>Read more here</div></body>", "{t} lead\n\n{t}\n\n{p}"),
]


def test_hosts_block_by_block(spark):
    """Hosts of two to twelve pages, one of them copied many times: what repeats goes, what varies stays."""
    rng = np.random.default_rng(15)
    rows, want = [], {}
    for n in (2, 3, 12):
        for k, (url, html, text) in enumerate(PAGES):
            for i in range(n):
                fill = {"t": f"title {n} {k} {i}", "p": " ".join(rng.choice(WORDS, 12))}
                pid = len(rows)
                rows.append((pid, url.replace("//", f"//n{n}.") % i, html.format(**fill)))
                want[pid] = text.format(**fill)
    for j in range(30):  # copies of one page
        rows.append((1000 + j, rows[0][1], rows[0][2]))
        want[1000 + j] = want[0]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1))
    got = {r.page_id: r.text for r in site_style.extract(df).collect()}
    assert {i for i in want if got[i] != want[i]} == set()
    site_bound, site_style.BROADCAST_NODES = site_style.BROADCAST_NODES, 0
    try:
        assert {r.page_id: r.text for r in site_style.extract(df).collect()} == got
    finally:
        site_style.BROADCAST_NODES = site_bound


def test_deep_and_long_pages(spark):
    deep = "<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "</article>"
    df = spark.createDataFrame([(1, "http://x.example/", deep), (2, "http://x.example/2", "<p>" + "long " * 200000), (2, "http://x.example/2", "<p>x"), (2, "http://x.example/2", "<p>x")], "page_id long, url string, html string")
    got = [r.text for r in site_style.extract(df).collect()]
    assert sorted(map(len, got)) == [1, 1, 4, 999999]


def test_bm25_equals_brute_force():
    rng = np.random.default_rng(16)
    docs = [rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint16) for _ in range(60)]
    shard = packing.Shard(docs)
    mean = np.mean([len(d) for d in docs])
    for seed in range(60):
        want = np.zeros(60)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            for k, d in enumerate(docs):
                tf = int((d == t).sum())
                if df > 1 and tf:
                    want[k] += math.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        got = shard.scores(seed)
        assert np.allclose(got, want)
        used = rng.random(60) < 0.3
        order = [k for k in np.argsort(-got, kind="stable") if got[k] > 0 and not used[k]]
        assert shard.neighbours(got, used, 5).tolist() == order[:5]


def test_packing_ranges_hold_equally_many_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_PER_TASK", 20_000)
    rng = np.random.default_rng(17)
    hot = " ".join(rng.choice(WORDS, 50))
    docs = spark.createDataFrame([(i, hot if i % 3 == 0 else " ".join(rng.choice(WORDS, 50))) for i in range(3000)], "doc_id long, text string")
    sizes = packing.pack(docs).groupBy(F.shiftright("sequence_id", 32).alias("task")).agg(F.sum("length").alias("n")).collect()
    assert len(sizes) > 8 and max(r.n for r in sizes) < 45_000


def test_hamming_blocks_stream_their_queries(spark, monkeypatch):
    monkeypatch.setattr(hamming_search, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(18)
    codes = rng.integers(-(1 << 62), 1 << 62, 600)
    codes[50:90] = codes[0]
    df = spark.createDataFrame([(i, int(c), "x") for i, c in enumerate(codes)] + [(7, int(codes[7]), "y")], "id long, code long, ids string")
    got = {}
    for r in hamming_search.top_k(df, df.where("id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q in range(0, 600, 10):
        far = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int)
        assert [x[1:] for x in sorted(got[q])] == sorted((int(far[i]), i) for i in range(600) if i != q)[:5]


def test_sign_codes_of_odd_parts(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, nan, -1.0, None, 2.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(hamming_search.sign_code("v")).collect()] == [0b10001, 0, None]


def test_a_row_repeated_very_often_is_spread(spark, monkeypatch):
    monkeypatch.setattr(kd_shard, "RUN", 500)
    docs = _docs(spark, [(1, "the same row", "en", "s", 12)] * 4000 + [(i, "a b c", "en", "t", 5) for i in range(2000)])
    got = kd_shard.shard(docs, 8).collect()
    size = {s: sum(r.size for r in got if r.shard == s) for s in range(8)}
    assert len(got) == 6000 and max(size.values()) < 1.05 * min(size.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_mixing_draws_unequal_odds(spark):
    docs = _docs(spark, [(i, " ".join(["w"] * (4 if i % 2 else 100)), "en", f"s{i // 2 % 4}", 1) for i in range(4000)] + [(9000, None, None, None, None), (9001, "", "en", "s0", 0)])
    rows = mixing.mix(docs).collect()
    share = {n: np.mean([r.copies for r in rows if r.size == n]) for n in (4, 100)}
    assert share[100] > 2 * share[4] > 0
    for source in range(4):
        own = [r for r in rows if r.size and r.doc_id // 2 % 4 == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50


def test_one_long_text_does_not_end_the_training(spark):
    docs = spark.createDataFrame([(i, "x" * 5000 if i == 0 else f"short text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(20)], "doc_id long, toxic int")
    for first in range(10):  # whichever comes first by hash
        swapped = docs.withColumn("text", F.when(F.col("doc_id") == first, F.lit("x" * 5000)).otherwise(F.concat(F.lit("short text "), "doc_id")))
        toxic, ordinary, prior = toxicity.training_texts(swapped, labels, F.lit(True), "doc_id", "text", "toxic", chars=1000)
        assert len(toxic) == 9 and len(ordinary) == 10 and prior == 0.5


def test_toxic_windows_cover_the_text_and_savings_are_lengths(spark):
    model = toxicity.ToxicModel(b" grunkle blorpish ", b"amber birch cedar", (0.0,) * 6)
    scorer = toxicity.WindowScorer(model)
    ordinary, toxic = model.compressors()
    for text in ("amber grunkle cedar blorpish", "x" * 500 + "grunkle" * 30, "", "one", None, " \n "):
        lead = toxicity.LEAD
        assert scorer.savings(text) == [len(ordinary.compress(lead + w + lead)) - len(toxic.compress(lead + w + lead)) for w in toxicity.windows(text)]
        assert set((text or "").split()) <= set(b" ".join(toxicity.windows(text)).decode().split()) or len(text) > 100
    assert scorer.counts("amber grunkle cedar")[0] == 2 and scorer.counts("amber birch cedar") == [0, 0, 0, 0, 2]
    assert scorer.counts("grunkleblorpish" * 40)[0] > 10  # a run without spaces counts too


def test_toxicity_of_odd_rows(spark):
    model = toxicity.ToxicModel(b" grunkle ", b"amber", (-1.0, 2.0, 2.0, 1.0, 1.0, -0.5))
    df = spark.createDataFrame([(1, "amber " * 30000 + "grunkle", "x"), (1, "grunkle grunkle", "x"), (1, "grunkle grunkle", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, score string")
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 5 and sum(r.predicted for r in rows) >= 2 and toxicity.score(df.where("false"), model).count() == 0
