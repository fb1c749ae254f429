"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

pytest.importorskip("chronofold.llm")
from chronofold.llm import embed_dedup, hamming_search, kd_shard, language_id, mixing, packing, pii, simhash, site_style, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = "amber birch cedar delta ember fjord grove heath islet jetty knoll lagoon marsh north ocean pine quarry river stone tide".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeated rows, one long text, copies and a column that clashes with internal names."""
    rng = np.random.default_rng(0)
    base = [_text(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0", 1, "x") for i in range(30)] + [(200, None, None, None, None, None), (201, "", "en", None, 0, ""), (202, " \n\t ", None, "s1", 4, "y")]
    rows += [(203, "12 34", "en", "s1", 5, "y"), (203, "12 34", "en", "s1", 5, "y"), (None, "lone words here", "en", "s2", 3, "z"), (204, _text(rng, 30000), "en", "s2", 9, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3)


def _empty(docs):
    return docs.where("false")


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 64))
    near = base[:60] + 0.12 * rng.standard_normal((60, 64))
    vecs = [v.tolist() for v in np.r_[base, near, base[:5], 3 * base[5:8]]] + [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vecs)), T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    m = np.array(vecs[:368])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    assert len(got) == len(vecs) and link.sum() > 100
    assert all(got[i].n_links == link[i].sum() for i in range(len(m)))
    comp = np.arange(len(m))
    for _ in range(20):
        comp = np.array([min(comp[i], *(comp[link[i]])) if link[i].any() else comp[i] for i in range(len(m))])
    assert all(got[i].component_id == comp[i] and got[i].kept == (comp[i] == i) for i in range(len(m)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(368, 374))
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_simhash_equals_definition_and_brute_force(spark, docs):
    import xxhash

    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not words:
            return 0
        sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.where("doc_id <> 204 or doc_id is null").collect()
    assert all(simhash.fingerprint(r.text) == plain(r.text) for r in rows)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(real).collect()
    fp = np.array([int(r.fingerprint, 16) for r in got], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    comp = np.array([r.doc_id for r in got])
    for _ in range(12):
        comp = np.array([comp[near[i]].min() for i in range(len(comp))])
    assert [r.component_id for r in got] == comp.tolist()
    odd = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert odd[(200, "0" * 16)] == odd[(201, "0" * 16)] == odd[(202, "0" * 16)] == 200
    assert simhash.near_duplicates(_empty(docs)).count() == 0 and simhash.similar_groups(_empty(docs)).count() == 0


def test_simhash_blocks_with_deep_trees():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 16, 3000, dtype=np.uint16)
    tree = simhash.VantageTree(x[:800], 5, 16, 1)
    row, leaf, home = tree.route(x, 1)
    own = dict(zip(row[home], leaf[home]))
    visits = set(zip(row.tolist(), leaf.tolist()))
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 1, 1))
    assert all((i, own[j]) in visits or (j, own[i]) in visits for i, j in zip(a.tolist(), b.tolist()))
    old, simhash.DIRECT = simhash.DIRECT, 1 << 12
    try:
        got = {tuple(sorted(p)) for u, v in simhash._pairs(x[:2000], x[2000:], 1) for p in zip(u.tolist(), v.tolist())}
    finally:
        simhash.DIRECT = old
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < 2000}


def test_hamming_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(-(1 << 62), 1 << 62, 400)
    codes[100:200] = codes[0]
    codes[200:240] = codes[1] ^ (1 << rng.integers(0, 60, 40))
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)] + [(None, 5), (999, None)], "id long, code long")
    got = hamming_search.top_k(df, df.where("id % 50 = 0"), 7).collect()
    for q in range(0, 400, 50):
        far = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int)
        want = sorted((int(far[i]), i) for i in range(400) if i != q)[:7]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert hamming_search.top_k(df.where("false"), df, 3).count() == 0


def test_kd_shards(spark, docs):
    got = kd_shard.shard(docs, 8).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    size = {r.doc_id: r for r in got}
    assert size[200].size == 16 and size[200].text_crc32 == 0 and size[203].text_crc32 == zlib.crc32(b"12 34")
    real = kd_shard.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(real) == 8 and max(r.b for r in real) < 1.15 * min(r.b for r in real)
    assert kd_shard.shard(_empty(docs), 8).count() == 0


def test_pii_base_spans_and_redaction(spark, docs):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(2)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab1@@..-_ +9é25"), rng.integers(0, 30)))
        spans = pii.base_spans(t)
        assert [(a, b) for a, k, b in spans if k == "email"] == [m.span() for m in email.finditer(t)]
        assert [(a, b) for a, k, b in spans if k == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    text = "call +1 (383) 555-6083 or a.b@mail.example.com from 10.2.3.4, card 4111 1111 1111 1111, password=0a1b2c3d4e5f6a7b8c"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert (got[1].n_phone, got[1].n_email, got[1].n_ip, got[1].n_card) == (1, 1, 1, 1)
    assert got[2].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "secret:" in got[1].spans and pii.redact(text, got[1].spans).count("[") == 5
    assert pii.find(docs).count() == docs.count() and pii.find(_empty(docs)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="sidebar">side</div><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four\n five</p><aside>no</aside><div id="comments">rude</div><form>f</form></article><!-- x --><footer>&copy; f</footer></body></html>"""


def test_html_main_text(spark):
    assert site_style.main_text(site_style.parse(PAGE)) == "A & B\n\none two three\n\nfour five"
    pages = [(i, f"http://h.example/{i}", f"<body><div class=x1>same notice here</div><div class=body1><p>text {i} {'w' * i}</p></div></body>") for i in range(20)]
    df = spark.createDataFrame(pages + [(50, None, None), (51, "::", ""), (52, "http://h.example/z", "<p>cut <")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style.extract(df).collect()}
    assert got[3] == "text 3 www" and got[50] == "" and got[51] == "" and got[52].startswith("cut")
    assert site_style.extract(df.where("false")).count() == 0


def test_packing_round_trip(spark, docs):
    rows = packing.pack(docs).collect()
    tokens = packing.Tokens(packing.default_tokenizer())
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sum(r.length for r in rows) == sum(len(tokens.ids(t or "")) // 2 + 1 for _, t in texts)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(sum(x for _, x in p) < packing.WINDOW for p in by_seq.values()) <= 4
    long_text = next(t for i, t in texts if i == 204)
    ids = np.r_[np.frombuffer(tokens.ids(long_text), dtype="<u2"), [1]].astype("<u4")
    for r in (r for r in rows if r.doc_id == 204):
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert packing.pack(_empty(docs)).count() == 0


@pytest.mark.parametrize("text", ["", "  a  b ", "\n\n x\t y  ", "a b", "<|endoftext|> hi", "日本語 12", "it's we'll", "x \n y", "\x1c a \x85 b", "٣ ²³ ª", "😀 a", "a.b, c!? d's\ne"])
def test_fast_ids_equal_tokenizers(text):
    tokens = packing.Tokens(packing.default_tokenizer())
    assert np.frombuffer(tokens.ids(text), dtype="<u2").tolist() == tokens.full.encode(text, add_special_tokens=False).ids


def test_mixing_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets) - total) < 1e-6 * total and all(t <= 3 * s + 1e-9 for s, t in targets)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(_empty(docs)).count() == 0


def test_language_accuracy_held_out(spark, docs):
    from chronofold.llm import catalog

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in catalog.op3_language_id(spark, sf).collect() if r.held_out]
    assert len(held) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    masks = language_id.fit(docs, F.lit(True))
    odd = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, masks).collect()]
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "und"), (0, "en")} <= set(odd)
    none = language_id.fit(_empty(docs), F.lit(True))
    assert language_id.identify(docs, none).count() == docs.count()


def test_language_masks_count_by_hand():
    grams = {"aa": np.arange(1, 400, dtype=np.uint64) << np.uint64(7), "bb": np.arange(300, 900, dtype=np.uint64) << np.uint64(7)}
    masks = language_id.LanguageMasks.build(grams, "aa")
    h = np.arange(1, 900, dtype=np.uint64) << np.uint64(7)
    assert np.all(np.abs(masks.counts(h) - [399, 600]) < 10)


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(8)
    clean = [_text(rng, 80) for _ in range(300)]
    bad = [" ".join([*t.split()[:30], rng.choice(["grunkle", "blorpish", "snarvous"]), *t.split()[30:], rng.choice(["grunkle", "blorpish"])]) for t in (_text(rng, 80) for _ in range(120))]
    model = toxicity.fit(bad[:60], clean[:150], 60 / 210)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean[150:] + bad[60:])] + [(900, None), (901, "")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert sum(got[i] for i in range(150)) <= 2 and sum(got[i] for i in range(150, 210)) >= 57 and got[900] == got[901] == 0
    empty = toxicity.fit([], [], None)
    assert toxicity.score(df, empty).count() == 212
