"""The corpus pipeline, stage by stage, on a small corpus whose right result is known."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = "amber birch cedar delta ember fjord grove heath islet jetty knoll lagoon marsh north ocean pine quarry river stone tide".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, 120)) for _ in range(30)]
    near = texts[0].split()
    near[60] = "zebra"
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[1], "en", "s0", 1), (51, " ".join(near), "en", "s1", 1), (52, "123 456", "en", "s0", 7), (53, None, None, None, None), (54, texts[2] + " mail me a.b@example.com", "en", "s1", 1), (5, texts[5], "en", "s1", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, corpus):
    known = corpus_pipeline.keep_known_languages(spark, corpus, "")
    assert {r.doc_id for r in corpus.collect()} - {r.doc_id for r in known.collect()} == {52, 53}
    kept = corpus_pipeline.drop_near_copies(spark, known, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    clean = corpus_pipeline.redact_personal_data(spark, known, "")
    assert clean.count() == known.count() and [r.text[-7:] for r in clean.where("doc_id = 54").collect()] == ["[EMAIL]"]
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and 0 < mixed.count() <= 90
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, known.where("false"), "").count() == 0


def test_near_copies_are_those_of_exact_similarity(spark):
    """Pairs on both sides of 0.8 and chains below it: one document goes for each pair of 0.8 or more, and no other."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(5000)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, want = [], set()
    for k in range(240):
        base = rng.choice(vocabulary, 204).tolist()
        # a shared stretch of c words has c - 4 of the 200 shingles of each text
        other = base[: (182 if k % 2 else 175)] + rng.choice(vocabulary, 22 if k % 2 else 29).tolist()
        j = len(shingles(base) & shingles(other)) / len(shingles(base) | shingles(other))
        assert (j >= 0.8) == bool(k % 2) and 0.7 < j < 0.82
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} if j >= 0.8 else {2 * k, 2 * k + 1}
    base = rng.choice(vocabulary, 204).tolist()
    for k in range(60):  # each is 0.76 like the next, and no two are 0.8 alike
        rows.append((1000 + k, " ".join(base)))
        want.add(1000 + k)
        base = base[27:] + rng.choice(vocabulary, 27).tolist()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_exact_comparison_in_chunks(spark, monkeypatch):
    """The same groups if a part is cut into chunks that meet in pairs."""
    rng = np.random.default_rng(12)
    base = rng.choice([f"w{k}" for k in range(5000)], 204).tolist()
    texts = [" ".join(base[k:] + [f"v{k}"] * k) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, corpus_pipeline.simhash.similar_groups(docs).collect()))
    monkeypatch.setattr(corpus_pipeline.simhash, "LOAD", 4000)
    assert whole == sorted(map(tuple, corpus_pipeline.simhash.similar_groups(docs).collect()))
    assert len({c for _, c in whole}) < len(whole)


def test_unknown_languages_and_noise_are_rejected(spark, corpus):
    rng = np.random.default_rng(13)
    noise = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(80)) for _ in range(5)]
    odd = [(100 + i, t, None, "s0", 1) for i, t in enumerate(noise + ["Привет мир, как дела сегодня", "これは日本語です"])]
    short = [(200 + i, t, None, "s0", 1) for i, t in enumerate(("river", "stone tide", "amber north 12"))]
    docs = corpus.unionByName(spark.createDataFrame(odd + short, corpus.schema))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert not kept & {r[0] for r in odd} and {r[0] for r in short} <= kept and set(range(30)) <= kept


def test_null_and_repeated_ids_keep_every_text(spark):
    rng = np.random.default_rng(14)
    text = [" ".join(rng.choice(WORDS, 120)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[3]), (7, text[4]), (3, text[4]), (9, text[5]), (9, text[5]), (None, text[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    want = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (3, text[4]), (9, text[5])]
    assert sorted(kept, key=str) == sorted(want, key=str)
