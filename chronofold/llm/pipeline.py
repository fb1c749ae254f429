"""The stages of the corpus pipeline: identify languages, drop near copies, redact personal data, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as
Parquet in the shared folder and reads it back as the next stage's input. All stages take null in any
column, empty and long texts, ties, repeated rows, empty tables and further columns (which are dropped).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, packing, pii, simhash
from .common import materialise, small_batches, table

#: Share of a text's n-grams that its language's filter must hold. In sf0.1 the least of 6000 documents has 0.28, of texts
#: of under 100 n-grams only licence lines, addresses and secrets are below 0.6; noise of 5 words has 0.18 at most.
KNOWN = 0.25
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in none of the corpus's languages: no letter, or too few n-grams that the best filter holds.

    Null and empty texts have no letter and go. Where no row has a language, none can be learnt and none is
    rejected for want of one: only texts without a letter go. Equal rows share their fate; ties between
    languages do not matter, as any known one keeps the row.
    """
    masks = language_id.fit(docs, F.lit(True))
    if not masks.languages:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))).select(*COLUMNS)
    rest = tuple(c for c in COLUMNS if c not in ("doc_id", "text"))
    out = language_id.identify(docs.select(*COLUMNS, F.col("text").alias("_body")), masks, text_col="_body", keep=("text", *rest), least=KNOWN)
    return out.where(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (five-word shingles, similarity 0.8 or more) stays: one with the smallest id, if any has one.

    Ties between equal ids go by the text's hash, and of rows equal in id and text one stays. Null, empty and
    word-less texts form one group.
    """
    docs = docs.select(*COLUMNS)
    rows = simhash.similar_rows(docs.select("doc_id", "text"), words=5).groupBy("part", "doc_id", "k1", "k2").agg(F.count("*").alias("copies"))
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "copies")).alias("row"))
    kept = materialise(least.select(F.col("row.doc_id").alias("_id"), F.col("row.k1").alias("_a"), F.col("row.k2").alias("_b"), F.col("row.copies").alias("_copies")), "kept-rows")
    # a merge join at every size: the kept rows grow with the documents, so they must not be broadcast
    docs = docs.select("*", *simhash.text_key("text")).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b"))
    once, more = (docs.join(kept.where(which).drop("_copies"), same, "left_semi") for which in ("_copies = 1", "_copies > 1"))
    return once.unionByName(more.dropDuplicates(["doc_id", "k1", "k2"])).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind; no document goes, and null texts stay null. Texts stay where
    they are: no shuffle. Overlapping spans become one; repeated rows are redacted alike."""
    small_batches(spark)
    model = pii.fit(pii.candidates(docs.select("doc_id", "text")))
    docs = docs.select(*COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [pii.redact(t, pii.spans_of(t, model)) for t in pdf["text"]]
            yield pdf

    return docs.mapInPandas(run, docs.schema).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source's words come near its target.

    Rows without a word weigh nothing and appear as often as their source's documents certainly do. Rows
    repeated with one id and equal in text and source share the copies of the luckiest.
    """
    docs = docs.select(*COLUMNS)
    key = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")]
    copies = mixing.mix(docs, keep_source=True).groupBy(*key).agg(F.max("copies").cast("int").alias("_copies")).where("_copies > 0")
    joined = docs.withColumn("_words", mixing.word_count("text")).join(
        copies, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids at most; null texts are empty, repeated rows are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can express neither the language filter nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
