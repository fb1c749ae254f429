"""How far the sources of a language differ in their words: exact sums of differences between smoothed term shares.

Every (language, source) group gives every kept term a share ``p``. The distance of two groups sums ``|p - q|`` over all
kept terms of the language, nearly all of which most groups lack. Terms are split by how many groups have them:

* **Heavy** terms (a quarter of the groups or more) fill dense tiles: a tile is a block of terms by two blocks of
  groups, absent terms at their group's base share, and numpy takes all differences.
* **Light** terms start from the base: were every light term absent from both groups, they would add ``|base - base|`` each.
  A term of one group only changes that by ``|p - base| - |base - base|``; as a share depends on the count alone, a histogram of a
  group's light shares gives this for every other group. For a term in both groups, the posting lists give the pair's correction.

All partial sums are integers, added by (language, source, source). Terms and pairs of group blocks are the units of
work: no language, source or frequent term gathers in one task, and joins on a group spread over salts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small_batches

LEAST_DOCS, SMOOTHING, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: A term is heavy if one in so many of its language's groups has it: a pair of postings costs over ten times a dense cell.
HEAVY = 4
#: Groups and terms of a tile, and the number of parts into which a group's terms are dealt.
GROUPS, TERMS, SALTS = 64, 512, 32
#: Terms that a task counts, and pairs that it corrects, before it hands on what it has.
HELD, PAIRS = 300_000, 1 << 20

#: In UTF-8 a term is a run of letters and of bytes from 0x80: all other bytes become spaces, A-Z become a-z.
_TERM_BYTES = bytes(c + 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of ``lang, source, text``, handed on when ``most`` terms are held."""
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}  # occurrences and documents of a group's terms
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(n.keys(), pa.binary(), size=len(n)).cast(pa.string())
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), terms]
            columns += [pa.array(n.values(), pa.int64(), size=len(n)), pa.array(map(docs.__getitem__, n), pa.int64(), size=len(n))]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources, texts = batch.columns
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.large_binary()).to_pylist()):
            n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = text.translate(_TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
            n[b""] += 1
            docs[b""] += 1
            size += len(n) - before
            if size >= most:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def term_counts(df: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group; the term '' counts the group's documents."""
    small_batches(df.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    part = rows.mapInArrow(partial(counted, most=HELD), "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _salt(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _share(count, total, terms):
    """``1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms))`` in whole numbers of any size."""
    exact = lambda c: c.cast("decimal(20,0)")
    over = F.lit(UNIT).cast("decimal(10,0)") * (exact(count) + F.lit(SMOOTHING))
    under = exact(total) + F.lit(SMOOTHING) * exact(terms)
    return F.lit(1) + F.call_function("div", over, F.nullif(under, F.lit(0)))


def shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups, and the share of every kept term in every group that has it.

    ``groups``: ``lang, source, sources`` (of the language), ``terms`` (kept ones), ``block, blocks, base`` (share of an absent term; null
    without kept terms). ``present``: ``lang, source, term, p, q`` (the language's share), ``k`` (groups that have the term), ``at`` (the group's place among
    them), ``base, block, blocks, sources``.
    """
    own = W.partitionBy("lang", "term")
    first = W.partitionBy("lang", "term").orderBy("source")
    counts = materialise(counts, "divergence-counts")
    held = (counts.where("term <> ''")
            .withColumns({"in_docs": F.sum("docs").over(own), "k": F.count("*").over(own), "all_n": F.sum("n").over(own), "at": F.row_number().over(first)})
            .where(F.col("in_docs") >= LEAST_DOCS).drop("docs", "in_docs"))
    kept = materialise(held, "divergence-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("at") == 1, 1).otherwise(0)).alias("new"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "new"])
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total"), F.sum("new").alias("terms"))
    blocks = F.ceil(F.col("sources") / F.lit(GROUPS)).cast("int")
    groups = (groups.drop("new").join(langs, "lang").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
              .withColumn("base", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))))
    groups = materialise(groups, "divergence-groups")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    present = (kept.withColumn("salt", _salt("term")).join(salted, ["lang", "source", "salt"])
               .withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("all_n"), F.col("lang_total"), F.col("terms"))})
               .select("lang", "source", "term", "p", "q", "k", "at", "base", "block", "blocks", "sources"))
    return groups, materialise(present, "divergence-present")


SUMS = "lang string, a string, b string, s long"


def _sums(lang: str, a: np.ndarray, b: np.ndarray, sums: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    """One row per pair of names whose cell is to be kept, the smaller name first."""
    at, to = np.nonzero(keep)
    one, two = a[at], b[to]
    swap = one > two
    return pd.DataFrame({"lang": lang, "a": np.where(swap, two, one), "b": np.where(swap, one, two), "s": sums[at, to]}, columns=["lang", "a", "b", "s"])


def _pairs_once(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Cells that stand for a pair of two groups: all of two blocks, the upper half of one block with itself."""
    return np.triu(np.ones((len(a), len(b)), dtype=bool), 1) if same else np.ones((len(a), len(b)), dtype=bool)


def _tiled(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``block, blocks``) once for every pair of blocks that its group is in: ``one <= two``."""
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other"))


def _dense(heavy: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over heavy terms, tile by tile."""
    # enough parts for TERMS terms each; how many there are is a number a language
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(TERMS))).cast("int")
    sizes = heavy.where("at = 1").groupBy("lang").agg(parts.alias("parts"))
    spread = materialise(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "divergence-parts")
    rows = (heavy.withColumn("salt", _salt("term", "source")).join(spread, ["lang", "salt"])
            .withColumn("part", F.pmod(F.xxhash64("term", F.lit(1)), F.col("parts")).cast("int")))
    in_part = materialise(rows.where("at = 1").groupBy("lang", "part").agg(F.count("*").alias("part_terms")), "divergence-terms")
    rows = _tiled(rows.select("lang", "part", "source", "term", "p", "block", "blocks"))
    names = _tiled(groups.select("lang", "source", "base", "block", "blocks").join(in_part, "lang"))
    key = ["lang", "part", "one", "two"]

    def tile(key: tuple, cells: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        lang, _, one, two = key
        names = names.sort_values("source", ignore_index=True)
        at_term, found = pd.factorize(cells["term"])
        place = pd.Index(names["source"]).get_indexer(cells["source"])
        base = names["base"].to_numpy(np.int64)
        share = np.tile(base[:, None], (1, len(found)))
        share[place, at_term] = cells["p"].to_numpy(np.int64)
        left, right = np.flatnonzero(names["block"] == one), np.flatnonzero(names["block"] == two)
        # the part's terms that no group of the tile has differ by the bases
        absent = int(names["part_terms"].iloc[0]) - len(found)
        sums = np.array([np.abs(share[right] - share[g]).sum(axis=1) + absent * np.abs(base[right] - base[g]) for g in left], dtype=np.int64).reshape(len(left), len(right))
        source = names["source"].to_numpy(object)
        return _sums(lang, source[left], source[right], sums, _pairs_once(left, right, one == two))

    cells = rows.select(*key, "source", "term", "p")
    return cells.groupBy(*key).cogroup(names.select(*key, "source", "base", "block", "part_terms").groupBy(*key)).applyInPandas(tile, SUMS)


def _base(light: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over light terms as if no term were in both groups of a pair; every pair of a language gets a row."""
    # shares of a group's light terms with their number; few, as a share is set by a count
    counted = light.groupBy("lang", "source", "block", "blocks", "p").agg(F.count("*").alias("m"))
    # light terms a language: those seen in their first group
    once = light.where("at = 1").groupBy("lang").agg(F.count("*").alias("light_terms"))
    bare = groups.join(once, "lang", "left").na.fill(0, ["light_terms"])
    at = ["lang", "source", "block", "blocks"]
    rows = bare.select(*at, F.lit(True).alias("group"), F.coalesce("base", F.lit(0)).alias("p"), F.col("light_terms").alias("m"))
    rows = rows.unionByName(counted.select(*at, F.lit(False).alias("group"), "p", "m"))
    key = ["lang", "one", "two"]

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, one, two = key
        names = pdf[pdf["group"]].sort_values("source", ignore_index=True)
        shares = pdf[~pdf["group"]]
        base = names["p"].to_numpy(np.int64)
        sums = np.abs(base[:, None] - base[None, :]) * int(names["m"].iloc[0])
        index = pd.Index(names["source"])
        for source, own in shares.groupby("source"):
            g = index.get_loc(source)
            p, m = own["p"].to_numpy(np.int64), own["m"].to_numpy(np.int64)
            # absent elsewhere: |p - base| in place of |base - base|
            for at in range(0, len(p), TERMS):
                more = (np.abs(p[at : at + TERMS, None] - base[None, :]) - np.abs(base[g] - base)[None, :]) * m[at : at + TERMS, None]
                sums[g] += more.sum(axis=0)
                sums[:, g] += more.sum(axis=0)
        block, source = names["block"].to_numpy(), names["source"].to_numpy(object)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        return _sums(lang, source[left], source[right], sums[np.ix_(left, right)], _pairs_once(left, right, one == two))

    return _tiled(rows).groupBy(*key).applyInPandas(tile, SUMS)


def _postings(light: DataFrame) -> DataFrame:
    """Corrections for light terms that both groups of a pair have: a term's posting list is under a quarter of the groups."""
    lists = (light.where("k > 1").groupBy("lang", "term")
             .agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("posting")).select("lang", "posting"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            one, two, more = (np.concatenate(c) for c in zip(*held))
            pairs, at = np.unique(one << 32 | two, return_inverse=True)
            sums = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(sums, at, more)
            names = list(number)
            ends = [[names[k] for k in half.tolist()] for half in (pairs >> 32, pairs & 0xFFFFFFFF)]
            columns = [[lang for lang, _ in ends[0]], [a for _, a in ends[0]], [b for _, b in ends[1]]]
            held, size = [], 0
            return pa.record_batch([*(pa.array(c, pa.string()) for c in columns), pa.array(sums)], names=["lang", "a", "b", "s"])

        for batch in batches:
            langs, posting = batch.column(0).to_pylist(), batch.column(1)
            starts, flat = np.diff(posting.offsets.to_numpy()), posting.flatten()
            owner = np.repeat(np.arange(len(langs)), starts)
            code = np.array([number.setdefault((langs[k], name), len(number)) for k, name in zip(owner.tolist(), flat.field("source").to_pylist())], dtype=np.int64)
            p, base, at = flat.field("p").to_numpy(), flat.field("base").to_numpy(), 0
            for k in starts.tolist():
                i, j = _halves(k)
                i, j = i + at, j + at
                more = np.abs(p[i] - p[j]) - np.abs(p[i] - base[j]) - np.abs(p[j] - base[i]) + np.abs(base[i] - base[j])
                held.append((code[i], code[j], more))
                at, size = at + k, size + len(i)
                if size >= PAIRS:
                    yield flush()
        if held:
            yield flush()

    return lists.mapInArrow(run, SUMS)


@lru_cache(maxsize=256)
def _halves(k: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in a sorted list, the earlier place first."""
    return np.triu_indices(k, 1)


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets the sources of each language apart.

    Part ``pair``: every other source of the language by the sum of differences between both groups' shares over all kept
    terms, largest first. Part ``term``: the ``TERM_RANKS`` terms whose share in the group exceeds the language's most. Ties go by UTF-8.
    Terms are runs of letters and characters beyond ASCII, with A-Z lower-cased; a language keeps the terms of at least ``LEAST_DOCS``
    of its documents. Null texts, languages and sources count as ''. Groups without terms take part; a language without kept
    terms has distances of 0, one with a single source has no pairs. An empty table gives an empty result; repeated rows count as often as they
    stand there; further columns are ignored. All sums are whole numbers.
    """
    groups, present = shares(term_counts(df, lang_col, source_col, text_col))
    heavy = present.where(F.col("k") * HEAVY >= F.col("sources"))
    light = present.where(F.col("k") * HEAVY < F.col("sources"))
    parts = _dense(heavy, groups).unionByName(_base(light, groups)).unionByName(_postings(light))
    sums = materialise(parts.groupBy("lang", "a", "b").agg(F.sum("s").alias("value")), "divergence-pairs")
    both = (sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
            .unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = (present.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERM_RANKS).withColumn("part", F.lit("term")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))


#: The same rows for DuckDB.
ORACLE = """
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS d FROM documents),
words AS (SELECT lang, source, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
shares AS (SELECT c.*, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM cells c JOIN totals USING (lang, source) JOIN v USING (lang)),
langs AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t.total) + 5 * any_value(v.v)) AS q
          FROM cells JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) JOIN v USING (lang) GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
          GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - l.q AS value FROM shares s JOIN langs l USING (lang, term) WHERE s.n > 0 AND s.p > l.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
