"""Set-similarity joins by prefix filters, and the order-aware ratio of two token sequences.

Two sets that must share much cannot differ in all of their rarest tokens: of ``n`` tokens, sorted by how rare they are among the
sets of their key, only the first ``n - needed + 1`` have to be looked at. Sets meet by an equi-join on such a token, never all with
all, and a pair is taken up at the first token that both prefixes hold, so it comes out once without a further shuffle. Size and
place bound what two sets can still share before their intersection is computed. Equal sets are one class: copies give
one pair with every other class and are never paired among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import dialect
from ..plans.pairs import DUPLICATE
from ..sources.relations import CONVERSATIONS, USERS, asked, said
from .graph import cut

#: Jaccard from which two token sets are alike, and the ratio from which two sequences are.
ALIKE, IN_ORDER = 0.5, 0.75
#: Masked statements and questions that two scenarios may share before one counts as a copy.
SHARED_STATEMENTS, SHARED_QUESTIONS = 2, 3


def _meet(sets: DataFrame, prefix: Column, least) -> DataFrame:
    """``key, a, b, inter, n_a, n_b`` of all pairs ``b < a`` of ``sets(key, id, t)`` whose prefixes meet and that may share ``least(n_a, n_b)``."""
    words = sets.select("key", "id", F.explode("t").alias("w"))
    rare = words.groupBy("key", "w").agg(F.count("*").alias("f"))
    ranked = words.join(rare, ["key", "w"]).groupBy("key", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]).alias("t"))
    ranked = cut(ranked.withColumn("n", F.size("t")).withColumn("p", F.slice("t", F.lit(1), F.greatest(prefix, F.lit(0)))))
    spread = ranked.select("key", "id", "n", "t", "p", F.posexplode("p").alias("at", "w"))
    a, b = (spread.select("key", "w", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "t", "p", "at"))) for side in "ab")
    # what is shared before this token is nothing, as pairs are taken at their first; after it, no more than the shorter rest
    most = F.lit(1) + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - F.lit(1)
    met = a.join(b, ["key", "w"]).where((F.col("id_b") < F.col("id_a")) & (most >= least(F.col("n_a"), F.col("n_b"))))
    first = F.get(F.array_intersect("p_a", "p_b"), F.lit(0)) == F.col("w")
    return met.where(first).select("key", F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.size(F.array_intersect("t_a", "t_b")).alias("inter"), "n_a", "n_b")


def jaccard_join(sets: DataFrame, threshold: float) -> DataFrame:
    """``key, a, b, j``: all pairs ``b < a`` of different sets ``(key, id, t)`` of one key with a Jaccard similarity of ``threshold`` (above 0) or more.

    ``t`` is an array without repeats; empty and null sets pair with nothing; ids are unique in a key; null keys do not meet.
    """
    needed = lambda n: F.ceil(n * F.lit(threshold) - F.lit(1e-9))
    least = lambda x, y: F.ceil((x + y) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    met = _meet(sets, (F.col("n") - needed(F.col("n")) + 1).cast("int"), least)
    j = F.col("inter").cast("double") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
    return met.withColumn("j", j).where(F.col("j") >= threshold).select("key", "a", "b", "j")


def overlap_join(sets: DataFrame, shared: int) -> DataFrame:
    """``key, a, b, inter``: all pairs ``b < a`` of sets of one key that share ``shared`` or more tokens."""
    met = _meet(sets, F.col("n") - F.lit(shared - 1), lambda x, y: F.lit(shared))
    return met.where(F.col("inter") >= shared).select("key", "a", "b", "inter")


def _classes(rows: DataFrame, of: str) -> DataFrame:
    """One row for each value of ``of`` in a bank, named by its first place."""
    return rows.groupBy("bank", of).agg(F.min("ord").alias("first"), F.count("*").alias("members"))


def _said(spark: SparkSession, sf_dir: str | None, inputs: dict | None) -> DataFrame:
    return dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, text FROM said", inputs)


def jaccard_band_join(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Pairs of different token sets of a bank's statements with a Jaccard similarity of ``ALIKE`` or more. A set is named by its first
    statement and comes with the number of statements that have it."""
    sets = dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, {d.tokens('text')} AS t FROM said WHERE text IS NOT NULL", inputs)
    classes = cut(_classes(sets, "t").select(F.col("bank").alias("key"), F.col("first").alias("id"), "t", "members"))
    pairs = jaccard_join(classes, ALIKE)
    new, old = (classes.select("key", F.col("id").alias(c), F.col("members").alias(f"{n}_n")) for c, n in (("a", "new"), ("b", "old")))
    return (pairs.join(new, ["key", "a"]).join(old, ["key", "b"])
            .select(F.col("key").alias("bank"), F.col("a").alias("new_ord"), F.col("b").alias("old_ord"), F.round("j", 6).alias("j"), "new_n", "old_n"))


def _band_oracle(d) -> str:
    return f"""WITH {said(d)}, x AS (SELECT bank, ord, {d.tokens('text')} AS t FROM said WHERE text IS NOT NULL), s AS (SELECT bank, t, min(ord) AS ord, count(*) AS n FROM x GROUP BY bank, t)
      SELECT a.bank, a.ord AS new_ord, b.ord AS old_ord, round({T.jaccard(d, 'a.t', 'b.t')}, 6) AS j, a.n AS new_n, b.n AS old_n FROM s a JOIN s b ON a.bank = b.bank AND b.ord < a.ord WHERE {T.jaccard(d, 'a.t', 'b.t')} >= {ALIKE}"""


def suppress_duplicates(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Statements that restate an earlier one of their bank: Jaccard of 0.85 or more, and neither a refinement nor a different
    fact; the newest such one is named.

    Texts are classes: rules compare one text with another once. The statements of a text and of those it is like then form one row of
    time, where each looks back to the one before it.
    """
    rows = cut(_said(spark, sf_dir, inputs).where("text is not null"))
    classes = cut(_classes(rows, "text"))

    def features(d) -> str:
        folded = d.uniq(d.map(T.content(d, "text"), T.fold(d, "x")))
        return f"SELECT bank, first, {d.tokens('text')} AS t, {T.content(d, 'text')} AS words, {folded} AS folded, {T.negated(d, 'text')} AS neg FROM {d.inputs['classes']}"

    f = cut(dialect.run(spark, None, features, {"classes": classes}))
    # texts of one token set are like each other: a chain from each to the next one would not say so, so sets pair by class below
    by_set = cut(f.groupBy("bank", "t").agg(F.min("first").alias("id"), F.collect_list("first").alias("texts")))
    pairs = jaccard_join(by_set.select(F.col("bank").alias("key"), "id", "t"), DUPLICATE)
    same = by_set.select(F.col("bank").alias("key"), F.col("id").alias("a"), F.col("id").alias("b")).where(F.size("t") > 0)
    texts = by_set.select(F.col("bank").alias("key"), "id", F.explode("texts").alias("x"))
    links = (pairs.select("key", "a", "b").unionByName(same).join(texts.withColumnRenamed("id", "a").withColumnRenamed("x", "one"), ["key", "a"])
             .join(texts.withColumnRenamed("id", "b").withColumnRenamed("x", "two"), ["key", "b"]).where("one > two or a <> b"))
    side = lambda s: f.select(F.col("bank").alias("key"), F.col("first").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("words", "folded", "neg")))
    judged = links.select("key", "one", "two").join(side("one"), ["key", "one"]).join(side("two"), ["key", "two"])
    more, fewer = F.array_except("words_one", "words_two"), F.array_except("words_two", "words_one")
    wordy = lambda x: F.exists(x, lambda w: ~w.rlike("[0-9]"))
    refines = (F.size(more) + F.size(fewer) > 0) & ~wordy(more) & ~wordy(fewer)
    distinct = (F.col("neg_one") != F.col("neg_two")) | ((F.size(F.array_except("folded_one", "folded_two")) > 0) & (F.size(F.array_except("folded_two", "folded_one")) > 0))
    kept = cut(judged.where(~refines & ~distinct).select("key", "one", "two"))
    itself = f.where(F.size("t") > 0).select(F.col("bank").alias("key"), F.col("first").alias("one"), F.col("first").alias("two"))
    seen = kept.unionByName(kept.select("key", F.col("two").alias("one"), F.col("one").alias("two"))).unionByName(itself)
    placed = rows.join(classes.select("bank", "text", "first"), ["bank", "text"]).select(F.col("bank").alias("key"), F.col("first").alias("two"), "ord")
    told = seen.join(placed, ["key", "two"]).withColumn("own", F.col("one") == F.col("two"))
    before = W.partitionBy("key", "one").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    back = told.withColumn("duplicate_of", F.max("ord").over(before)).where("own and duplicate_of is not null")
    return back.select(F.col("key").alias("bank"), "ord", "duplicate_of")


def match_ratio(a: list, b: list) -> float:
    """Twice the tokens in common blocks over all tokens: the longest common block counts, then those to its left and to its right, and so on.

    The earliest longest block is taken. In a second sequence of 200 tokens and more, tokens that make up over a hundredth of it start no
    block, they only lengthen one. Two empty sequences are equal.
    """
    if not a and not b:
        return 1.0
    places: dict = {}
    for y, token in enumerate(b):
        places.setdefault(token, []).append(y)
    if len(b) >= 200:
        places = {token: at for token, at in places.items() if len(at) <= len(b) // 100 + 1}
    common, regions = 0, [(0, len(a), 0, len(b))]
    while regions:
        left, right, low, high = regions.pop()
        size, x0, y0, ending = 0, left, low, {}
        for x in range(left, right):
            now = {}
            for y in places.get(a[x], ()):
                if y >= high:
                    break
                if y >= low:
                    now[y] = k = ending.get(y - 1, 0) + 1
                    if k > size:
                        size, x0, y0 = k, x - k + 1, y - k + 1
            ending = now
        while x0 > left and y0 > low and a[x0 - 1] == b[y0 - 1]:
            x0, y0, size = x0 - 1, y0 - 1, size + 1
        while x0 + size < right and y0 + size < high and a[x0 + size] == b[y0 + size]:
            size += 1
        if size:
            common += size
            regions += [(left, x0, low, y0), (x0 + size, right, y0 + size, high)]
    return 2.0 * common / (len(a) + len(b))


def with_ratio(pairs: DataFrame, a: str, b: str, least: float = 0.0) -> DataFrame:
    """``pairs`` with the ``match_ratio`` of two token arrays (null counts as empty) in column ``ratio``, where it is ``least`` or more.

    What the lengths and the counts of equal tokens allow is computed first, in the JVM; Python sees the pairs that may still reach ``least``.
    """
    counted = lambda c: F.transform(c, lambda x, k: F.concat(x, F.lit("\x01"), F.size(F.filter(F.slice(c, F.lit(1), k + 1), lambda y: y == x)).cast("string")))
    one, two = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (a, b))
    total = F.size(one) + F.size(two)
    short = F.lit(2.0) * F.least(F.size(one), F.size(two)) >= F.lit(least) * total
    many = F.lit(2.0) * F.size(F.array_intersect(counted(one), counted(two))) >= F.lit(least) * total

    @F.pandas_udf("double")
    def ratio(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in x:
            yield pd.Series([match_ratio(list(p), list(q)) for p, q in zip(left, right)], dtype="float64")

    return pairs.where(short).where(many).withColumn("ratio", ratio(one, two)).where(F.col("ratio") >= least)


def sequence_matches(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Pairs of different word sequences of a bank that say nearly the same in nearly the same order: found by their sets, then compared in order.

    Sequences of ratio r share at least r / 2 of all words, so their sets need not be alike; those that are not are no near copies here.
    """
    words = dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)}, w AS (SELECT bank, ord, {d.found('lower(text)', '[a-z0-9]+')} AS words FROM said WHERE text IS NOT NULL) SELECT bank, words, min(ord) AS ord FROM w GROUP BY bank, words", inputs)
    words = cut(words)
    by_set = cut(words.withColumn("t", F.array_distinct("words")).withColumn("t", F.sort_array("t")).groupBy("bank", "t").agg(F.min("ord").alias("id"), F.collect_list("ord").alias("ords")))
    pairs = jaccard_join(by_set.select(F.col("bank").alias("key"), "id", "t"), ALIKE).select("key", "a", "b")
    pairs = pairs.unionByName(by_set.select(F.col("bank").alias("key"), F.col("id").alias("a"), F.col("id").alias("b")))
    texts = by_set.select(F.col("bank").alias("key"), "id", F.explode("ords").alias("x"))
    met = (pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("x", "one"), ["key", "a"]).join(texts.withColumnRenamed("id", "b").withColumnRenamed("x", "two"), ["key", "b"])
           .where("a <> b or one > two").select("key", F.greatest("one", "two").alias("new_ord"), F.least("one", "two").alias("old_ord")))
    for c, name in (("new_ord", "new_words"), ("old_ord", "old_words")):
        met = met.join(words.select(F.col("bank").alias("key"), F.col("ord").alias(c), F.col("words").alias(name)), ["key", c])
    return with_ratio(met, "new_words", "old_words", IN_ORDER).select(F.col("key").alias("bank"), "new_ord", "old_ord", F.round("ratio", 6).alias("ratio"))


def scenario_copies(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scenarios (chats and the inline banks) that copy another one: ``bank, other, test, shared``.

    ``pattern``: the same statements replace the same ones, in banks that replace anything; ``other`` is the first such bank, ``shared`` how many have the
    pattern. ``statements``: over ``SHARED_STATEMENTS`` texts are the same once names are masked. ``questions``: over ``SHARED_QUESTIONS``
    questions are the same.
    """
    from ..plans.pairs import rules_pairs

    scenario = lambda c: (F.col(c) < USERS)
    told = _said(spark, sf_dir, inputs).where(scenario("bank") & F.col("text").isNotNull())
    put = dialect.run(spark, sf_dir, lambda d: f"WITH {asked(d)} SELECT bank, question FROM asked WHERE question IS NOT NULL", inputs)
    edges = dialect.run(spark, sf_dir, rules_pairs, inputs).where(scenario("bank"))
    drawn = edges.groupBy("bank").agg(F.sort_array(F.collect_list(F.struct("new_ord", "old_ord"))).alias("p"))
    size = told.groupBy("bank").agg(F.count("*").alias("n"))
    drawn = drawn.join(size, "bank").select("bank", F.struct("n", "p").alias("p"))
    group = W.partitionBy("p")
    pattern = (drawn.withColumns({"other": F.min("bank").over(group), "shared": F.count("*").over(group)}).where("bank <> other")
               .select("bank", "other", F.lit("pattern").alias("test"), "shared"))
    masked = F.lower(F.trim(F.regexp_replace("text", r"\b[A-Z]\w+", "X")))
    both = []
    for rows, value, most, test in ((told, masked, SHARED_STATEMENTS, "statements"), (put, F.lower(F.trim("question")), SHARED_QUESTIONS, "questions")):
        sets = rows.groupBy(F.col("bank").alias("id")).agg(F.collect_set(F.md5(value)).alias("t")).withColumn("key", F.lit(0))
        both.append(overlap_join(sets, most + 1).select(F.col("a").alias("bank"), F.col("b").alias("other"), F.lit(test).alias("test"), F.col("inter").cast("long").alias("shared")))
    return pattern.unionByName(both[0]).unionByName(both[1])


def queries() -> dict:
    """``scenario_copies`` is left to callers with scenarios of their own: the tables' chats are copies of nothing."""
    return {f.__name__: f for f in (jaccard_band_join, suppress_duplicates, sequence_matches)}


def oracle_sql() -> dict[str, str]:
    from ..plans.pairs import all_pairs_duplicates

    return {"jaccard_band_join": _band_oracle(dialect.DUCK), "suppress_duplicates": all_pairs_duplicates(dialect.DUCK)}
