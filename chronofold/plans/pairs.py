"""Pairs of facts: candidates, duplicates, and the rules that decide which fact replaces which (J*, L1-L5, U1)."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.relations import said, values
from .dialect import plan

DUPLICATE, OVERLAP = 0.85, 0.5


def turns(d) -> str:
    """User turns with their token sets; the bank is the conversation."""
    return f"turns AS (SELECT conv_id AS bank, turn AS ord, text, {d.tokens('text')} AS t FROM conversations WHERE role = 'user')"


def features(d) -> str:
    """Everything the rules read, once per text, so that pairs only compare columns; an input of this name stands for it."""
    if "features" in d.inputs:
        return f"features AS (SELECT * FROM {d.inputs['features']})"
    s = T.spaced(d, "text")
    p = "^The ([a-z]+) (for|of) ([A-Za-z]+) is (.+)$"
    kv = "^(My|Our) ([A-Za-z ]+) (is|are) (.+)$"
    return f"""features AS (SELECT CAST(bank AS BIGINT) AS bank, CAST(ord AS BIGINT) AS ord, CAST(day AS DATE) AS day, text, {s} AS s, {d.tokens('text')} AS t, {T.content(d, 'text')} AS words, {T.anchors(d, 'text')} AS anchors,
      {T.topic(d, 'text')} AS topic, {T.kind(d, 'text')} AS kind, {d.part('text', p, 1)} AS attr, {d.part('text', p, 3)} AS scope, {d.part('text', kv, 2)} AS k, lower({d.part('text', kv, 4)}) AS v,
      CASE WHEN {d.has(T.spaced(d, T.asserted(d, 'text')), L.REVERSAL)} THEN 1 ELSE 0 END AS reversal, CASE WHEN {T.additive(d, 'text')} THEN 1 ELSE 0 END AS additive, CASE WHEN {T.safety(d, 'text')} THEN 1 ELSE 0 END AS safety, CASE WHEN {T.negated(d, 'text')} THEN 1 ELSE 0 END AS neg, {d.uniq(d.map(T.content(d, 'text'), T.fold(d, 'x')))} AS folded,
      CASE WHEN {d.has(s, ' my (' + '|'.join(L.KIN) + ') ')} THEN {d.part(s, ' my (' + '|'.join(L.KIN) + ') ', 1)} ELSE 'user' END AS actor, CASE WHEN {T.directive(d, 'text')} THEN 1 ELSE 0 END AS directive FROM said)"""


def judged(d) -> str:
    """Each new fact against every earlier one of its bank, with the first rule that fires.

    Skips come first (refinement, other person, other scope, event), then an attribute of a named thing, a different
    key, the slot, the same key with another value, the overlap band and a plain reversal. A safety fact goes only
    by a reversal that names what it names. With an input ``met(bank, new_ord, old_ord)`` only these pairs are judged."""
    multi = ", ".join(f"'{m}'" for m in L.MULTI_VALUED)
    back = ", ".join(f"'{m}'" for m in L.RETIRED_BY_REVERSAL)
    only = lambda x: d.n(d.where(x, "NOT " + d.has("x", "[0-9]")))
    more, fewer = d.less("words", "old_words"), d.less("old_words", "words")
    met = "features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord"
    if "met" in d.inputs:
        met = f"{d.inputs['met']} m JOIN features n ON n.bank = m.bank AND n.ord = m.new_ord JOIN features o ON o.bank = m.bank AND o.ord = m.old_ord"
    # numbers once per pair, then the rules in order; the first that speaks decides
    return f"""{features(d)}, met AS (SELECT n.bank, n.ord AS new_ord, o.ord AS old_ord, n.topic, o.topic AS old_topic, {T.jaccard(d, 'n.t', 'o.t')} AS j, n.words, o.words AS old_words, n.kind, o.kind AS old_kind, n.directive + o.directive AS directive,
        n.actor, o.actor AS old_actor, n.attr, o.attr AS old_attr, n.scope, o.scope AS old_scope, n.k, o.k AS old_k, n.v, o.v AS old_v, n.reversal, n.additive, o.safety AS old_safety,
        {d.n(d.both('n.anchors', 'o.anchors'))} AS anchored, CASE WHEN n.neg <> o.neg OR ({d.n(d.less('n.folded', 'o.folded'))} > 0 AND {d.n(d.less('o.folded', 'n.folded'))} > 0) THEN 1 ELSE 0 END AS differs,
        CASE WHEN (n.scope <> '' AND NOT contains(lower(o.text), lower(n.scope))) OR (o.scope <> '' AND NOT contains(lower(n.text), lower(o.scope))) THEN 1 ELSE 0 END AS outside
      FROM {met}),
    pairs AS (SELECT bank, new_ord, old_ord, topic, round(j, 6) AS j, CASE WHEN old_safety = 1 AND NOT (reversal = 1 AND anchored > 0) THEN 1 ELSE 0 END AS safety,
      CASE WHEN {d.n(more)} + {d.n(fewer)} > 0 AND {only(more)} = 0 AND {only(fewer)} = 0 THEN 'refinement'
        WHEN actor <> old_actor THEN 'other_actor' WHEN scope <> '' AND old_scope <> '' AND scope <> old_scope THEN 'other_scope' WHEN outside = 1 THEN 'other_scope'
        WHEN kind = 'event' OR old_kind = 'event' OR directive > 0 THEN 'event'
        WHEN attr <> '' AND old_attr <> '' THEN CASE WHEN attr = old_attr AND j < {DUPLICATE} AND additive = 0 THEN 'attribute' ELSE 'none' END
        WHEN k <> '' AND old_k <> '' AND k <> old_k AND (topic IS NULL OR topic IS DISTINCT FROM old_topic) THEN 'none'
        WHEN topic IS NOT NULL AND old_topic IS NOT NULL THEN CASE WHEN topic <> old_topic OR additive = 1 THEN 'none'
          WHEN topic IN ({multi}) THEN CASE WHEN topic IN ({back}) AND reversal = 1 AND anchored > 0 THEN 'reversal' ELSE 'many' END
          WHEN j >= {DUPLICATE} AND differs = 0 THEN 'none' ELSE 'slot' END
        WHEN k <> '' AND k = old_k AND v <> old_v THEN 'key_value' WHEN j >= {OVERLAP} AND j < {DUPLICATE} THEN 'overlap' WHEN topic IS NOT NULL THEN 'none'
        WHEN reversal = 1 AND j > 0 AND anchored > 0 THEN 'reversal' ELSE 'none' END AS rule FROM met),
    verdicts AS (SELECT *, CASE WHEN safety > 0 AND rule IN ('attribute', 'key_value', 'reversal', 'slot', 'overlap') THEN 'safety' ELSE rule END AS reason FROM pairs)"""


REPLACES = "('attribute', 'key_value', 'reversal', 'slot', 'overlap')"


@plan
def earlier_later_pairs(d):
    return f"WITH {turns(d)} SELECT a.bank, a.ord AS new_ord, b.ord AS old_ord FROM turns a JOIN turns b ON a.bank = b.bank AND b.ord < a.ord"


@plan
def jaccard_pairs(d):
    return f"WITH {turns(d)} SELECT a.bank, a.ord AS new_ord, b.ord AS old_ord, round({T.jaccard(d, 'a.t', 'b.t')}, 6) AS j FROM turns a JOIN turns b ON a.bank = b.bank AND b.ord < a.ord"


def all_pairs_duplicates(d) -> str:
    """What ``operators.similarity.suppress_duplicates`` gives, by comparing all pairs of a bank."""
    more, fewer = d.less("a.words", "b.words"), d.less("b.words", "a.words")
    digits = lambda x: d.n(d.where(x, "NOT " + d.has("x", "[0-9]")))
    refines = f"({d.n(more)} + {d.n(fewer)} > 0 AND {digits(more)} = 0 AND {digits(fewer)} = 0)"
    distinct = f"(a.neg <> b.neg OR ({d.n(d.less('a.folded', 'b.folded'))} > 0 AND {d.n(d.less('b.folded', 'a.folded'))} > 0))"
    return f"""WITH {said(d)}, f AS (SELECT bank, ord, {d.tokens('text')} AS t, {d.n(d.tokens('text'))} AS n, {T.content(d, 'text')} AS words, {d.uniq(d.map(T.content(d, 'text'), T.fold(d, 'x')))} AS folded,
        CASE WHEN {T.negated(d, 'text')} THEN 1 ELSE 0 END AS neg FROM said)
      SELECT a.bank, a.ord, max(b.ord) AS duplicate_of FROM f a JOIN f b ON a.bank = b.bank AND b.ord < a.ord AND a.n >= {DUPLICATE} * b.n AND b.n >= {DUPLICATE} * a.n
      WHERE {T.jaccard(d, 'a.t', 'b.t')} >= {DUPLICATE} AND NOT {refines} AND NOT {distinct} GROUP BY a.bank, a.ord"""


def _rule(d, rule):
    return f"WITH {said(d)}, {judged(d)} SELECT bank, new_ord, old_ord, j FROM verdicts WHERE rule = '{rule}'"


@plan
def overlap_band(d):
    return f"WITH {said(d)}, {judged(d)} SELECT bank, new_ord, old_ord, j FROM verdicts WHERE j >= {OVERLAP} AND j < {DUPLICATE}"


@plan
def kv_slot_update(d):
    return _rule(d, "key_value")


@plan
def reversal_rule(d):
    return _rule(d, "reversal")


@plan
def attribute_update(d):
    return _rule(d, "attribute")


@plan
def safety_veto(d):
    return f"WITH {said(d)}, {judged(d)} SELECT bank, new_ord, old_ord, rule, reason FROM verdicts WHERE safety > 0"


@plan
def conflict_resolve(d):
    return f"WITH {said(d)}, {judged(d)} SELECT bank, new_ord, old_ord, reason, CASE WHEN reason IN {REPLACES} THEN 1 ELSE 0 END AS retires FROM verdicts"


@plan
def may_replace(d):
    return f"WITH {said(d)}, {judged(d)} SELECT bank, new_ord, old_ord FROM verdicts WHERE rule NOT IN ('event', 'refinement', 'other_actor', 'other_scope', 'many') AND safety = 0"


@plan
def session_overrides(d):
    """Facts that any of a session's statements (place 7 and later) would replace."""
    return f"WITH {said(d)}, {judged(d)} SELECT DISTINCT bank, old_ord FROM verdicts WHERE new_ord >= 7 AND old_ord < 7 AND reason IN {REPLACES}"


@plan
def rules_pairs(d):
    """The newest judge of each retired fact: one edge per old fact."""
    return f"WITH {said(d)}, {judged(d)} SELECT bank, old_ord, min(new_ord) AS new_ord FROM verdicts WHERE reason IN {REPLACES} GROUP BY bank, old_ord"


@plan
def semantic_supersession(d):
    """The best earlier vector of every vector, if it is close enough (0.30) and clearly ahead of the second (by 0.08)."""
    return f"""WITH s AS (SELECT q.vec_id AS new_id, v.vec_id AS old_id, round({d.dot('q.embedding', 'v.embedding')}, 6) AS sim FROM embeddings q JOIN embeddings v ON v.vec_id < q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) AS k, lead(sim) OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) AS second FROM s)
      SELECT new_id, old_id, sim FROM r WHERE k = 1 AND sim >= 0.3 AND (second IS NULL OR sim - second >= 0.08)"""


@plan
def candidate_generation(d):
    """The ten most similar earlier turns, and up to twelve more that share a word of five letters or more."""
    return f"""WITH {turns(d)}, p AS (SELECT a.bank, a.ord AS new_ord, b.ord AS old_ord, round({T.jaccard(d, 'a.t', 'b.t')}, 6) AS j, {d.n(d.where(d.both('a.t', 'b.t'), 'length(x) >= 5'))} AS linked FROM turns a JOIN turns b ON a.bank = b.bank AND b.ord < a.ord),
      r AS (SELECT *, row_number() OVER (PARTITION BY bank, new_ord ORDER BY j DESC, old_ord) AS k FROM p),
      l AS (SELECT *, row_number() OVER (PARTITION BY bank, new_ord ORDER BY linked DESC, old_ord) AS m FROM r WHERE k > 10 AND linked > 0)
      SELECT bank, new_ord, old_ord, 'similar' AS why FROM r WHERE k <= 10 UNION ALL SELECT bank, new_ord, old_ord, 'linked' AS why FROM l WHERE m <= 12"""


@plan
def candidate_same_slot(d):
    return f"WITH {said(d)}, {features(d)}, r AS (SELECT n.bank, n.ord AS new_ord, o.ord AS old_ord, row_number() OVER (PARTITION BY n.bank, n.ord ORDER BY o.ord DESC) AS k FROM features n JOIN features o ON n.bank = o.bank AND n.topic = o.topic AND o.ord < n.ord) SELECT bank, new_ord, old_ord FROM r WHERE k <= 20"


@plan
def candidate_union(d):
    return f"""WITH {said(d)}, {features(d)}, u AS (SELECT n.bank, n.ord AS new_ord, o.ord AS old_ord FROM features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord AND n.topic = o.topic
      UNION SELECT n.bank, n.ord, o.ord FROM features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord WHERE {d.n(d.both('n.anchors', 'o.anchors'))} > 0
      UNION SELECT n.bank, n.ord, o.ord FROM features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord AND n.actor = o.actor AND n.actor <> 'user') SELECT bank, new_ord, old_ord FROM u"""


LINKS = values("links", "bank, a, b", [(3, "tom", "boyfriend"), (3, "boyfriend", "partner"), (3, "rex", "dog"), (1, "bram", "manager"), (1, "manager", "boss"), (1, "odile", "boss")])


@plan
def answerable_questions(d):
    """Benchmark items all of whose words occur in the documents: subset test by counting."""
    words = d.found("lower(text)", "[a-z0-9]+")
    return f"""WITH want AS (SELECT DISTINCT item_id, w FROM benchmark {d.explode(words, 'w')}), have AS (SELECT DISTINCT w FROM documents {d.explode(words, 'w')})
      SELECT want.item_id, count(*) AS wanted, count(have.w) AS got FROM want LEFT JOIN have ON want.w = have.w GROUP BY want.item_id HAVING count(*) = count(have.w)"""


def bridge(d) -> str:
    """Orders and parts as folders: which fact lies in which folder."""
    return "bridge AS (SELECT DISTINCT l_orderkey AS fact, l_partkey AS folder FROM lineitem)"


@plan
def folder_route_score(d):
    """Inverse document frequency over the folders that a question's order and another order share."""
    return f"""WITH {bridge(d)}, n AS (SELECT count(DISTINCT fact) AS n FROM bridge), w AS (SELECT folder, ln(CAST(n.n AS DOUBLE) / count(*)) / ln(CAST(n.n AS DOUBLE)) AS w FROM bridge, n GROUP BY folder, n.n)
      SELECT q.fact AS question, b.fact, round(sum(w.w), 6) AS score FROM bridge q JOIN bridge b ON q.folder = b.folder AND q.fact <> b.fact JOIN w ON w.folder = q.folder WHERE q.fact % 50 = 0 GROUP BY q.fact, b.fact"""


@plan
def one_hop_boost(d):
    return f"""WITH {bridge(d)}, top AS (SELECT q.fact AS question, b.fact, row_number() OVER (PARTITION BY q.fact ORDER BY b.fact) AS k FROM bridge q JOIN bridge b ON q.folder = b.folder AND b.fact <> q.fact WHERE q.fact % 50 = 0),
      more AS (SELECT DISTINCT t.question, b.folder FROM top t JOIN bridge b ON b.fact = t.fact WHERE t.k <= 3 EXCEPT SELECT fact AS question, folder FROM bridge)
      SELECT m.question, b.fact, count(*) AS shared FROM more m JOIN bridge b ON b.folder = m.folder GROUP BY m.question, b.fact"""


@plan
def folder_cooccurrence(d):
    return f"""WITH {bridge(d)}, c AS (SELECT a.folder, b.folder AS other, count(*) AS n FROM bridge a JOIN bridge b ON a.fact = b.fact AND a.folder <> b.folder GROUP BY a.folder, b.folder),
      r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, other) AS k FROM c) SELECT folder, other, n FROM r WHERE k <= 3"""


@plan
def sentence_max_score(d):
    """Best token overlap between a user turn's and the next turn's sentences."""
    cut = lambda x: d.split(x, "[.!?] *")
    return f"""WITH u AS (SELECT conv_id, turn, {d.tokens('s')} AS t FROM conversations {d.explode(cut('text'), 's')} WHERE role = 'user'), a AS (SELECT conv_id, turn, {d.tokens('s')} AS t FROM conversations {d.explode(cut('text'), 's')} WHERE role = 'assistant')
      SELECT u.conv_id, u.turn, round(max({T.jaccard(d, 'u.t', 'a.t')}), 6) AS score FROM u JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 GROUP BY u.conv_id, u.turn"""


VOTES = values("votes", "item, who, folder", [(i, w, f) for i, w, f in ((1, "w", "home"), (2, "w", "home"), (3, "w", "work"), (4, "w", "work"), (5, "w", "pets"), (1, "a", "house"), (2, "a", "house"), (3, "a", "job"), (4, "a", "job"), (5, "a", "job"), (1, "b", "flat"), (2, "b", "flat"), (3, "b", "flat"), (5, "b", "animals"))])


@plan
def annotator_folder_match(d):
    """Each annotator's folder goes to the writer's folder it overlaps most, from a Jaccard of one third."""
    return f"""WITH {VOTES}, s AS (SELECT who, folder, count(*) AS n FROM votes GROUP BY who, folder),
      o AS (SELECT a.who, a.folder, w.folder AS writer_folder, count(*) AS both_n FROM votes a JOIN votes w ON a.item = w.item AND w.who = 'w' AND a.who <> 'w' GROUP BY a.who, a.folder, w.folder),
      j AS (SELECT o.who, o.folder, o.writer_folder, CAST(o.both_n AS DOUBLE) / (x.n + y.n - o.both_n) AS j FROM o JOIN s x ON x.who = o.who AND x.folder = o.folder JOIN s y ON y.who = 'w' AND y.folder = o.writer_folder),
      r AS (SELECT *, row_number() OVER (PARTITION BY who, folder ORDER BY j DESC, writer_folder) AS k FROM j) SELECT who, folder, writer_folder, round(j, 6) AS j FROM r WHERE k = 1 AND j >= 1.0 / 3"""


@plan
def train_eval_overlap(d):
    return f"""WITH a AS (SELECT DISTINCT w FROM documents {d.explode(d.found('text', '[A-Z][a-z]+'), 'w')} WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT w FROM documents {d.explode(d.found('text', '[A-Z][a-z]+'), 'w')} WHERE doc_id % 2 = 1)
      SELECT count(*) AS shared FROM (SELECT w FROM a INTERSECT SELECT w FROM b) x"""
