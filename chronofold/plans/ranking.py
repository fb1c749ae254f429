"""Search, fusion, prompt selection, vectors and the fact graph (R*, V*, U*)."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.relations import facts, said, values
from .dialect import plan
from .pairs import REPLACES, bridge, features, judged


def lexical(d, k: int = 10) -> str:
    """Turns sharing a stem with the question (the assistant's turn), by coverage, then newest. Stems meet by equality."""
    return f"""st AS (SELECT conv_id, turn, role, {T.stems(d, 'text')} AS s FROM conversations), f AS (SELECT conv_id, turn, w FROM st {d.explode('s', 'w')} WHERE role = 'user'),
      q AS (SELECT conv_id, turn, {d.n('s')} AS n, w FROM st {d.explode('s', 'w')} WHERE role = 'assistant'),
      hits AS (SELECT q.conv_id, q.turn AS question, f.turn, round(CAST(count(*) AS DOUBLE) / max(q.n), 6) AS coverage FROM q JOIN f ON q.conv_id = f.conv_id AND q.w = f.w GROUP BY q.conv_id, q.turn, f.turn),
      lex AS (SELECT conv_id, question, turn, coverage, CAST(row_number() OVER (PARTITION BY conv_id, question ORDER BY coverage DESC, turn DESC) AS BIGINT) AS r FROM hits)"""


def semantic(d) -> str:
    """A stand-in encoder's ranking: similarity of the turns' token sets."""
    return f"""tk AS (SELECT conv_id, turn, role, {d.tokens('text')} AS t FROM conversations), sims AS (SELECT q.conv_id, q.turn AS question, f.turn, round({T.jaccard(d, 'q.t', 'f.t')}, 6) AS sim FROM tk q JOIN tk f ON q.conv_id = f.conv_id AND q.role = 'assistant' AND f.role = 'user'),
      sem AS (SELECT conv_id, question, turn, sim, CAST(row_number() OVER (PARTITION BY conv_id, question ORDER BY sim DESC, turn DESC) AS BIGINT) AS r FROM sims WHERE sim > 0)"""


@plan
def lexical_search(d):
    return f"WITH {lexical(d)} SELECT conv_id, question, turn, coverage, r FROM lex WHERE r <= 10"


@plan
def vector_search(d):
    """Every fiftieth vector asks all others, of any label or none."""
    return f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, round({d.dot('q.embedding', 'v.embedding')}, 6) AS sim FROM q JOIN embeddings v ON q.vec_id <> v.vec_id)
      SELECT query_id, vec_id, sim FROM s WHERE sim >= 0.3"""


@plan
def cosine_topk(d):
    """The ten nearest of all other vectors for every fiftieth vector, then a bounded rank."""
    norm = lambda x: f"sqrt({d.dot(x, x)})"
    return f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, round({d.dot('q.embedding', 'v.embedding')} / ({norm('q.embedding')} * {norm('v.embedding')}), 5) AS sim FROM q JOIN embeddings v ON q.vec_id <> v.vec_id),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS BIGINT) AS r FROM s) SELECT query_id, vec_id, sim, r FROM r WHERE r <= 10"""


@plan
def topk_similarity(d):
    return f"WITH {semantic(d)} SELECT conv_id, question, turn, sim FROM sem WHERE r <= 3"


@plan
def vec_normalise(d):
    unit = d.map("embedding", f"CAST(x AS DOUBLE) / sqrt({d.dot('embedding', 'embedding')})")
    return f"SELECT vec_id, round({d.dot('u', 'u')}, 9) AS norm, round({d.at('u', 1)}, 6) AS first FROM (SELECT vec_id, {unit} AS u FROM embeddings) x"


def fused(d) -> str:
    """Reciprocal ranks of trusted lexical and semantic hits; ties by lexical, then semantic rank."""
    return f"""{lexical(d)}, {semantic(d)}, trusted AS (SELECT conv_id, question, turn, row_number() OVER (PARTITION BY conv_id, question ORDER BY r) AS r FROM lex WHERE coverage >= 0.1),
      merged AS (SELECT coalesce(l.conv_id, s.conv_id) AS conv_id, coalesce(l.question, s.question) AS question, coalesce(l.turn, s.turn) AS turn, l.r AS lr, s.r AS sr, round(coalesce(1e0 / (60 + l.r), 0) + coalesce(1e0 / (60 + s.r), 0), 12) AS score
        FROM trusted l FULL OUTER JOIN sem s ON l.conv_id = s.conv_id AND l.question = s.question AND l.turn = s.turn),
      rest AS (SELECT l.conv_id, l.question, l.turn, l.r FROM lex l LEFT JOIN merged m ON m.conv_id = l.conv_id AND m.question = l.question AND m.turn = l.turn WHERE m.turn IS NULL),
      placed AS (SELECT conv_id, question, turn, 0 AS grp, score, coalesce(lr, 999999) AS a, coalesce(sr, 999999) AS b FROM merged UNION ALL SELECT conv_id, question, turn, 1 AS grp, CAST(0 AS DOUBLE) AS score, r AS a, 0 AS b FROM rest),
      ranked AS (SELECT conv_id, question, turn, grp, CAST(row_number() OVER (PARTITION BY conv_id, question ORDER BY grp, score DESC, a, b, turn) AS BIGINT) AS r FROM placed)"""


@plan
def rrf_fusion(d):
    return f"WITH {fused(d)} SELECT conv_id, question, turn, r FROM ranked"


@plan
def rrf_two_orderings(d):
    """Both orderings are whole and ranks start at zero."""
    return """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS a, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) - 1 AS b FROM documents),
      s AS (SELECT doc_id, lang, round(1.0 / (60 + a) + 1e0 / (60 + b), 12) AS score FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM s) SELECT lang, doc_id, CAST(k AS BIGINT) AS k FROM k WHERE k <= 20"""


def prompt(d, limit: int = 5) -> str:
    """Standing facts: all that bear on safety, then the newest of the others up to ``limit`` in all."""
    return f"""{judged(d)}, gone AS (SELECT DISTINCT bank, old_ord AS ord FROM verdicts WHERE reason IN {REPLACES}),
      c AS (SELECT f.bank, f.ord, f.day, f.text, CASE WHEN f.safety = 1 OR f.topic = 'medication' THEN 1 ELSE 0 END AS safe FROM features f LEFT JOIN gone g ON g.bank = f.bank AND g.ord = f.ord WHERE g.ord IS NULL),
      w AS (SELECT *, sum(safe) OVER (PARTITION BY bank) AS n_safe, row_number() OVER (PARTITION BY bank, safe ORDER BY day DESC, ord DESC) AS k FROM c),
      chosen AS (SELECT bank, ord, day, text, safe FROM w WHERE safe = 1 OR k <= greatest(0, {limit} - n_safe))"""


@plan
def prompt_rows(d):
    return f"WITH {said(d)}, {prompt(d)} SELECT bank, ord, safe FROM chosen"


@plan
def render_prompt(d):
    lines = d.words_of("concat(chr(45), chr(32), text)", "safe DESC, day DESC, ord DESC", line=True)
    return f"WITH {said(d)}, {prompt(d)} SELECT bank, concat('Known facts:', chr(10), {lines}) AS block FROM chosen GROUP BY bank"


@plan
def folder_index_rank(d):
    """Similarity, a folder bonus, a time bonus and a penalty for stale values, added."""
    return f"""WITH {semantic(d)}, n AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), s AS (SELECT x.conv_id, x.question, x.turn, round(x.sim + 0.05 * CASE WHEN x.turn % 2 = x.question % 2 THEN 1 ELSE 0 END + 0.05 * CASE WHEN x.turn >= n.last - 3 THEN 1 ELSE 0 END - 0.05 * CASE WHEN x.turn < 2 THEN 1 ELSE 0 END, 6) AS score FROM sims x JOIN n ON n.conv_id = x.conv_id)
      SELECT conv_id, question, turn, score, CAST(row_number() OVER (PARTITION BY conv_id, question ORDER BY score DESC, turn) AS BIGINT) AS r FROM s"""


@plan
def alive_rank(d):
    return f"WITH {facts(d)}, m AS (SELECT id, bank, slot, CASE WHEN NOT forgotten AND successor IS NULL THEN round(value, 4) ELSE -9 END AS score FROM facts), r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY score DESC, id) AS k FROM m) SELECT bank, id, score, CAST(k AS BIGINT) AS k FROM r WHERE k <= 5"


@plan
def event_anchor_asof(d):
    """'Before I signed up': the day before the bank's largest purchase, the earliest of equal ones; then what stood in each slot.

    DuckDB's ``arg_max`` takes the first that it meets, which depends on its threads where the table is large.
    """
    earliest = "max_by(created_at, struct(value, -datediff(created_at, DATE '1970-01-01'))) FILTER (WHERE value IS NOT NULL AND created_at IS NOT NULL)"
    largest = d.of(earliest, d.max_by("created_at", "value"))
    return f"""WITH {facts(d)}, anchor AS (SELECT bank, {d.add_days(f'CAST({largest} AS DATE)', -1)} AS day FROM facts WHERE slot = 'purchase' GROUP BY bank)
      SELECT f.bank, f.slot, {d.max_by('f.id', d.pair('f.created_at', 'f.id'))} AS id FROM facts f JOIN anchor a ON a.bank = f.bank WHERE CAST(f.created_at AS DATE) <= a.day AND NOT f.forgotten GROUP BY f.bank, f.slot"""


@plan
def slot_first_order(d):
    """Same slot newest first, then same actor, then the rest."""
    return f"""WITH {said(d)}, {features(d)}, p AS (SELECT n.bank, n.ord AS new_ord, o.ord AS old_ord, CASE WHEN n.topic = o.topic THEN 0 WHEN n.actor = o.actor THEN 1 ELSE 2 END AS grp FROM features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord)
      SELECT bank, new_ord, old_ord, grp, CAST(row_number() OVER (PARTITION BY bank, new_ord ORDER BY grp, old_ord DESC) AS BIGINT) AS r FROM p"""


@plan
def verifier_plan(d):
    return f"""WITH {said(d)}, {features(d)}, p AS (SELECT n.bank, n.ord AS new_ord, o.ord AS old_ord, round({T.jaccard(d, 'n.t', 'o.t')}, 6) AS sim FROM features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord AND n.actor = o.actor AND n.kind = 'fact' AND o.kind = 'fact'),
      r AS (SELECT *, row_number() OVER (PARTITION BY bank, new_ord ORDER BY sim DESC, old_ord) AS k FROM p WHERE sim >= 0.15) SELECT bank, new_ord, old_ord, sim, CAST(k AS BIGINT) AS k FROM r WHERE k <= 4"""


@plan
def folder_candidates(d):
    """The speaker's folder first, then named ones, then the most frequent; eight at most."""
    return f"""WITH {bridge(d)}, n AS (SELECT folder, count(*) AS n FROM bridge GROUP BY folder), o AS (SELECT b.fact, b.folder, CASE WHEN b.folder % 10 = 0 THEN 0 WHEN b.folder % 10 < 4 THEN 1 ELSE 2 END AS grp, n.n FROM bridge b JOIN n ON n.folder = b.folder),
      r AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY grp, n DESC, folder) AS k FROM o) SELECT fact, folder, CAST(k AS BIGINT) AS k FROM r WHERE k <= 8"""


@plan
def context_window(d):
    return "SELECT conv_id, turn, lag(turn, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS back1, lag(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS back2 FROM conversations"


@plan
def names_so_far(d):
    """How many different capitalised words each conversation has used up to each turn: first uses, summed."""
    return f"""WITH w AS (SELECT conv_id, w, min(turn) AS turn FROM conversations {d.explode(d.found('text', '[A-Z][a-z]+'), 'w')} GROUP BY conv_id, w), n AS (SELECT conv_id, turn, count(*) AS fresh FROM w GROUP BY conv_id, turn)
      SELECT c.conv_id, c.turn, CAST(sum(coalesce(n.fresh, 0)) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS names FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn"""


@plan
def walk_bundle(d):
    """Seeds, then what shares a folder with them, then the rest; a fact keeps its first place."""
    return f"""WITH {bridge(d)}, seeds AS (SELECT DISTINCT fact FROM bridge WHERE fact % 50 = 0), near AS (SELECT DISTINCT b.fact FROM seeds s JOIN bridge a ON a.fact = s.fact JOIN bridge b ON b.folder = a.folder),
      u AS (SELECT fact, 0 AS grp FROM seeds UNION ALL SELECT fact, 1 AS grp FROM near UNION ALL SELECT fact, 2 AS grp FROM bridge) SELECT fact, min(grp) AS grp FROM u GROUP BY fact"""


@plan
def edges_correct(d):
    return f"WITH {facts(d)}, t AS (SELECT id AS old_id, superseded_by AS new_id FROM facts WHERE superseded_by IS NOT NULL), p AS (SELECT id AS old_id, successor AS new_id FROM facts WHERE successor IS NOT NULL) SELECT old_id, new_id FROM t INTERSECT SELECT old_id, new_id FROM p"


@plan
def discordant_pairs(d):
    return f"WITH {facts(d)}, t AS (SELECT id AS old_id, superseded_by AS new_id FROM facts WHERE superseded_by IS NOT NULL), p AS (SELECT id AS old_id, successor AS new_id FROM facts WHERE successor IS NOT NULL) SELECT 'truth' AS side, old_id, new_id FROM (SELECT * FROM t EXCEPT SELECT * FROM p) x UNION ALL SELECT 'predicted' AS side, old_id, new_id FROM (SELECT * FROM p EXCEPT SELECT * FROM t) y"


@plan
def pad_store(d):
    """Other banks' facts fill each store up to a size, in the order of a seeded hash."""
    txt = f"CAST(doc_id AS {d.of('STRING', 'VARCHAR')})"
    return f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('pad:', {txt})), doc_id) AS k FROM documents) SELECT source, doc_id, CAST(k AS BIGINT) AS k FROM r WHERE k <= 5"


@plan
def training_rows(d):
    """Soft targets: the gold class gets what the four others leave."""
    return f"WITH {said(d)}, {features(d)} SELECT n.bank, n.ord AS new_ord, o.ord AS old_ord, CASE WHEN n.topic = o.topic THEN 1e0 ELSE 0e0 END AS replaces, CASE WHEN n.topic = o.topic THEN 0e0 ELSE 25e-2 END AS each_other FROM features n JOIN features o ON n.bank = o.bank AND o.ord < n.ord"


@plan
def soft_cap(d):
    txt = f"CAST(doc_id AS {d.of('STRING', 'VARCHAR')})"
    return f"WITH n AS (SELECT count(*) AS n FROM labels WHERE toxic = 1), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('soft:', {txt})), doc_id) AS k FROM labels WHERE toxic = 0) SELECT r.doc_id FROM r, n WHERE r.k <= 2 * n.n"


@plan
def verdict_parse(d):
    """A judge's JSON reply and its token log-probabilities become one relation and its probability."""
    rows = values("replies", "id, reply, a, b", [(1, '{"relation":"replaces","k":1}', -0.1, -2.5), (2, '{"relation":"adds_detail","k":2}', -0.7, -0.9), (3, "no json here", -1.0, -1.0), (4, '{"relation":"unrelated"}', -0.01, -5.0)])
    rel = d.of("get_json_object(reply, '$.relation')", "CASE WHEN json_valid(reply) THEN json_extract_string(reply, '$.relation') END")
    return f"WITH {rows} SELECT CAST(id AS BIGINT) AS id, {rel} AS relation, round(CAST(exp(a) AS DOUBLE) / (exp(a) + exp(b)), 6) AS p FROM replies"


@plan
def fact_graph_edges(d):
    """Facts and the nodes they touch (topic, actor, anchors), with node weights ln(1 + N / df)."""
    return f"""WITH {said(d)}, {features(d)}, e AS (SELECT bank, ord, concat('topic:', topic) AS node FROM features WHERE topic IS NOT NULL UNION SELECT bank, ord, concat('kin:', actor) FROM features WHERE actor <> 'user' UNION SELECT bank, ord, concat('word:', w) FROM features {d.explode('anchors', 'w')}),
      n AS (SELECT bank, count(*) AS n FROM features GROUP BY bank), f AS (SELECT bank, node, count(*) AS df FROM e GROUP BY bank, node) SELECT e.bank, e.ord, e.node, round(ln(1 + CAST(n.n AS DOUBLE) / f.df), 6) AS weight FROM e JOIN f ON f.bank = e.bank AND f.node = e.node JOIN n ON n.bank = e.bank"""
