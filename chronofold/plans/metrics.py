"""Evaluation (A*): ranking, edge and classification metrics, intervals, tests and votes."""

from __future__ import annotations

from ..sources.relations import facts
from .dialect import plan
from .pairs import VOTES, bridge
from .ranking import lexical, semantic

PRED = """pred AS (SELECT doc_id, CAST(quality AS BIGINT) AS y, CAST(toxic AS BIGINT) AS hard, round(((doc_id * 37) % 100 + 60 * quality) / 16e1, 4) AS p, round(((doc_id * 61) % 100 + 40 * quality) / 14e1, 4) AS q FROM labels)"""


def graded(d) -> str:
    """Each question's gold turn is the user turn right before it; its place in the semantic ranking."""
    return f"""{semantic(d)}, gold AS (SELECT q.conv_id, q.turn AS question, max(u.turn) AS turn, CASE WHEN q.turn % 2 = 0 THEN 'even' ELSE 'odd' END AS type FROM conversations q JOIN conversations u ON u.conv_id = q.conv_id AND u.turn < q.turn AND u.role = 'user' WHERE q.role = 'assistant' GROUP BY q.conv_id, q.turn),
      graded AS (SELECT g.conv_id, g.question, g.type, s.r FROM gold g LEFT JOIN sem s ON s.conv_id = g.conv_id AND s.question = g.question AND s.turn = g.turn)"""


@plan
def topk_metrics(d):
    """Top-1, top-3 and recall at 10 per question type and for all: one rollup."""
    avg = lambda k: f"round(avg(CASE WHEN r <= {k} THEN 1e0 ELSE 0e0 END), 6)"
    return f"WITH {graded(d)} SELECT coalesce(type, 'all') AS type, count(*) AS n, {avg(1)} AS top1, {avg(3)} AS top3, {avg(10)} AS recall10 FROM graded GROUP BY ROLLUP (type)"


@plan
def multi_recall(d):
    """All parts of an order among its customer's first k + 2 parts; the share found; empty answers."""
    return f"""WITH w AS (SELECT l_orderkey AS id, l_partkey AS part FROM lineitem), got AS (SELECT id, part FROM (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY part) AS k FROM w) x WHERE k <= 3),
      s AS (SELECT w.id, count(DISTINCT w.part) AS wanted, count(DISTINCT got.part) AS found FROM w LEFT JOIN got ON got.id = w.id AND got.part = w.part GROUP BY w.id)
      SELECT count(*) AS n, round(avg(CASE WHEN found = wanted THEN 1e0 ELSE 0e0 END), 6) AS all_found, round(avg(CAST(found AS DOUBLE) / wanted), 6) AS share, sum(CASE WHEN found = 0 THEN 1 ELSE 0 END) AS empty FROM s"""


@plan
def supersession_score(d):
    return f"""WITH {facts(d)}, j AS (SELECT id, superseded_by AS t, successor AS p FROM facts WHERE superseded_by IS NOT NULL OR successor IS NOT NULL)
      SELECT count(t) AS truth, count(p) AS predicted, sum(CASE WHEN t = p THEN 1 ELSE 0 END) AS caught, sum(CASE WHEN t <> p THEN 1 ELSE 0 END) AS wrong_successor, sum(CASE WHEN t IS NOT NULL AND p IS NULL THEN 1 ELSE 0 END) AS missed, sum(CASE WHEN t IS NULL AND p IS NOT NULL THEN 1 ELSE 0 END) AS wrongly_retired FROM j"""


@plan
def pr_f1(d):
    """Precision, recall and F1 at eleven thresholds; the best one marked."""
    return f"""WITH {PRED}, t AS (SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM (SELECT 1 AS one) s {d.explode(d.series(0, 10), 'i')}),
      h AS (SELECT CAST(floor(p * 10) AS BIGINT) AS cell, sum(y) AS pos, count(*) AS n FROM pred GROUP BY CAST(floor(p * 10) AS BIGINT)),
      c AS (SELECT threshold, sum(CASE WHEN cell >= threshold * 10 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN cell >= threshold * 10 THEN n ELSE 0 END) AS flagged, sum(pos) AS pos FROM t CROSS JOIN h GROUP BY threshold),
      m AS (SELECT threshold, CASE WHEN flagged > 0 THEN CAST(tp AS DOUBLE) / flagged ELSE 0 END AS prec, CAST(tp AS DOUBLE) / pos AS rec, CASE WHEN flagged + pos > 0 THEN 2.0 * CAST(tp AS DOUBLE) / (flagged + pos) ELSE 0 END AS f1 FROM c)
      SELECT threshold, round(prec, 6) AS prec, round(rec, 6) AS rec, round(f1, 6) AS f1, CASE WHEN round(f1, 6) = max(round(f1, 6)) OVER () THEN 1 ELSE 0 END AS best FROM m"""


@plan
def average_precision(d):
    """Scores are grouped first, so the running sums go over distinct scores, not rows."""
    return f"""WITH {PRED}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM pred GROUP BY p), c AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS total FROM g)
      SELECT round(sum(CAST(tp AS DOUBLE) / seen * pos / total), 6) AS average_precision FROM c"""


def wilson(k: str, n: str, sign: str) -> str:
    z = "1.96"
    return f"round(({k} / {n} + {z} * {z} / (2 * {n}) {sign} {z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n}), 6)"


@plan
def wilson_interval(d):
    return f"WITH s AS (SELECT d.lang, CAST(sum(l.quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang) SELECT lang, n, round(k / n, 6) AS share, {wilson('k', 'n', '-')} AS lo, {wilson('k', 'n', '+')} AS hi FROM s"


@plan
def mcnemar(d):
    """Two classifiers on the same rows: discordant counts and the exact two-sided binomial tail, via log factorials."""
    return f"""WITH {PRED}, s AS (SELECT CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS a, CASE WHEN (q >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS b FROM pred),
      c AS (SELECT sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS c FROM s), n AS (SELECT b, c, b + c AS n, least(b, c) AS k FROM c),
      f AS (SELECT i, sum(ln(CAST(greatest(i, 1) AS DOUBLE))) OVER (ORDER BY i) AS lf FROM n {d.explode(d.series(0, 'n.n'), 'i')}),
      t AS (SELECT n.b, n.c, sum(exp(fn.lf - fi.lf - fk.lf - n.n * ln(CAST(2 AS DOUBLE)))) AS tail FROM n JOIN f fn ON fn.i = n.n JOIN f fi ON fi.i <= n.k JOIN f fk ON fk.i = n.n - fi.i GROUP BY n.b, n.c)
      SELECT CAST(b AS BIGINT) AS only_a, CAST(c AS BIGINT) AS only_b, round(least(1.0, 2 * tail), 6) AS p_value FROM t"""


@plan
def ece(d):
    return f"""WITH {PRED}, b AS (SELECT least(9, CAST(floor(p * 10) AS INT)) AS bin, count(*) AS n, avg(CAST(y AS DOUBLE)) AS rate, avg(p) AS conf FROM pred GROUP BY least(9, CAST(floor(p * 10) AS INT)))
      SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(rate - conf)) / sum(n), 6) AS ece FROM b"""


@plan
def escalation_curve(d):
    return f"""WITH {PRED}, bands AS (SELECT CAST(i AS DOUBLE) / 20 AS band FROM (SELECT 1 AS one) s {d.explode(d.series(0, 8), 'i')}), h AS (SELECT round(abs(p - 0.5), 4) AS gap, count(*) AS n, sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 0 ELSE 1 END) AS wrong FROM pred GROUP BY round(abs(p - 0.5), 4))
      SELECT band, CAST(sum(CASE WHEN gap >= band THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gap < band THEN n ELSE 0 END) AS BIGINT) AS escalated, CAST(sum(CASE WHEN gap >= band THEN wrong ELSE 0 END) AS BIGINT) AS errors FROM bands CROSS JOIN h GROUP BY band"""


@plan
def supervisor_policies(d):
    w = lambda e: f"sum(CASE WHEN ({e}) = (y = 1) THEN 0 ELSE 1 END)"
    return f"WITH {PRED} SELECT count(*) AS n, {w('p >= 0.5')} AS model_errors, {w('q >= 0.5')} AS override_errors, {w('p >= 0.5 AND q >= 0.5')} AS veto_errors, {w('CASE WHEN q >= 0.95 OR q <= 0.05 THEN q >= 0.5 ELSE p >= 0.5 END')} AS sure_errors FROM pred"


@plan
def latency_percentiles(d):
    """Median, and the value at place floor(0.95 n): both from one ordering per type."""
    return """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
      SELECT event_type, max(n) AS n, round(avg(CASE WHEN 2 * k BETWEEN n AND n + 2 AND (n % 2 = 0 OR 2 * k = n + 1) THEN value END), 6) AS p50, round(max(CASE WHEN k = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1) THEN value END), 6) AS p95 FROM r GROUP BY event_type"""


@plan
def majority_vote(d):
    """Two of three; where all differ the writer's value stands."""
    return f"""WITH {VOTES}, m AS (SELECT item, who, CASE folder WHEN 'house' THEN 'home' WHEN 'flat' THEN 'home' WHEN 'job' THEN 'work' WHEN 'animals' THEN 'pets' ELSE folder END AS v FROM votes), c AS (SELECT item, v, count(*) AS n, max(CASE WHEN who = 'w' THEN 1 ELSE 0 END) AS writer FROM m GROUP BY item, v),
      r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN n >= 2 THEN n ELSE 0 END DESC, writer DESC, v) AS k FROM c) SELECT CAST(item AS BIGINT) AS item, v AS winner, n FROM r WHERE k = 1"""


@plan
def agreement_rates(d):
    return f"""WITH {VOTES}, m AS (SELECT item, max(CASE WHEN who = 'w' THEN v END) AS w, max(CASE WHEN who = 'a' THEN v END) AS a, max(CASE WHEN who = 'b' THEN v END) AS b FROM (SELECT item, who, CASE folder WHEN 'house' THEN 'home' WHEN 'flat' THEN 'home' WHEN 'job' THEN 'work' WHEN 'animals' THEN 'pets' ELSE folder END AS v FROM votes) x GROUP BY item)
      SELECT round(avg(CASE WHEN w = a THEN 1e0 ELSE 0e0 END), 6) AS writer_a, round(avg(CASE WHEN w = b THEN 1e0 ELSE 0e0 END), 6) AS writer_b, round(avg(CASE WHEN w = a AND a = b THEN 1e0 ELSE 0e0 END), 6) AS all_three, round(avg(CASE WHEN w = a OR w = b OR a = b THEN 1e0 ELSE 0e0 END), 6) AS two_of_three FROM m"""


@plan
def candidate_reach(d):
    """Of the true replacements, how many are among a bank's last k facts of the slot, and how large that set is."""
    return f"""WITH {facts(d)}, n AS (SELECT id, bank, row_number() OVER (PARTITION BY bank ORDER BY created_at, id) AS k FROM facts), e AS (SELECT o.k AS old_k, s.k AS new_k FROM facts f JOIN n o ON o.id = f.id JOIN n s ON s.id = f.superseded_by)
      SELECT b.k AS k, round(avg(CASE WHEN e.new_k - e.old_k <= b.k THEN 1e0 ELSE 0e0 END), 6) AS reach, round(avg(CAST(least(b.k, e.new_k - 1) AS DOUBLE)), 6) AS size FROM e CROSS JOIN (SELECT i AS k FROM (SELECT 1 AS one) s {d.explode(d.series(1, 15), 'i')}) b GROUP BY b.k"""


@plan
def changes_budget_curve(d):
    return f"""WITH {facts(d)}, n AS (SELECT id, row_number() OVER (PARTITION BY bank ORDER BY created_at, id) AS k FROM facts), e AS (SELECT s.k - o.k AS dist FROM facts f JOIN n o ON o.id = f.id JOIN n s ON s.id = f.superseded_by)
      SELECT count(*) AS n, round(avg(CASE WHEN dist <= 1 THEN 1e0 ELSE 0e0 END), 6) AS b1, round(avg(CASE WHEN dist <= 3 THEN 1e0 ELSE 0e0 END), 6) AS b3, round(avg(CASE WHEN dist <= 5 THEN 1e0 ELSE 0e0 END), 6) AS b5, round(avg(CASE WHEN dist <= 10 THEN 1e0 ELSE 0e0 END), 6) AS b10, round(avg(CASE WHEN dist <= 15 THEN 1e0 ELSE 0e0 END), 6) AS b15 FROM e"""


@plan
def bundle_coverage(d):
    """Share of questions whose gold turn lies within a token budget, by budget and type."""
    return f"""WITH {graded(d)}, c AS (SELECT s.conv_id, s.question, s.turn, sum(ceil(length(t.text) / 4.0)) OVER (PARTITION BY s.conv_id, s.question ORDER BY s.r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM sem s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn),
      b AS (SELECT i * 150 AS budget FROM (SELECT 1 AS one) s {d.explode(d.series(1, 4), 'i')}), j AS (SELECT g.type, c.spent FROM gold g LEFT JOIN c ON c.conv_id = g.conv_id AND c.question = g.question AND c.turn = g.turn)
      SELECT b.budget, j.type, round(avg(CASE WHEN j.spent <= b.budget THEN 1e0 ELSE 0e0 END), 6) AS covered FROM j CROSS JOIN b GROUP BY b.budget, j.type"""


@plan
def miss_taxonomy(d):
    return f"WITH {graded(d)} SELECT CASE WHEN r = 1 THEN 'hit' WHEN r IS NULL THEN 'no_word_shared' WHEN r <= 3 THEN 'near_miss' WHEN r <= 10 THEN 'ranked_low' ELSE 'far' END AS outcome, count(*) AS n FROM graded GROUP BY 1" if not d.spark else f"WITH {graded(d)}, o AS (SELECT CASE WHEN r = 1 THEN 'hit' WHEN r IS NULL THEN 'no_word_shared' WHEN r <= 3 THEN 'near_miss' WHEN r <= 10 THEN 'ranked_low' ELSE 'far' END AS outcome FROM graded) SELECT outcome, count(*) AS n FROM o GROUP BY outcome"


@plan
def identity_confusion(d):
    """Who-is-who errors by language and by fold: grouping sets over one pass."""
    return f"""WITH {PRED}, x AS (SELECT d.lang, CASE WHEN l.doc_id % 5 = 0 THEN 'held_out' ELSE 'seen' END AS split, l.y, CASE WHEN l.p >= 0.5 THEN 1 ELSE 0 END AS z FROM pred l JOIN documents d ON d.doc_id = l.doc_id)
      SELECT lang, split, sum(CASE WHEN y = 0 AND z = 1 THEN 1 ELSE 0 END) AS false_link, sum(CASE WHEN y = 1 AND z = 0 THEN 1 ELSE 0 END) AS missed_link, sum(CASE WHEN y = 1 AND z = 1 THEN 1 ELSE 0 END) AS both_link, count(*) AS n FROM x GROUP BY GROUPING SETS ((lang), (lang, split))"""


@plan
def regression_gate(d):
    """Types whose rate fell by more than two points against the baseline half of the month."""
    return f"""WITH r AS (SELECT event_type, avg(CASE WHEN ts < {d.ts('2024-01-16 00:00:00')} AND value > 50 THEN 1e0 WHEN ts < {d.ts('2024-01-16 00:00:00')} THEN 0e0 END) AS base, avg(CASE WHEN ts >= {d.ts('2024-01-16 00:00:00')} AND value > 50 THEN 1e0 WHEN ts >= {d.ts('2024-01-16 00:00:00')} THEN 0e0 END) AS now FROM events GROUP BY event_type)
      SELECT event_type, round(base, 6) AS base, round(now, 6) AS now, CASE WHEN now < base - 0.02 THEN 1 ELSE 0 END AS failed FROM r"""


@plan
def verdict_histogram(d):
    return """SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS user_turns, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS assistant_turns, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS system_turns, round(avg(CAST(ceil(length(text) / 4.0) AS DOUBLE)), 6) AS tokens FROM conversations GROUP BY conv_id"""


@plan
def entity_idf(d):
    return f"WITH {bridge(d)}, n AS (SELECT count(DISTINCT fact) AS n FROM bridge) SELECT b.folder, count(*) AS df, round(CASE WHEN n.n > 1 THEN ln(CAST(n.n AS DOUBLE) / count(*)) / ln(CAST(n.n AS DOUBLE)) ELSE 0 END, 6) AS idf FROM bridge b, n GROUP BY b.folder, n.n"
