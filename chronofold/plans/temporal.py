"""Scans, snapshots and lifecycle of dated facts (S*, L6-L16, J5, J9, J10, J13, R10)."""

from __future__ import annotations

from ..sources.relations import ONE_VALUE, facts
from .dialect import plan


@plan
def slot_asof(d):
    """Newest value of each one-value slot per bank at the end of 2024-01-15: one partial-aggregated group."""
    return f"""WITH {facts(d)} SELECT bank, slot, {d.max_by('value', d.pair('created_at', 'id'))} AS value, {d.max_by('id', d.pair('created_at', 'id'))} AS id FROM facts
      WHERE created_at <= {d.ts('2024-01-15 23:59:59')} AND slot IN {ONE_VALUE} AND NOT forgotten GROUP BY bank, slot"""


@plan
def live_facts(d):
    return f"""WITH {facts(d)} SELECT id, bank, slot, value, successor FROM facts WHERE NOT forgotten AND slot = 'purchase' ORDER BY created_at DESC, id LIMIT 500"""


@plan
def active_facts(d):
    return f"WITH {facts(d)} SELECT id, bank, slot, kind FROM facts WHERE NOT forgotten AND successor IS NULL"


@plan
def scan_with_retired(d):
    return f"WITH {facts(d)} SELECT id, slot, successor, CASE WHEN successor IS NULL THEN 0 ELSE 1 END AS retired FROM facts WHERE NOT forgotten"


@plan
def newest_facts(d):
    return "SELECT event_id AS id, event_type AS slot FROM events WHERE event_id % 7 <> 0 ORDER BY ts DESC, event_id LIMIT 100"


@plan
def fact_by_id(d):
    return f"WITH {facts(d)} SELECT id, bank, slot, value, successor FROM facts WHERE id = 41"


@plan
def hydrate_ranked(d):
    return """WITH ranked AS (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events ORDER BY value DESC, event_id LIMIT 50)
      SELECT CAST(ranked.r AS BIGINT) AS r, e.event_id AS id, e.event_type AS slot, e.value FROM ranked JOIN events e ON e.event_id = ranked.id"""


@plan
def effective_successor(d):
    return f"WITH {facts(d)} SELECT id, superseded_by, successor FROM facts WHERE superseded_by IS NOT NULL"


@plan
def as_of_snapshot(d):
    """Facts that stood at noon of 2024-01-15: written by then, and not yet replaced by a standing one."""
    t = d.ts("2024-01-15 12:00:00")
    return f"""WITH {facts(d)} SELECT id, bank, slot, value FROM facts WHERE NOT forgotten AND created_at <= {t} AND (successor_at IS NULL OR successor_at > {t})"""


@plan
def chain_head(d):
    """The standing end of each retired fact's chain, in window form."""
    return f"""WITH {facts(d)}, heads AS (SELECT bank, slot, {d.max_by('id', 'struct_key')} AS head FROM (SELECT *, {d.of("struct(created_at, id)", "{'a': created_at, 'b': id}")} AS struct_key FROM facts WHERE NOT forgotten AND slot IN {ONE_VALUE}) k GROUP BY bank, slot)
      SELECT f.id, h.head FROM facts f JOIN heads h ON f.bank = h.bank AND f.slot = h.slot WHERE NOT f.forgotten AND f.successor IS NOT NULL"""


@plan
def forget(d):
    """After forgetting all purchases above 100: rows per state."""
    return f"""WITH {facts(d)} SELECT slot, count(*) AS n, sum(CASE WHEN forgotten OR (slot = 'purchase' AND value > 100) THEN 1 ELSE 0 END) AS forgotten FROM facts GROUP BY slot"""


@plan
def restore(d):
    """Facts that come back when the forgotten are restored, and the successor that each then has."""
    return f"WITH {facts(d)} SELECT id, bank, slot, superseded_by AS successor FROM facts WHERE forgotten"


@plan
def update_fact(d):
    """An edit moves each 13th fact to the slot 'view'; slots are judged anew, so chains close over the gap."""
    return f"""WITH e AS (SELECT event_id AS id, user_id AS bank, CASE WHEN event_id % 13 = 0 THEN 'view' ELSE event_type END AS slot, ts FROM events)
      SELECT id, slot, CASE WHEN slot IN {ONE_VALUE} THEN lead(id) OVER (PARTITION BY bank, slot ORDER BY ts, id) END AS successor FROM e"""


@plan
def rejudge(d):
    """Old and new neighbours of each edited fact: who is un-retired and who is newly retired."""
    return f"""WITH a AS (SELECT event_id AS id, CASE WHEN event_type IN {ONE_VALUE} THEN lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS before FROM events),
      e AS (SELECT event_id AS id, user_id AS bank, CASE WHEN event_id % 13 = 0 THEN 'signup' ELSE event_type END AS slot, ts FROM events),
      b AS (SELECT id, CASE WHEN slot IN {ONE_VALUE} THEN lead(id) OVER (PARTITION BY bank, slot ORDER BY ts, id) END AS after FROM e)
      SELECT a.id, a.before, b.after FROM a JOIN b ON a.id = b.id WHERE a.before IS DISTINCT FROM b.after"""


@plan
def recheck_conflicts(d):
    """Dry run: standing facts that the slot rule would retire."""
    return f"""WITH {facts(d)}, s AS (SELECT id, bank, slot, created_at FROM facts WHERE NOT forgotten),
      r AS (SELECT id, lead(id) OVER (PARTITION BY bank, slot ORDER BY created_at, id) AS replaced_by, slot FROM s)
      SELECT id, replaced_by FROM r WHERE slot IN {ONE_VALUE} AND replaced_by IS NOT NULL"""


@plan
def apply_verified(d):
    """Verdicts apply only if both facts still stand, the old one is not newer, and it has no successor yet."""
    return f"""WITH {facts(d)}, verdicts AS (SELECT id AS old_id, id + 10 AS new_id FROM facts WHERE id % 10 = 3)
      SELECT v.old_id, v.new_id, CAST(n.created_at AS DATE) AS retired_on FROM verdicts v JOIN facts o ON o.id = v.old_id JOIN facts n ON n.id = v.new_id
      WHERE NOT o.forgotten AND NOT n.forgotten AND o.successor IS NULL AND o.created_at <= n.created_at"""


@plan
def stats(d):
    return f"""WITH {facts(d)} SELECT coalesce(slot, 'uncategorised') AS category, count(*) AS total, sum(CASE WHEN forgotten THEN 1 ELSE 0 END) AS forgotten,
      sum(CASE WHEN NOT forgotten AND successor IS NULL THEN 1 ELSE 0 END) AS standing FROM facts GROUP BY coalesce(slot, 'uncategorised')"""


@plan
def days_in_span(d):
    spans = "spans AS (SELECT * FROM (VALUES (1, DATE '2024-01-03', DATE '2024-01-05'), (2, DATE '2024-01-10', DATE '2024-01-10'), (3, DATE '2024-01-20', DATE '2024-01-26')) AS v(span, lo, hi))"
    return f"WITH {spans} SELECT CAST(span AS BIGINT) AS span, event_id AS id FROM spans JOIN events ON CAST(ts AS DATE) BETWEEN lo AND hi"


@plan
def slot_stale_mark(d):
    return f"""WITH {facts(d)} SELECT id, bank, slot, CASE WHEN slot IN {ONE_VALUE} AND CAST(created_at AS DATE) < max(CAST(created_at AS DATE)) OVER (PARTITION BY bank, slot) THEN 1 ELSE 0 END AS stale FROM facts"""


@plan
def slot_supersession(d):
    return f"""WITH {facts(d)} SELECT id AS old_id, superseded_by AS new_id FROM facts WHERE superseded_by IS NOT NULL"""


@plan
def order_asof_shipment(d):
    """As-of join at scale: the customer's latest order by each ship date's start of month, on equi-keys and one window."""
    return f"""WITH o AS (SELECT o_custkey AS bank, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 0 AS asks FROM orders),
      q AS (SELECT DISTINCT o_custkey AS bank, CAST(NULL AS BIGINT) AS id, DATE '1996-01-01' AS day, 1 AS asks FROM orders),
      u AS (SELECT * FROM o UNION ALL SELECT * FROM q),
      w AS (SELECT bank, asks, {d.last_known('id', 'PARTITION BY bank ORDER BY day, asks, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS latest FROM u)
      SELECT bank, latest FROM w WHERE asks = 1"""


@plan
def category_default(d):
    return "SELECT event_id AS id, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE 'personal' END AS category FROM events"


@plan
def backfill_topics(d):
    """Rows without a topic get one; the others keep theirs, '' included."""
    return """WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE 'kept' END AS topic, event_type FROM events)
      SELECT id, topic, 0 AS filled FROM t WHERE topic IS NOT NULL UNION ALL SELECT id, event_type AS topic, 1 AS filled FROM t WHERE topic IS NULL"""


@plan
def verification_log(d):
    return f"""WITH {facts(d)} SELECT id AS new_id, superseded_by AS old_id, CASE WHEN value > 50 THEN 'replaces' ELSE 'adds_detail' END AS relation, round(value / 100, 4) AS confidence,
      CASE WHEN value > 50 THEN 1 ELSE 0 END AS applied FROM facts WHERE superseded_by IS NOT NULL"""


@plan
def parse_multi_format_date(d):
    rows = "(VALUES (1, '2025-03-01'), (2, '2025/04/02'), (3, '03.05.2025'), (4, '2025-06-07 10:11:12'), (5, 'unknown')) AS v(id, stamp)"
    if d.spark:
        return f"SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(try_to_timestamp(stamp, 'yyyy-MM-dd'), try_to_timestamp(stamp, 'yyyy/MM/dd'), try_to_timestamp(stamp, 'dd.MM.yyyy'), try_to_timestamp(stamp, 'yyyy-MM-dd HH:mm:ss')) AS DATE) AS day FROM {rows}"
    return f"SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(try_strptime(stamp, '%Y-%m-%d'), try_strptime(stamp, '%Y/%m/%d'), try_strptime(stamp, '%d.%m.%Y'), try_strptime(stamp, '%Y-%m-%d %H:%M:%S')) AS DATE) AS day FROM {rows}"


@plan
def synthetic_corpus(d):
    """Seeded facts in time order: the template and its fill are drawn by md5, equal in every engine."""
    pick = "CAST(CASE WHEN substr(md5(concat('corpus:', CAST(i AS STRING))), 1, 1) < '8' THEN 0 ELSE 1 END AS BIGINT)" if d.spark else "CAST(CASE WHEN substr(md5(concat('corpus:', CAST(i AS VARCHAR))), 1, 1) < '8' THEN 0 ELSE 1 END AS BIGINT)"
    return f"""WITH n AS (SELECT i FROM (SELECT 1 AS one) s {d.explode(d.series(0, 999), 'i')})
      SELECT i AS id, {d.add_days("DATE '2024-01-01'", 'i % 365')} AS day, CASE WHEN {pick} = 0 THEN concat('I live in town ', CAST(i % 17 AS {d.of('STRING', 'VARCHAR')})) ELSE concat('My favourite number is ', CAST(i % 29 AS {d.of('STRING', 'VARCHAR')})) END AS text FROM n"""
