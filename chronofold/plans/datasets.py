"""Folders, indexes, data quality and dataset builders (E*, Q*, 2.15)."""

from __future__ import annotations

from ..functions import text as T
from ..sources.relations import asked, facts, said, values
from .dialect import plan
from .pairs import REPLACES, features, judged

FILED = values("filed", "bank, fact, folder, slot", [(1, 1, "f1", "home"), (1, 2, "f2", "home"), (1, 3, "f1", "home"), (1, 4, "f9", "manager"), (1, 6, "f1", "medication"), (2, 1, "f1", "colour"), (2, 2, "f1", None), (2, 4, "f3", "deadline"), (3, 1, "f1", "pet"), (3, 9, "f2", "person")])
FOLDERS = values("folders", "bank, folder, name, kind, alias", [(1, "f1", "speaker", "speaker", "I"), (1, "f2", "Vera", "person", "my sister"), (2, "f1", "speaker", "speaker", "I"), (2, "f3", "Apollo", "thing", "Apollo"), (3, "f1", "speaker", "speaker", "I"), (3, "f2", "Tom", "person", "my boyfriend"), (3, "f2", "Tom", "person", "Tom")])
MERGED = values("merged", "bank, folder, into_folder", [(3, "f5", "f2"), (3, "f6", "f5"), (1, "f7", "f2"), (2, "f8", "f9"), (2, "f9", "f8")])


@plan
def filing_violations(d):
    return f"""WITH {said(d)}, {FILED}, {FOLDERS}, k AS (SELECT DISTINCT bank, folder FROM folders) SELECT CAST(s.bank AS BIGINT) AS bank, CAST(s.ord AS BIGINT) AS fact, 'not_filed' AS rule FROM said s LEFT JOIN filed f ON f.bank = s.bank AND f.fact = s.ord WHERE f.fact IS NULL
      UNION ALL SELECT CAST(f.bank AS BIGINT), CAST(f.fact AS BIGINT), 'unknown_folder' FROM filed f LEFT JOIN k ON k.bank = f.bank AND k.folder = f.folder WHERE k.folder IS NULL UNION ALL SELECT CAST(bank AS BIGINT), CAST(fact AS BIGINT), 'no_slot' FROM filed WHERE slot IS NULL"""


@plan
def filing_merge(d):
    """New aliases join the old ones; a slot's first writer decides, 'many' wins over 'one'."""
    new = values("fresh", "bank, folder, alias, holds", [(3, "f2", "Tommy", "one"), (3, "f2", "Tom", "many"), (1, "f2", "Vee", "one"), (2, "f4", "Hermes", "one")])
    return f"""WITH {FOLDERS}, {new}, u AS (SELECT bank, folder, alias, 'one' AS holds FROM folders UNION SELECT bank, folder, alias, holds FROM fresh) SELECT CAST(bank AS BIGINT) AS bank, folder, {d.words_of('DISTINCT alias', 'alias') if not d.spark else 'array_join(sort_array(collect_set(alias)), chr(44))'} AS aliases, max(CASE WHEN holds = 'many' THEN 'one_or_many' ELSE 'one' END) AS holds FROM u GROUP BY bank, folder"""


@plan
def folder_index(d):
    return f"WITH {facts(d)} SELECT bank, slot, CAST(created_at AS DATE) AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM facts WHERE NOT forgotten GROUP BY bank, slot, CAST(created_at AS DATE)"


@plan
def named_folders(d):
    """Capitalised names of each bank get folders numbered by first use."""
    return f"""WITH {said(d)}, w AS (SELECT bank, w, min(ord) AS first_ord FROM said {d.explode(d.map(d.found('text', '[a-z] [A-Z][a-z]+'), 'substr(x, 3)'), 'w')} GROUP BY bank, w) SELECT CAST(bank AS BIGINT) AS bank, w AS name, CAST(row_number() OVER (PARTITION BY bank ORDER BY first_ord, w) AS BIGINT) AS number FROM w"""


@plan
def identity_rows(d):
    """One decision per statement: how many folders its words name, and which if one."""
    s = T.spaced(d, "s.text")
    return f"""WITH {said(d)}, {FOLDERS}, h AS (SELECT s.bank, s.ord, count(DISTINCT f.folder) AS n, min(f.folder) AS one FROM said s LEFT JOIN folders f ON f.bank = s.bank AND f.kind <> 'speaker' AND contains({s}, {T.spaced(d, 'f.alias')}) GROUP BY s.bank, s.ord)
      SELECT CAST(bank AS BIGINT) AS bank, CAST(ord AS BIGINT) AS ord, n, CASE WHEN n = 0 THEN 'speaker' WHEN n = 1 THEN one ELSE 'ask' END AS decision FROM h"""


@plan
def pick_folder_rule(d):
    s = T.spaced(d, "q.question")
    return f"""WITH {asked(d)}, {FOLDERS}, h AS (SELECT q.qid, count(DISTINCT f.folder) AS n, min(f.folder) AS one FROM asked q LEFT JOIN folders f ON f.bank = q.bank AND f.kind <> 'speaker' AND contains({s}, {T.spaced(d, 'f.alias')}) GROUP BY q.qid) SELECT CAST(qid AS BIGINT) AS qid, CASE WHEN n = 0 THEN 'new_or_speaker' WHEN n = 1 THEN one ELSE 'ask' END AS choice FROM h"""


@plan
def index_tags(d):
    """Documents tagged with their source's index; a fifth of the tags drop out by a seeded hash."""
    txt = f"CAST(doc_id AS {d.of('STRING', 'VARCHAR')})"
    return f"SELECT doc_id, CASE WHEN substr(md5(concat('drop:', {txt})), 1, 1) IN ('0', '1', '2') THEN NULL ELSE concat(source, '/', lang) END AS tag FROM documents"


@plan
def filed_card_text(d):
    return f"WITH {FILED}, {FOLDERS}, n AS (SELECT bank, folder, min(name) AS name FROM folders GROUP BY bank, folder), {said(d)} SELECT CAST(f.bank AS BIGINT) AS bank, CAST(f.fact AS BIGINT) AS fact, concat(coalesce(n.name, f.folder), ' | ', coalesce(f.slot, 'details'), ' | ', s.text) AS card FROM filed f JOIN said s ON s.bank = f.bank AND s.ord = f.fact LEFT JOIN n ON n.bank = f.bank AND n.folder = f.folder"


@plan
def case_map(d):
    """Headed sections of a document become numbered cases, with a layer by rule and a held-out fifth."""
    txt = f"CAST(doc_id AS {d.of('STRING', 'VARCHAR')})"
    lines = d.split("text", chr(10))
    return f"WITH n AS (SELECT doc_id, {d.n(lines)} AS cases FROM documents) SELECT doc_id, i AS case_no, CASE WHEN i = 1 THEN 'opening' WHEN i = cases THEN 'closing' ELSE 'middle' END AS layer, CASE WHEN substr(md5(concat('case:', {txt})), 1, 1) IN ('0', '1', '2') THEN 1 ELSE 0 END AS held_out FROM n {d.explode(d.series(1, 'cases'), 'i')}"


@plan
def scenario_violations(d):
    return f"""WITH {said(d)}, {asked(d)}, o AS (SELECT bank, ord, CAST(day AS DATE) AS day, lag(CAST(day AS DATE)) OVER (PARTITION BY bank ORDER BY ord) AS before FROM said)
      SELECT 'dates_go_back' AS rule, CAST(bank AS BIGINT) AS bank, CAST(ord AS BIGINT) AS ref FROM o WHERE day < before UNION ALL SELECT 'answer_after_question', CAST(q.bank AS BIGINT), CAST(q.qid AS BIGINT) FROM asked q JOIN said s ON s.bank = q.bank AND s.ord = q.answer WHERE CAST(s.day AS DATE) > CAST(q.day AS DATE)
      UNION ALL SELECT 'answer_missing', CAST(q.bank AS BIGINT), CAST(q.qid AS BIGINT) FROM asked q LEFT JOIN said s ON s.bank = q.bank AND s.ord = q.answer WHERE s.ord IS NULL UNION ALL SELECT 'too_long', CAST(bank AS BIGINT), CAST(ord AS BIGINT) FROM said WHERE length(text) > 40 UNION ALL SELECT 'event_repeats', max(user_id), max(event_id) FROM events GROUP BY event_id HAVING count(*) > 1"""


@plan
def reconcile_answers(d):
    """Answers that did not stand on the day the question asks about are dropped."""
    return f"""WITH {said(d)}, {asked(d)}, {judged(d)}, e AS (SELECT bank, old_ord, min(new_ord) AS new_ord FROM verdicts WHERE reason IN {REPLACES} GROUP BY bank, old_ord)
      SELECT CAST(q.qid AS BIGINT) AS qid, CAST(q.answer AS BIGINT) AS answer, CASE WHEN CAST(a.day AS DATE) <= CAST(q.day AS DATE) AND (s.ord IS NULL OR CAST(s.day AS DATE) > CAST(q.day AS DATE)) THEN 1 ELSE 0 END AS stands FROM asked q JOIN said a ON a.bank = q.bank AND a.ord = q.answer LEFT JOIN e ON e.bank = q.bank AND e.old_ord = q.answer LEFT JOIN said s ON s.bank = e.bank AND s.ord = e.new_ord"""


@plan
def template_copies(d):
    """Masked sentences that more than two documents share."""
    masked = d.sub("w", "[A-Z][a-z]+", "X")
    return f"WITH s AS (SELECT doc_id, w FROM documents {d.explode(d.split('text', '[.] *'), 'w')}), m AS (SELECT md5({masked}) AS h, doc_id FROM s WHERE length(w) >= 15) SELECT h, count(DISTINCT doc_id) AS docs FROM m GROUP BY h HAVING count(DISTINCT doc_id) > 2"


@plan
def strip_labels(d):
    return "SELECT conv_id, turn, text FROM conversations WHERE role <> 'system'"


@plan
def noise_augment(d):
    """Deterministic noise: one swap of letters or a lost ending, chosen by a hash of the key."""
    key = f"concat('noise:', CAST(conv_id AS {d.of('STRING', 'VARCHAR')}), ':', CAST(turn AS {d.of('STRING', 'VARCHAR')}))"
    return f"SELECT conv_id, turn, md5(CASE WHEN substr(md5({key}), 1, 1) < '5' THEN replace(text, 'th', 'ht') WHEN substr(md5({key}), 1, 1) < '9' THEN {d.sub('text', '[.]$', '')} ELSE lower(text) END) AS noisy_md5 FROM conversations"


@plan
def sample_people(d):
    txt = f"CAST(c_custkey AS {d.of('STRING', 'VARCHAR')})"
    return f"WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat('person:', {txt})), c_custkey) AS k FROM customer WHERE c_custkey % 10 <> 0) SELECT c_nationkey AS nation, c_custkey AS person FROM r WHERE k <= 3"


@plan
def context_examples(d):
    """A user turn with the two turns before it; conversations, not turns, are split."""
    return f"""WITH w AS (SELECT conv_id, turn, role, {d.chars('text')} AS n, lag({d.chars('text')}, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS n1, lag({d.chars('text')}, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS n2 FROM conversations)
      SELECT conv_id, turn, n, coalesce(n1, 0) + coalesce(n2, 0) AS context, CASE WHEN conv_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM w WHERE role = 'user'"""


@plan
def latest_session_evidence(d):
    """Evidence in a user's last session day answers, earlier evidence is stale; long texts are only counted."""
    return f"""WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'view'), m AS (SELECT *, max(day) OVER (PARTITION BY user_id) AS last FROM e)
      SELECT user_id, sum(CASE WHEN day = last AND value <= 240 THEN 1 ELSE 0 END) AS answers, sum(CASE WHEN day < last AND value <= 240 THEN 1 ELSE 0 END) AS stale, sum(CASE WHEN value > 240 THEN 1 ELSE 0 END) AS dropped FROM m GROUP BY user_id"""


@plan
def evidence_pairs(d):
    """Each user's last signup against earlier purchases of the days before: a range join inside the user."""
    return f"""WITH s AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT s.user_id, e.event_id AS old_id FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts < s.ts WHERE {d.days('CAST(s.ts AS DATE)', 'CAST(e.ts AS DATE)')} <= 5"""


@plan
def stratified_sample(d):
    txt = f"CAST(d.doc_id AS {d.of('STRING', 'VARCHAR')})"
    return f"WITH r AS (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5(concat('strat:', {txt})), d.doc_id) AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL AND length(d.text) >= 8) SELECT lang, doc_id FROM r WHERE k <= 20"


@plan
def training_mix(d):
    """Clean rows, and two noisy copies with seeds of their own."""
    return f"SELECT conv_id, turn, copy, CASE WHEN copy = 0 THEN 'clean' ELSE 'noisy' END AS source, md5(concat(CAST(copy AS {d.of('STRING', 'VARCHAR')}), ':', text)) AS seed FROM conversations {d.explode(d.series(0, 2), 'copy')}"


@plan
def message_variants(d):
    pieces = d.split("text", "[.!?] *")
    return f"SELECT conv_id, turn, 'raw' AS variant, CAST(1 AS BIGINT) AS n FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'rules' AS variant, {d.n(d.where(pieces, 'length(x) >= 15'))} AS n FROM conversations WHERE role = 'user'"


@plan
def filing_replay(d):
    """Banks whose replayed filing equals the saved one are usable; the others are left out."""
    return f"WITH {FILED}, saved AS (SELECT bank, fact, CASE WHEN bank = 2 AND fact = 4 THEN 'f1' ELSE folder END AS folder FROM filed) SELECT CAST(f.bank AS BIGINT) AS bank, count(*) AS facts, sum(CASE WHEN s.folder = f.folder THEN 0 ELSE 1 END) AS differ FROM filed f JOIN saved s ON s.bank = f.bank AND s.fact = f.fact GROUP BY f.bank"


@plan
def next_batch(d):
    return f"WITH {said(d)}, {FILED}, o AS (SELECT s.bank, s.ord, row_number() OVER (PARTITION BY s.bank ORDER BY s.day, s.ord) AS k FROM said s LEFT JOIN filed f ON f.bank = s.bank AND f.fact = s.ord WHERE f.fact IS NULL) SELECT CAST(bank AS BIGINT) AS bank, CAST(ord AS BIGINT) AS ord, CAST(floor((k - 1) / 5) AS BIGINT) AS batch FROM o"
