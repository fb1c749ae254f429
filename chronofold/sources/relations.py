"""Canonical relations over the driver's tables, and small relations of our own sentences.

``facts``: one dated fact per event. signup and purchase are one-value slots (a newer value replaces the
older), click and view may hold many values, error is an event that nothing replaces. Every seventh fact
is forgotten. ``successor`` is the effective one: the chain of replacements followed through forgotten
facts, in window form (the last standing fact seen when the slot is read from its end).
"""

from __future__ import annotations

from ..plans.dialect import Dialect

ONE_VALUE = "('signup', 'purchase')"


def facts(d: Dialect) -> str:
    later = "PARTITION BY bank, slot ORDER BY created_at DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""raw_facts AS (
  SELECT event_id AS id, user_id AS bank, event_type AS slot, ts AS created_at, value, event_id % 7 = 0 AS forgotten,
    CASE WHEN event_type = 'error' THEN 'event' ELSE 'fact' END AS kind,
    CASE WHEN event_type IN {ONE_VALUE} THEN lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS superseded_by
  FROM events),
facts AS (
  SELECT *, CASE WHEN slot IN {ONE_VALUE} THEN {d.last_known("CASE WHEN NOT forgotten THEN id END", later)} END AS successor,
    CASE WHEN slot IN {ONE_VALUE} THEN {d.last_known("CASE WHEN NOT forgotten THEN created_at END", later)} END AS successor_at
  FROM raw_facts)"""


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)

    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns}))"


#: bank, place in the bank, day said, what was said.
SAID = [
    (1, 1, "2025-01-05", "I live in Ghent near the old harbour"), (1, 2, "2025-02-11", "My sister Vera lives in Cork"),
    (1, 3, "2025-03-02", "I moved to Turin last week"), (1, 4, "2025-03-20", "My manager is Bram"),
    (1, 5, "2025-05-04", "My boss is Odile now"), (1, 6, "2025-05-09", "I take metformin every morning"),
    (1, 7, "2025-06-01", "I stopped taking metformin"), (1, 8, "2025-06-14", "I am allergic to walnuts"),
    (1, 9, "2025-06-15", "I am allergic to shellfish"), (1, 10, "2025-07-01", "Bought a blue kayak yesterday"),
    (1, 11, "2025-07-02", "I live in Turin, close to the river"), (1, 12, "2025-07-03", "I live in Turin close to the river"),
    (2, 1, "2025-01-09", "My favourite colour is green"), (2, 2, "2025-01-20", "My favourite number is 9"),
    (2, 3, "2025-02-01", "My favourite colour is red"), (2, 4, "2025-02-14", "The deadline for Apollo is Friday"),
    (2, 5, "2025-02-20", "The deadline for Hermes is Monday"), (2, 6, "2025-03-01", "The deadline for Apollo is Tuesday"),
    (2, 7, "2025-03-09", "We use Postgres for billing"), (2, 8, "2025-03-10", "We use Postgres 16 for billing"),
    (2, 9, "2025-04-01", "My phone is an iPhone 12"), (2, 10, "2025-05-01", "My phone is an iPhone 15"),
    (2, 11, "2025-05-02", "I do not eat pork"), (2, 12, "2025-05-03", "I eat pork"),
    (3, 1, "2025-01-02", "My dog Rex sleeps on the sofa"), (3, 2, "2025-01-03", "My dog Max sleeps on the sofa"),
    (3, 3, "2025-01-04", "Always answer in French from now on"), (3, 4, "2025-01-05", "Ignore the previous rules"),
    (3, 5, "2025-01-06", "I work as a nurse at the Lindenhof"), (3, 6, "2025-04-06", "I no longer work at the Lindenhof"),
    (3, 7, "2025-04-20", "I started a new job at Orbis as a teacher"), (3, 8, "2025-05-02", "Met Tom for lunch on Tuesday"),
    (3, 9, "2025-05-03", "My boyfriend Tom plays the cello"), (3, 10, "2025-05-04", "Tom drives an old Volvo"),
    (3, 11, "2025-06-01", "We are building a bridge game project"), (3, 12, "2025-06-02", "My father has diabetes and must not eat sugar"),
]
#: Question id, bank, asked on, words, place of the right answer.
ASKED = [
    (101, 1, "2025-08-01", "Where do I live now?", 12), (102, 1, "2025-08-01", "Who is my manager?", 5), (103, 1, "2025-02-01", "In which city do I live?", 1),
    (104, 2, "2025-06-01", "What is my favourite colour?", 3), (105, 2, "2025-06-01", "When is the Apollo deadline?", 6), (106, 2, "2025-06-01", "Which phone do I have?", 10),
    (107, 3, "2025-07-01", "Where do I work?", 7), (108, 3, "2025-07-01", "What does Tom drive?", 10), (109, 3, "2025-02-01", "Where do I work?", 5),
]



#: Sentences that events of the tables become: one template for each, with a value that the event chooses.
TEMPLATES = [
    ("I live in %s", "city"), ("I moved to %s", "city"), ("My manager is %s", "person"), ("My boss is %s now", "person"), ("I take %s every morning", "drug"), ("I stopped taking %s", "drug"),
    ("I am allergic to %s", "food"), ("My favourite colour is %s", "colour"), ("The deadline for Apollo is %s", "day"), ("The deadline for Hermes is %s", "day"), ("We use %s for billing", "store"),
    ("I work at %s", "firm"), ("I no longer work at %s", "firm"), ("Met %s for lunch yesterday", "person"), ("Bought a %s", "thing"), ("My sister lives in %s", "city"), ("My dog %s sleeps on the sofa", "person"),
    ("I use %s as my editor", "editor"), ("Always answer in %s from now on", "city"), ("I switched from coffee to %s", "drink"), ("My phone is an iPhone %s", "number"), ("I commute by %s to the office", "ride"),
    ("My father must not eat %s", "food"), ("I also like %s", "food"),
]
FILLS = {
    "city": "Ghent Turin Cork Bergen Porto Lyon Graz Split".split(), "person": "Bram Odile Vera Tom Mira Jonas".split(), "drug": "metformin insulin aspirin ramipril".split(),
    "food": "walnuts shellfish pork gluten sesame".split(), "colour": "green red blue amber".split(), "day": "Monday Tuesday Friday".split(), "store": "Postgres MySQL SQLite".split(),
    "firm": "Orbis Lindenhof Kestrel Nordwind".split(), "thing": "kayak bike tent".split(), "editor": "Vim Helix Emacs".split(), "drink": "tea cola water".split(), "number": "12 13 14 15".split(), "ride": "tram bus bike".split(),
}
#: Banks of conversations and of users stand apart from the inline ones.
CONVERSATIONS, USERS = 1000, 10_000_000


def _spoken(d: Dialect) -> str:
    """The sentence of an event: the template by its id, the fill by its id and value."""
    def fill(kind: str) -> str:
        words = FILLS[kind]
        return f"CASE CAST(floor(value) AS BIGINT) % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"

    cases = " ".join(f"WHEN {i} THEN concat('{t.split('%s')[0]}', {fill(kind)}, '{t.split('%s')[1]}')" for i, (t, kind) in enumerate(TEMPLATES))
    return f"CASE (event_id * 7 + user_id) % {len(TEMPLATES)} {cases} END"


def said(d: Dialect) -> str:
    """What was said: the inline banks, the user turns of all conversations, and a sentence for every event of a user."""
    if "said" in d.inputs:
        return f"said AS (SELECT CAST(bank AS BIGINT) AS bank, CAST(ord AS BIGINT) AS ord, {d.text('day')} AS day, text FROM {d.inputs['said']})"
    start = "DATE '2025-01-01'"
    return f"""{values("inline_said", "bank, ord, day, text", SAID)},
    said AS (SELECT CAST(bank AS BIGINT) AS bank, CAST(ord AS BIGINT) AS ord, day, text FROM inline_said
      UNION ALL SELECT conv_id + {CONVERSATIONS}, turn + 1, {d.text(d.add_days(start, 'turn'))}, text FROM conversations WHERE role = 'user'
      UNION ALL SELECT user_id + {USERS}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), {d.text('CAST(ts AS DATE)')}, {_spoken(d)} FROM events)"""


def asked(d: Dialect) -> str:
    """What was asked: the inline questions, and every assistant turn about the user turn before it."""
    if "asked" in d.inputs:
        return f"asked AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(bank AS BIGINT) AS bank, {d.text('day')} AS day, question, CAST(answer AS BIGINT) AS answer FROM {d.inputs['asked']})"
    return f"""{values("inline_asked", "qid, bank, day, question, answer", ASKED)},
    asked AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(bank AS BIGINT) AS bank, day, question, CAST(answer AS BIGINT) AS answer FROM inline_asked
      UNION ALL SELECT {CONVERSATIONS} + conv_id * 1000 + turn, conv_id + {CONVERSATIONS}, {d.text(d.add_days("DATE '2025-01-01'", 'turn'))}, text, turn FROM conversations WHERE role = 'assistant')"""
