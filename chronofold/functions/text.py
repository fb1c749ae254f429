"""Text functions as expressions of a dialect (F*, P*)."""

from __future__ import annotations

from . import lexicon as L


def sql_list(d, words) -> str:
    inner = ", ".join(f"'{w}'" for w in words)
    return d.of(f"array({inner})", f"[{inner}]")


def padded(x: str) -> str:
    return f"concat(' ', lower({x}), ' ')"


def spaced(d, x: str) -> str:
    """Lower-cased, punctuation to single spaces, one space at either end: what the rules see."""
    return f"concat(' ', trim({d.sub(f'lower({x})', '[^a-z0-9]+', ' ')}), ' ')"


def first_rule(d, x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {d.has(x, p)} THEN '{n}'" for n, p in rules) + " END"


def plain(d, x: str) -> str:
    """What slot rules see: straight apostrophes, and every other character beyond ASCII as a letter, so that word borders agree everywhere."""
    quote = chr(0x2019)
    return d.sub(f"replace({x}, '{quote}', chr(39))", r"[^\x00-\x7F]", "x")


def _says(d, x: str, pattern: str, but: str | None = None, case: bool = False) -> str:
    flag = "" if case else "(?i)"
    return d.has(d.sub(x, flag + but, " ") if but else x, flag + pattern)


def topic(d, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_says(d, plain(d, x), p, but)} THEN '{n}'" for n, p, but in L.TOPICS) + " END"


def query_topic(d, x: str) -> str:
    """The slot of a question: as a statement would name it, else the first of its words that asks about one."""
    alias = "CASE x " + " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in L.QUERY_WORDS) + " END"
    named = d.where(d.map(d.found(f"lower({x})", "[a-z]+"), alias), "x IS NOT NULL")
    return f"coalesce({topic(d, x)}, {d.at(named, 1)})"


def kind(d, x: str) -> str:
    p = f"trim({plain(d, x)})"
    return f"CASE WHEN {_says(d, p, L.LOG_MARK)} OR {_says(d, p, *L.EPISODE, case=True)} THEN 'event' WHEN {_says(d, p, *L.WHEN)} AND NOT {_says(d, p, *L.TRANSITION)} THEN 'event' ELSE 'fact' END"


def condition(d, x: str) -> str:
    return _says(d, plain(d, x), L.CONDITION)


def safety(d, x: str) -> str:
    """A condition, a prohibition, or the medication slot."""
    return f"({condition(d, x)} OR {_says(d, plain(d, x), L.PROHIBITION)} OR {topic(d, x)} = 'medication')"


def negated(d, x: str) -> str:
    return _says(d, plain(d, x), L.NEGATED)


def asserted(d, x: str) -> str:
    """Without the clauses that say what did not happen or only under a condition."""
    return d.sub(x, "(?i)" + L.UNASSERTED, " ")


def additive(d, x: str) -> str:
    return _says(d, plain(d, x), *L.ADDITIVE)


def transition(d, x: str) -> str:
    return _says(d, plain(d, x), *L.TRANSITION)


def stem(d, w: str) -> str:
    """One of ing, ed, es, s goes if three letters stay before it; then a final e of a word above three letters."""
    cut = f"CASE WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN substr({w}, 1, length({w}) - 3) WHEN ({w} LIKE '%ed' OR {w} LIKE '%es') AND length({w}) > 4 THEN substr({w}, 1, length({w}) - 2) WHEN {w} LIKE '%s' AND length({w}) > 3 THEN substr({w}, 1, length({w}) - 1) ELSE {w} END"
    return d.sub(f"({cut})", "^(...+)e$", d.of("$1", "\\1"))


def stems(d, x: str) -> str:
    return d.uniq(d.map(d.less(d.tokens(x), sql_list(d, L.STOP)), stem(d, "x")))


def content(d, x: str) -> str:
    """Words with their inner marks (c++, node.js, 3.5) but not a final stop, contractions and filler left out."""
    bare = d.sub(plain_quotes(d, f"lower({x})"), L.CONTRACTION, d.of("$1", "\\1"))
    words = d.map(d.found(bare, r"[a-z0-9][a-z0-9+#.\-]*"), d.sub("x", r"[.\-]+$", ""))
    return d.uniq(d.less(words, sql_list(d, L.FILLER)))


def plain_quotes(d, x: str) -> str:
    return f"replace({x}, '{chr(0x2019)}', chr(39))"


def fold(d, w: str) -> str:
    """One ending off a word above four letters."""
    return f"CASE WHEN length({w}) > 4 THEN {d.sub(w, '(ing|ed|es|s)$', '')} ELSE {w} END"


def root(d, w: str) -> str:
    """Two endings off."""
    return fold(d, f"({fold(d, w)})")


def _root_of(word: str) -> str:
    for _ in range(2):
        ending = next((e for e in ("ing", "ed", "es", "s") if word.endswith(e)), "") if len(word) > 4 else ""
        word = word[: len(word) - len(ending)]
    return word


def anchors(d, x: str) -> str:
    """Roots worth matching another statement on."""
    roots = d.map(d.less(content(d, x), sql_list(d, L.NO_ANCHOR)), root(d, "x"))
    return d.uniq(d.less(roots, sql_list(d, sorted({_root_of(w) for w in L.GENERIC}))))


def jaccard(d, a: str, b: str) -> str:
    inter = f"CAST({d.n(d.both(a, b))} AS DOUBLE)"
    return f"CASE WHEN {d.n(a)} = 0 OR {d.n(b)} = 0 THEN 0e0 ELSE {inter} / ({d.n(a)} + {d.n(b)} - {d.n(d.both(a, b))}) END"


def directive(d, x: str) -> str:
    s = spaced(d, x)
    return f"({d.has(s, '^ (please |always |never |from now on )?(' + '|'.join(L.ORDERS) + ') ')} AND NOT {condition(d, x)})"
