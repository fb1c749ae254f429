"""Main text of web pages with site style trees.

The pages of a host are merged into one style tree: its nodes are the element paths (tag with class and id)
that its pages share. Over the different pages that have a node, the entropy of its presentation (the order of
its children) and of its content (its text) says how important it is: a menu or notice repeats, an article
does not. Branches of low importance are removed from each page.

Addresses of one article are one page: pages of a host with the same main text count once. Inside an article a
branch falls only if ``FEW`` different pages share it, and none falls that holds the larger part of the article.

What entropy cannot tell goes by what the page declares: elements that are no content by their meaning (nav,
footer, form ...), and containers named as adverts, reader comments or consent notices, whose text varies
although it is no article. A name speaks only where all its words do: "comments-area" does, "comment-piece" does not.
Other names, such as "header" or "related", only count outside an article or main element, and not for a branch that holds
the larger part of a page without one. Outside an article, in pages that have one, a branch stays only if the
host's pages prove it to be important. A page that would lose all its text to the style tree keeps it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Share of the importance that content has; the rest is presentation.
CONTENT_SHARE = 0.9
#: Branches below this importance go. A node of one page has importance one.
IMPORTANCE = 0.35
#: Different pages that must share a branch before it can fall inside an article, and the share of the text that a branch needs to be the main one.
FEW, MAIN = 2, 0.5
#: Nodes of low or proven importance that are sent to every task, at most; more are dealt to the pages by host.
BROADCAST_NODES = 300_000
#: Parts that a host's pages are dealt in when they meet its nodes, so that a hot host is spread.
SALTS = 64

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("script style textarea title xmp iframe noembed noframes head nav header footer aside form button select option template noscript svg canvas object video audio dialog menu".split())
CONTENT = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
            "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("table td th ul ol dl html body article section main div aside nav header footer form blockquote".split())
#: What the start of an element ends, and what that does not reach beyond.
_ENDS = {t: (ends, SCOPES - ends) for t in CLOSES_P | SIBLINGS.keys() for ends in [{*SIBLINGS.get(t, ()), *(("p",) if t in CLOSES_P else ())}]}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Names that say no content wherever a container has them, and names that say so outside an article only.
STRONG = frozenset("ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored comment comments comentarios kommentare commentaires disqus respond cookie cookies consent gdpr newsletter subscribe subscription".split())
WEAK = frozenset("banner promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side header masthead footer foot reply replies notice notification popup modal overlay signup login share sharing social related recommended recommendations widget toolbar pagination pager skip copyright legal".split())
#: Words that say nothing about what a container holds.
NEUTRAL = frozenset("area block body bottom box bar center col column container content form group holder id inner item items js left list main module outer panel post row right section site slot text the thread top unit view wrap wrapper zone".split())
CONTAINERS = frozenset("div section ul ol dl table aside center iframe fieldset ins".split())

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|([!?][^>]*)(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(>|\Z)|(/[^A-Za-z][^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """``noise``: 2 no content anywhere, 1 outside an article only, 0 not declared."""

    __slots__ = ("tag", "sign", "noise", "children", "size")

    def __init__(self, tag: str, sign: str, noise: int):
        self.tag, self.sign, self.noise, self.children, self.size = tag, sign, noise, [], 0


def _element(tag: str, attributes: str) -> Element:
    drop = 1 if tag == "header" else 2 if tag in DROP else 0  # an article may have a header of its own
    if not attributes.strip(" /\n\t"):
        return Element(tag, tag, drop)
    got = {}
    for m in _ATTR.finditer(attributes):
        got.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    names = f"{got.get('class', '')} {got.get('id', '')}".strip()
    said = [set(_WORD.findall(_SPLIT.sub(" ", name).lower())) for name in names.split()] if tag not in ("html", "body") else []
    # a name counts if every word of it does
    words = set().union(*(w for w in said if w <= STRONG | WEAK | NEUTRAL))
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").lower().replace(" ", "")
    if hidden or got.get("role", "").lower() in ROLES or (words & STRONG and tag in CONTAINERS):
        drop = 2
    elif words & (WEAK | STRONG):
        drop = max(drop, 1)
    return Element(tag, tag + "." + ".".join(names.split()) if names else tag, drop)


def parse(page: str | None) -> Element:
    """A tree of elements and text pieces; tolerant of unclosed, misnested and cut markup."""
    root = Element("#root", "", 0)
    stack, text, at, size = [root], page or "", 0, len(page or "")
    places: dict[str, list[int]] = {}  # where the open elements of each tag are

    def close(to: int) -> None:
        for node in stack[to:]:
            places[node.tag].pop()
        del stack[to:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            stack[-1].children.append(text[at:])
            break
        if lt > at:
            stack[-1].children.append(text[at:lt])
        m = _TAG.match(text, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[3] is None:
            continue
        if m[5] != ">":  # the page ends inside a tag
            break
        tag = m[3].lower()
        if m[2]:
            k = last((tag,))
            if k and not (tag in INLINE and last(("article", "body", "td")) > k):
                close(k)
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends, scopes = _ENDS[tag]
            bound = last(scopes)
            while (k := last(ends)) > bound:
                close(k)
                if tag in CLOSES_P:
                    break
        node = _element(tag, m[4])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[4].rstrip().endswith("/") or tag not in VOID and tag not in INLINE:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    _measure(root)
    return root


def _measure(root: Element) -> None:
    """``size`` of every element: the characters of its text that are not blank, without what is never content."""
    order, queue = [], [root]
    while queue:
        node = queue.pop()
        order.append(node)
        queue += [c for c in node.children if isinstance(c, Element)]
    for node in reversed(order):
        node.size = sum(len(c) - c.count(" ") - c.count("\n") if isinstance(c, str) else c.size for c in node.children) if node.noise < 2 else 0


def main_hash(root: Element) -> int:
    """What a page is about, for telling addresses of one article from different pages: the text of its first article or main element, else of the page."""
    queue, at = [root], 0
    while at < len(queue):
        inner = [c for c in queue[at].children if isinstance(c, Element) and c.noise < 2]
        best = next((c for c in inner if c.tag in CONTENT and c.size), None)
        if best is not None:
            root = best
            break
        queue += inner
        at += 1
    said, stack = [], [iter(root.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                said += c.split()
            elif c.noise < 2:
                stack.append(iter(c.children))
                break
        else:
            stack.pop()
    return _hash(*said)


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def style_nodes(root: Element) -> list[tuple[int, int, int]]:
    """For each element path its hash, and hashes of its presentation and of its text over all its places in the page.

    Walks without recursion, and a node's text is hashed from its children's hashes, so deep pages cost no more.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    stack = [(root, 0, iter(root.children), [])]
    while stack:
        node, path, rest, said = stack[-1]
        for c in rest:
            if isinstance(c, str):
                if c.strip():
                    said.append(" ".join(c.split()))
            elif c.tag not in RAW and c.tag != "head":
                stack.append((c, _hash(path, c.sign), iter(c.children), []))
                break
        else:
            stack.pop()
            if stack:
                words = _hash(*said) if said else 0
                shown = _hash(*(x.sign for x in node.children if isinstance(x, Element)))
                places.setdefault(path, []).append((shown, words))
                if words:
                    stack[-1][3].append(words)
    return [(path, _hash(*(a for a, _ in x)), _hash(*(b for _, b in x))) for path, x in places.items()]


def main_text(root: Element, importance: dict[int, int] | None = None) -> str:
    """The text left after removing noise and unimportant branches; blocks joined by an empty line.

    ``importance`` has the paths that the host's pages prove to be important (1), of no importance (-1), or so by too few pages to
    say it inside an article (0).
    """
    known = importance or {}
    found = _main_text(root, known)
    return found if found or not known else _main_text(root, {})


def _main_text(root: Element, known: dict[int, int]) -> str:
    blocks: list[str] = []
    run: list[str] = []
    has_content, queue = False, [root]
    while queue and not has_content:
        inner = [c for c in queue.pop().children if isinstance(c, Element) and c.noise < 2]
        has_content = any(c.tag in CONTENT for c in inner)
        queue += inner

    def flush() -> None:
        block = " ".join("".join(run).split())
        run.clear()
        if block:
            blocks.append(block)

    # node, its path, the children to come, the size of the content element it is in (none: 0), whether its text is read
    stack = [(root, 0, iter(root.children), 0, not has_content)]
    while stack:
        node, path, rest, inside, read = stack[-1]
        for c in rest:
            if isinstance(c, str):
                if read:
                    run.append(entities.unescape(c))
                continue
            here = _hash(path, c.sign)
            content = inside or (c.tag in CONTENT and max(1, c.size))
            # inside an article only branches with a presentation of their own can be told from its text, and not its main one
            level = known.get(here)
            poor = level is not None and level < 1 and (not content or (inside and level < 0 and "." in c.sign and c.size < MAIN * inside))
            weak = c.noise == 1 and not inside and (has_content or c.size < MAIN * root.size)
            if c.noise == 2 or poor or weak:
                if c.tag not in INLINE:
                    flush()
                continue
            if c.tag not in INLINE:
                flush()
            elif c.tag == "br":
                run.append(" ")
            proven = level == 1 and c.tag not in ("html", "body")
            stack.append((c, here, iter(c.children), content, content or read or proven))
            break
        else:
            if node.tag not in INLINE:
                flush()
            stack.pop()
    flush()
    return "\n\n".join(blocks)


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def style_tree(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, pages, importance``: the merged style trees of all hosts.

    importance = (1 - CONTENT_SHARE) * H(presentation) / log m + CONTENT_SHARE * H(content) / log m over the m
    different pages that have the node; 1 where m = 1. Pages of a host with the same main text count once.
    Counts are made per (host, path, hash), so a host with a third of all pages is spread over all tasks.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"]):
                root = parse(page)
                nodes = np.array(style_nodes(root), dtype="<i8").reshape(-1, 3)
                rows.append((_host(url), main_hash(root), nodes[:, 0], nodes[:, 1], nodes[:, 2]))
            yield pd.DataFrame(rows, columns=["host", "page", "path", "shown", "said"])

    pages = df.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, "host string, page long, path array<long>, shown array<long>, said array<long>")
    nodes = pages.dropDuplicates(["host", "page"]).select("host", F.explode(F.arrays_zip("path", "shown", "said")).alias("n"))
    nodes = nodes.select("host", "n.path", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("n.shown").alias("hash")), F.struct(F.lit(1).alias("part"), F.col("n.said").alias("hash")))).alias("x"))
    counts = nodes.groupBy("host", "path", "x.part", "x.hash").agg(F.count("*").alias("c"))
    spread = counts.groupBy("host", "path", "part").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    share = F.when(F.col("part") == 1, CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)
    entropy = F.when(F.col("m") == 1, 1.0).otherwise((F.log("m") - F.col("clogc") / F.col("m")) / F.log("m"))
    return spread.groupBy("host", "path").agg(F.max("m").alias("pages"), F.sum(share * entropy).alias("importance"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Returns one row per input row: id, url, ``text`` (character references decoded, white space inside a
    block one space, blocks in page order joined by two newlines; empty if none) and ``n_chars``. Null or
    empty html gives empty text; pages whose url is null or has no host form one tree. Repeated rows are
    extracted each, but count once in the tree; an empty table gives an empty result; further columns are ignored.
    """
    spark = df.sparkSession
    tree = materialise(style_tree(df, url_col, html_col).where("pages > 1").select("host", "path", F.when(F.col("importance") >= IMPORTANCE, 1).when(F.col("pages") < FEW, 0).otherwise(-1).alias("high")), "style-tree")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    fields = "id long, url string, text string, n_chars long"

    if tree.count() <= BROADCAST_NODES:
        known: dict[str, dict[int, int]] = {}
        for r in tree.collect():
            known.setdefault(r["host"], {})[r["path"]] = r["high"]
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = [main_text(parse(page), shared.value.get(_host(url))) for url, page in zip(pdf["url"], pdf["html"])]
                yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

        return pages.mapInPandas(run, fields).withColumnRenamed("id", id_col)

    # a part of a host's pages comes after the host's nodes, so a task holds one host's nodes and one batch of pages
    nodes = tree.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "path", "high",
                        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    get_host = F.pandas_udf(lambda x: x.map(_host), "string")
    dealt = pages.select(get_host("url").alias("host"), F.pmod(F.xxhash64("id", "url", F.length("html")), F.lit(SALTS)).cast("int").alias("salt"),
                         F.lit(None).cast("long").alias("path"), F.lit(None).cast("int").alias("high"), "id", "url", "html")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, known = None, {}
        for pdf in batches:
            out = []
            for host, salt, path, high, pid, url, page in zip(*(pdf[c] for c in ("host", "salt", "path", "high", "id", "url", "html"))):
                if (host, salt) != here:
                    here, known = (host, salt), {}
                if high is not None and not pd.isna(high):
                    known[int(path)] = int(high)
                else:
                    text = main_text(parse(page), known)
                    out.append((None if pd.isna(pid) else int(pid), url, text, len(text)))
            got = pd.DataFrame(out, columns=["id", "url", "text", "n_chars"])
            yield got.astype({"id": "Int64", "n_chars": "int64"})

    both = nodes.unionByName(dealt).withColumn("path", F.col("path").cast("decimal(20,0)").cast("string")).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("high").isNull())
    return both.mapInPandas(meet, fields).withColumnRenamed("id", id_col)
