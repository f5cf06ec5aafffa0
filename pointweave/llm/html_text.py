"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree. A node of it is a path of elements with their class,
id and role, and holds how many pages have it, the styles (kinds of child elements) it takes on, and
the texts that stand directly in it. Following the entropy measures of site style trees, with m the
pages that have the node,

    presentation importance = -sum(p log p) / log m      over the shares p of its styles
    content importance      = 1 - mean(log c / log m)    over its texts, c the pages with that text

    apartness               = the share of its pages on which it stands apart from the main text

A node is of low importance if it stands apart on most of its pages, or if its presentation importance is low and
its content importance lies below the gap that its host shows: the level of content is that of the node with the
most different text that doesn't stand apart, and template texts repeat several times as much. Nodes in an
article need to repeat on nearly all pages, as headings of sections do on some. A node is template if neither it nor any
node below it is of high importance; its whole branch is removed from every page of the host. Where the articles
are copies of one another, the level is low, and they stay.

A node stands apart on a page if it lies in navigation, a page head or foot, or an aside, in an element that the site
names as an advert, notice or comments - but not if that element holds nearly all text of the page -, or outside
a marked article that holds at least half of the page's other text. The measures are the tree's, over all pages of the
host; a page alone tells no more than its own marks. Forms, controls and hidden elements hold no text by their meaning.

The tree is held as sums by (host, path), so a host with a third of all pages is summed like any
other. The template nodes go to all executors if they number MOST_BROADCAST at most, else pages are
joined with theirs.

Results in special cases: null or empty html gives an empty text; a null url is a host of its own;
pages are read whole; markup that isn't closed ends with the page; repeated rows give repeated
results (each copy counts as a page of its host), an empty table an empty one; only page_id, url and
html are read.
"""

from __future__ import annotations

import html as codes
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, keep, map_texts, table

#: Pages that must share a node before its contents are judged, and the presentation importance up to which it may be template.
LEAST_PAGES, LOW_PRESENTATION = 3, 0.5
#: Repetition (1 - content importance) is high from REPEATS times the host's content's plus SLACK, and from OFTEN in an article.
REPEATS, SLACK, OFTEN = 4.0, 0.02, 0.7
#: A named element that holds this many times the rest of a page's text is what the page is about.
NEARLY_ALL = 4
MOST_BROADCAST = 1 << 20

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|xmp)\b(?>[^>"']|"[^"]*"|'[^']*')*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
      | <(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
      | <[a-z/!?](?:[^>]*)(?:>|\Z)""",
    re.S | re.I | re.X,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
MAIN = frozenset(("article", "main"))
IN_HEAD = frozenset("base basefont bgsound link meta noframes".split())
NEVER = frozenset("head form button select option dialog menu object audio video canvas".split())
BESIDES = frozenset("nav aside footer".split())
#: How sites name what is not main text, as a whole class, id or role or as the first or last part of one ("ad-slot", "site-footer", "comment-list").
NAMED = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal newsletter subscribe sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments respond share sharing related complementary contentinfo search".split()
)
#: Parts that make a name tell of an element's neighbours ("has-comments", "content-with-sidebar", "no-sidebar").
BESIDE = frozenset("has have with without no not in is hide".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARTS = re.compile(r"[^a-z0-9]+")
SPLIT_HOST = re.compile(r"[/?#]")


def _noise(name: str) -> bool:
    parts = [x for x in PARTS.split(name) if x]
    return bool(parts) and (parts[0] in NAMED or parts[-1] in NAMED) and BESIDE.isdisjoint(parts)


#: What an element tells of its text: nothing, apart outside an article, apart, apart by its name alone, none by its meaning.
CLEAR, HEADER, APART, NAMES, NONE = range(5)


@lru_cache(maxsize=1 << 16)
def _named(tag: str, names: str, role: str) -> tuple[str, int]:
    """An element's label in paths, and what it tells."""
    label = f"{tag}.{names} {role}".strip()
    if tag in NEVER:
        return label, NONE
    if tag in ("body", "html"):
        return label, CLEAR
    if tag in BESIDES or any(map(_noise, role.split())):
        return label, APART
    return label, NAMES if any(map(_noise, names.split())) else HEADER if tag == "header" else CLEAR


def _kind(tag: str, attrs: str) -> tuple[str, int]:
    if "=" not in attrs and "hidden" not in attrs.lower():
        return _named(tag, "", "")
    found = {}
    for name, *values in ATTR.findall(attrs):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    label, tells = _named(tag, f"{found.get('class', '')} {found.get('id', '')}".lower().strip(), found.get("role", "").lower())
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return label, NONE if hidden else tells


@lru_cache(maxsize=1 << 16)
def _below(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, seed=path)


@dataclass(frozen=True)
class Run:
    """Text without a tag in it: the node it stands in, whether in what holds no text by its meaning, and its block."""

    path: int
    text: str
    dropped: bool
    block: int


@dataclass
class Page:
    """Runs in order; of each node the labels of its children, its parent and what it tells; the nodes in an article."""

    runs: list[Run]
    styles: dict[int, set[str]]
    parents: dict[int, int]
    tells: dict[int, int]
    inside: set[int]


def walk(page: str) -> Page:
    out = Page([], {}, {}, {}, set())
    runs, styles, parents = out.runs, out.styles, out.parents
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, path, in an article, holding no text
    block, at = 0, 0

    def text(end: int) -> None:
        if end > at:
            runs.append(Run(stack[-1][1], page[at:end], stack[-1][3], block))

    for found in TAG.finditer(page):
        text(found.start())
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        _, path, inside, dropped = stack[-1]
        if tag in INLINE:
            if tag == "br":
                runs.append(Run(path, " ", dropped, block))
            elif found["end"]:
                for i in range(len(stack) - 1, 0, -1):  # only inline elements that are never main text, and those in them, are on the stack
                    if stack[i][0] not in INLINE:
                        break
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in VOID and (stack[-1][0] in INLINE or _kind(tag, found["attrs"])[1] != CLEAR):
                stack.append((tag, path, inside, True))
            continue
        block += 1
        if found["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p" or (stack[-1][0] == "head" and tag not in IN_HEAD):
            stack.pop()
        closes = CLOSES.get(tag)
        if closes and stack[-1][0] in closes:
            stack.pop()
        if tag in VOID:
            continue
        label, tells = _kind(tag, found["attrs"])
        _, path, inside, dropped = stack[-1]
        styles.setdefault(path, set()).add(label)
        below = _below(path, label)
        styles.setdefault(below, set())
        parents[below] = path
        out.tells[below] = CLEAR if tells == HEADER and inside else tells if tells != NONE else out.tells.get(below, CLEAR)
        inside = inside or tag in MAIN
        if inside:
            out.inside.add(below)
        stack.append((tag, below, inside, dropped or tells == NONE))
    text(len(page))
    return out


def apart(page: Page) -> set[int]:
    """The nodes that stand apart from the main text on this page."""
    sizes: Counter = Counter()
    for r in page.runs:
        if not r.dropped:
            sizes[r.path] += len(r.text) - sum(map(r.text.count, " \n\t"))
    lines = {p: list(_above(p, page.parents)) for p in page.parents}
    firm = {p for p, line in lines.items() if any(page.tells[a] in (HEADER, APART) for a in line)}
    tops: dict[int, int] = {}
    for p, line in lines.items():
        if p not in firm and (named := [a for a in line if page.tells[a] == NAMES]):
            tops[p] = named[-1]
    clear = sum(n for p, n in sizes.items() if p not in firm and p not in tops)
    held: Counter = Counter()
    for p, top in tops.items():
        held[top] += sizes[p]
    about = {top for top, n in held.most_common(1) if n > NEARLY_ALL * clear}
    out = firm | {p for p, top in tops.items() if top not in about}
    marked = sum(n for p, n in sizes.items() if p in page.inside and p not in out)
    outside = {p for p in page.parents if p not in page.inside and p not in out}
    if marked and sum(sizes[p] for p in outside) <= marked:
        holders = {a for p in page.inside for a in lines[p]}
        out |= outside - holders
    return out


def _above(path: int, parents: dict[int, int]) -> Iterable[int]:
    """The node and all those it lies in, the page itself left out."""
    while path:
        yield path
        path = parents[path]


def _words(raw: str) -> str:
    return " ".join((codes.unescape(raw) if "&" in raw else raw).split())


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return SPLIT_HOST.split(rest, maxsplit=1)[0].rpartition("@")[2].lower()


def node_key(host: str, path: int) -> int:
    """A node of a host's tree as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(host, seed=path) - (1 << 63)


STYLE, TEXT, BELOW = 0, 1, 2


def page_nodes(url: str | None, html: str) -> Iterable[tuple[int, int, int, int, int]]:
    """Of each node of a page: (host, node, STYLE, its children, 2 if in an article + 1 if apart), (host, node, TEXT, a text directly in it, its length) and (host, node, BELOW, itself or a node it lies in, 0)."""
    page = walk(html)
    host, texts, away = host_of(url), {}, apart(page)
    own = node_key(host, 0)
    for r in page.runs:
        if not r.dropped:
            texts.setdefault((r.path, r.block), []).append(r.text)
    content: dict[int, set[str]] = {}
    for (path, _), raws in texts.items():
        if found := _words("".join(raws)):
            content.setdefault(path, set()).add(found)
    for path in page.styles.keys() | content.keys():
        if not path:
            continue
        node = node_key(host, path)
        yield own, node, STYLE, xxhash.xxh64_intdigest("|".join(sorted(page.styles.get(path, ())))) - (1 << 63), 2 * (path in page.inside) + (path in away)
        for found in content.get(path, ()):
            yield own, node, TEXT, xxhash.xxh64_intdigest(found) - (1 << 63), len(found)
        for above in _above(path, page.parents):
            yield own, node, BELOW, node_key(host, above), 0


def main_text(url: str | None, html: str, template) -> str:
    """The page's blocks, one a line. template: tells of a list of nodes which are template."""
    page = walk(html)
    runs = [r for r in page.runs if not r.dropped]
    host = host_of(url)
    paths = list({p for r in runs for p in _above(r.path, page.parents)})
    noted = {p for p, t in zip(paths, template([node_key(host, p) for p in paths]), strict=True) if t} if paths else set()
    gone = {p for p in {r.path for r in runs} if not noted.isdisjoint(_above(p, page.parents))} if noted else set()
    blocks: list[list[str]] = []
    last = None
    for r in runs:
        if r.path in gone:
            continue
        if r.block != last:
            blocks.append([])
            last = r.block
        blocks[-1].append(r.text)
    return "\n".join(x for x in (_words("".join(b)) for b in blocks) if x)


def site_tree(pages: DataFrame) -> DataFrame:
    """(node, above, host, pages, presentation, content, apart, inside, size): the measures of each node, over all pages of its host, for itself and each node it lies in.

    A node that one page alone has is of full importance, one without text of its own has no content importance.
    size: the length of its different texts.
    """

    def run(texts: list[str], rest: dict) -> dict:
        sums = Counter(x for url, page in zip(rest["url"].to_pylist(), texts, strict=True) for x in page_nodes(url, page))
        host, node, kind, feature, more = zip(*sums, strict=True) if sums else ((),) * 5
        return {"host": host, "node": node, "kind": kind, "feature": feature, "more": more, "n": list(sums.values())}

    seen = map_texts(pages.select("url", "html"), "html", run, "host long, node long, kind int, feature long, more int, n long")
    sums = keep(seen.groupBy("host", "node", "kind", "feature", "more").agg(F.sum("n").alias("n")), "site-sums")
    n, style, text = F.col("n"), F.col("kind") == STYLE, F.col("kind") == TEXT
    # a style's pages may differ in being apart
    styles = sums.where(style).groupBy("node", "feature").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("more") % 2 == 1, n).otherwise(0)).alias("apart"), F.max("more").alias("more"))
    shapes = styles.groupBy("node").agg(F.sum("n").alias("pages"), F.sum("apart").alias("apart"), F.max(F.col("more") >= 2).alias("inside"), F.sum(n * F.log(n.cast("double"))).alias("n_log_n"))
    contents = sums.where(text).groupBy("node").agg(F.avg(F.log(n.cast("double"))).alias("log_c"), F.sum(F.col("more").cast("long")).alias("size"))
    m = F.log(F.col("pages").cast("double"))
    alone = F.col("pages") < 2
    known = shapes.join(contents, "node", "left").select(
        "node",
        "pages",
        F.when(alone, 1.0).otherwise((m - F.col("n_log_n") / F.col("pages")) / m).alias("presentation"),
        F.when(F.col("log_c").isNotNull(), F.when(alone, 1.0).otherwise(1 - F.col("log_c") / m)).alias("content"),
        (F.col("apart") / F.col("pages")).alias("apart"),
        "inside",
        F.coalesce("size", F.lit(0)).alias("size"),
    )
    return known.join(sums.where(F.col("kind") == BELOW).select("host", "node", F.col("feature").alias("above")), "node")


def template_nodes(tree: DataFrame) -> DataFrame:
    """The nodes whose whole branches are template."""
    most = F.max_by(1 - F.col("content"), F.struct("size", "node"))
    level = tree.where("content is not null and apart <= 0.5 and above = node").groupBy("host").agg(most.alias("level"))
    gap = f"case when inside then greatest({OFTEN}, (1 + level) / 2) else least({REPEATS} * level + {SLACK}, (1 + level) / 2) end"
    high = F.expr(f"apart <= 0.5 and (presentation > {LOW_PRESENTATION} or pages < {LEAST_PAGES} or coalesce(1 - content <= coalesce({gap}, 1) + 1e-9, false))")
    judged = tree.join(level, "host", "left")
    return judged.groupBy(F.col("above").alias("node")).agg(F.max(high).alias("high")).where("not high").select("node")


def extract_text(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = site_tree(pages)
    template = keep(template_nodes(tree), "template")
    drop_kept(tree)
    schema = "page_id long, url string, text string, n_chars long"
    rows = pages.select("page_id", "url", "html")
    if template.count() <= most_broadcast:
        nodes = np.sort(np.array([r["node"] for r in template.collect()], np.int64))
        drop_kept(template)
        shared = pages.sparkSession.sparkContext.broadcast(nodes)

        def among(asked: list[int]) -> list[bool]:
            known = shared.value
            a = np.array(asked, np.int64)
            at = np.searchsorted(known, a)
            return [bool(i < len(known) and known[i] == x) for i, x in zip(at.tolist(), asked, strict=True)]

        def run(texts: list[str], rest: dict) -> dict:
            found = [main_text(u, x, among) for u, x in zip(rest["url"].to_pylist(), texts, strict=True)]
            return {"page_id": rest["page_id"], "url": rest["url"], "text": found, "n_chars": [len(x) for x in found]}

        return map_texts(rows, "html", run, schema)

    def nodes_of(texts: list[str], rest: dict) -> dict:
        found = [sorted({x[1] for x in page_nodes(u, page) if x[2] == STYLE}) for u, page in zip(rest["url"].to_pylist(), texts, strict=True)]
        return {"url": rest["url"], "html": texts, "nodes": found}

    def run_joined(texts: list[str], rest: dict) -> dict:
        found = []
        for u, x, gone in zip(rest["url"].to_pylist(), texts, rest["gone"].to_pylist(), strict=True):
            own = set(gone or ())
            found.append(main_text(u, x, lambda asked, own=own: [n in own for n in asked]))
        return {"page_id": rest["page_id"], "url": rest["url"], "text": found, "n_chars": [len(x) for x in found]}

    # a page's template nodes: distinct (page, node) rows, joined on the node; a hot host's nodes are on the large side, which may be split
    text_key = [F.xxhash64("url", F.coalesce("html", F.lit(""))).alias("page")]
    own = map_texts(rows.select("url", "html"), "html", nodes_of, "url string, html string, nodes array<long>")
    gone = own.select(*text_key, F.explode("nodes").alias("node")).distinct().join(template, "node").groupBy("page").agg(F.collect_set("node").alias("gone"))
    return map_texts(rows.withColumn("page", text_key[0]).join(gone, "page", "left").drop("page"), "html", run_joined, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
