"""Main text of web pages: boosted trees over features of DOM nodes, decoded from the root down.

A page becomes a tree of block elements. Each block has features: text and tags of its subtree and
their ratio, the share of link text, tokens of its class, id and role, depth, place among its siblings
and their statistics, and the same for its parent. Boosted trees give the probability that a block
holds main text. The blocks' keep/drop labels are then chosen together, as the most likely ones in
which a dropped block has no kept descendant: one pass from the leaves to the root.

Training needs no labels from outside: pages that mark their article (``article``, ``main``, role main
or articleBody) say which blocks hold main text, and each is learnt from in three forms: as it is and
with marked blocks (comments, notices, sidebars) of its own words put in. The article's marks themselves are not among the features, so
what is learnt carries over to pages without them. The trees are fitted on at most ``sample`` different
pages, the ones with the smallest hash and at most ``longest`` characters; all pages are extracted, whole, without a
shuffle.

Defined results: a null or empty page has the empty text; without any page to learn from, all blocks
stay but those that a landmark (nav, footer, aside, form, ...) or a token such as "ad" marks; unclosed
and stray tags, comments and broken references are read as browsers do, roughly; equal pages get equal
texts; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.boosted_trees import BoostedTrees, fit
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare

# Element names of HTML, and words that sites use in class, id and role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math head title".split())
_CONTROL = frozenset("button select textarea option input label legend".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_LANDMARK = frozenset("nav footer aside form dialog menu header search".split())
_CLOSES_P = _BLOCK - {"html", "body"}
_CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = frozenset("ul ol dl table tbody thead tfoot menu".split())
_AGAINST = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header"
    " login menu modal nav navbar navigation newsletter notice popup promo related reply replies search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe toolbar widget".split()
)
_FOR = frozenset("article body content entry main page post story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element: its own text runs and child blocks in page order."""

    __slots__ = ("name", "parent", "items", "tokens", "marked", "depth", "links", "tags", "index", "size")

    def __init__(self, name: str, parent: Node | None, attributes: str):
        self.name, self.parent, self.items = name, parent, []
        self.tokens, self.marked = (), name in ("article", "main")
        self.depth = parent.depth + 1 if parent else 0
        self.links = self.tags = self.index = self.size = 0
        if attributes:
            words: set[str] = set()
            for kind, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if kind.lower() == "role" and value == "main" or kind.lower() == "itemprop" and value == "articlebody":
                    self.marked = True
                elif kind.lower() != "itemprop":
                    words.update(_WORD.findall(value))
            self.tokens = words


def parse(page: str) -> list[Node]:
    """The blocks of a page, parents before children; the first is the root."""
    root = Node("html", None, "")
    nodes, stack, at, links = [root], [("html", root)], 0, 0
    lower, unclosed = None, set()

    def text(raw: str) -> None:
        if raw:
            stack[-1][1].items.append(raw)
            if links:
                stack[-1][1].links += len(raw.strip())

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return nodes
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    for gone, _ in stack[depth:]:
                        links -= gone == "a"
                    del stack[depth:]
                    break
                if stack[depth][0] in _BLOCK and name not in _BLOCK:
                    break
            continue
        if name in _RAW or name in _CONTROL and name not in _VOID:
            if name == "head":
                continue
            if lower is None:
                lower = page.lower()
                if len(lower) != len(page):
                    lower = page.translate(_LOWER)
            close = -1 if name in unclosed else lower.find("</" + name, at)
            if close < 0:
                unclosed.add(name)
            if close >= 0:
                ends = page.find(">", close)
                at = len(page) if ends < 0 else ends + 1
            elif name in ("script", "style", "template", "iframe", "textarea"):
                at = len(page)  # never closed: the rest is its content
            continue
        if name == "html" or name == "body":
            continue
        block = stack[-1][1]
        block.tags += 1
        if name in _VOID:
            if name == "br" or name == "hr":
                block.items.append(" ")
            continue
        if name in _BLOCK:
            for names, barrier in ((("p",) if name in _CLOSES_P else (), _BLOCK - {"p"}), (_CLOSES_SAME.get(name, ()), _LISTS)):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in names:
                        for gone, _ in stack[depth:]:
                            links -= gone == "a"
                        del stack[depth:]
                        break
                    if stack[depth][0] in barrier:
                        break
            parent = stack[-1][1]
            node = Node(name, parent, m[3] or m[6] or "")
            parent.items.append(node)
            nodes.append(node)
            stack.append((name, node))
        else:
            links += name == "a"
            stack.append((name, stack[-1][1]))


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def against(node: Node) -> bool:
    """Marked as something else than main text by its element or by a word of its attributes."""
    if node.name == "header":
        up = node.parent
        while up is not None and not up.marked:
            up = up.parent
        if up is not None:  # the head of the article, not of the page
            return False
    return node.name in _LANDMARK or bool(node.tokens and not _AGAINST.isdisjoint(node.tokens))


FEATURES = 24


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each block of a page."""
    n = len(nodes)
    own, size, links, tags, below = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    bad, start, position = [0] * n, [0] * n, 0
    for i, node in enumerate(nodes):
        node.index = i
        own[i] = sum(len(t.strip()) for t in node.items if t.__class__ is str)
        size[i], links[i], tags[i] = own[i], node.links, node.tags
        start[i] = position
        position += own[i]
        bad[i] = int(against(node)) or (bad[node.parent.index] and 2 if node.parent else 0)
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent.index
        size[up] += size[i]
        links[up] += links[i]
        tags[up] += tags[i] + 1
        below[up] += below[i] + 1
    family, place, alike = [1] * n, [0] * n, [1.0] * n  # brothers with itself, place among them, share of its name
    for node in nodes:
        children = [c for c in node.items if c.__class__ is Node]
        names = Counter(c.name for c in children)
        for k, c in enumerate(children):
            family[c.index], place[c.index], alike[c.index] = len(children), k, names[c.name] / len(children)
    out = np.zeros((n, FEATURES), dtype=np.float64)
    whole = max(size[0], 1)
    for i, node in enumerate(nodes):
        node.size = size[i]
        u = node.parent.index if node.parent else 0
        name = node.name
        out[i] = (
            math.log1p(size[i]), math.log1p(own[i]), links[i] / max(size[i], 1), size[i] / (tags[i] + 1.0), below[i],
            node.depth, family[i], place[i] / family[i], alike[i], math.log1p(size[u] / family[i]),
            math.log1p(size[u]), links[u] / max(size[u], 1), size[u] / (tags[u] + 1.0), size[i] / whole, start[i] / whole,
            bad[i] == 1, bad[i] == 2, bool(node.tokens and not _FOR.isdisjoint(node.tokens)), name == "p", name[0] == "h" and name[1:].isdigit(),
            name == "li", name in _LISTS, name in ("div", "section", "article", "main", "html", "body"), name in ("td", "th", "tr"),
        )
    return out


def labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for blocks with main text below them, by the page's own marks; None if it has none."""
    if not any(n.marked for n in nodes):
        return None
    inside, holds = [False] * len(nodes), [0.0] * len(nodes)
    for i, node in enumerate(nodes):
        up = node.parent
        inside[i] = (node.marked or bool(up and inside[up.index])) and not against(node)
        holds[i] = float(inside[i] and any(t.__class__ is str and not t.isspace() for t in node.items))
    for i in range(len(nodes) - 1, 0, -1):
        if holds[i]:
            holds[nodes[i].parent.index] = 1.0
    return np.array(holds)


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The most likely labels in which nothing below a dropped block is kept."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    best, dropped = yes[:], no[:]
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.index
        best[up] += max(best[i], dropped[i])
        dropped[up] += dropped[i]
    keep = [False] * len(nodes)
    for i, node in enumerate(nodes):
        keep[i] = (node.parent is None or keep[node.parent.index]) and best[i] >= dropped[i]
    return keep


def assemble(nodes: list[Node], keep: list[bool]) -> str:
    """Text of the kept blocks: references decoded, white space made single, two line ends between blocks."""
    blocks, run = [], []

    def close() -> None:
        if run:
            line = " ".join(html.unescape("".join(run)).split())
            if line:
                blocks.append(line)
            run.clear()

    todo = [iter(nodes[0].items)] if keep[0] else []
    while todo:
        for item in todo[-1]:
            if item.__class__ is str:
                run.append(item)
            else:
                close()
                if keep[item.index]:
                    todo.append(iter(item.items))
                    break
        else:
            close()
            todo.pop()
    return "\n\n".join(blocks)


def extract(pages: list[str], model: BoostedTrees | None) -> list[str]:
    """Main text of pages; features of all their blocks are scored together."""
    trees = [parse(p) for p in pages]
    tables = [features(t) for t in trees]
    if not tables:
        return []
    x = np.concatenate(tables)
    p = np.where(x[:, 15] + x[:, 16] > 0, 0.1, 0.6) if model is None else model.probability(x)
    out, at = [], 0
    for nodes in trees:
        out.append(assemble(nodes, decode(nodes, p[at : at + len(nodes)])))
        at += len(nodes)
    return out


#: Marked blocks that :func:`varied` puts into pages; element and attributes.
_INSERTS = (
    ("aside", ""), ("section", 'class="comments"'), ("div", 'class="cookie-notice"'), ("div", 'id="sidebar"'), ("div", 'class="related-posts"'),
    ("form", ""), ("div", 'class="comment"'), ("div", 'class="ad banner"'), ("ul", 'class="menu"'), ("div", 'class="newsletter popup"'),
)
_OPEN = re.compile(r"<(?:article|main)\b[^>]*>", re.I)
_SHUT = re.compile(r"</(?:article|main)\s*>", re.I)


def varied(page: str, turn: int) -> str:
    """A training page with marked blocks before, inside and after its article, filled with its own words,
    so that the trees see marked blocks that hold as much text as the article's own."""
    opened, shut = _OPEN.search(page), None
    for shut in _SHUT.finditer(page):
        pass
    if not opened or not shut or shut.start() < opened.end():
        return page
    words = re.sub(r"<[^>]*>", " ", page[opened.end() : shut.start()]).split() or ["text"]
    ends = [m.end() for m in re.finditer(r"</p>", page[opened.end() : shut.start()])]
    inside = opened.end() + ends[turn % len(ends)] if ends else shut.start()
    spots, out, at = sorted({opened.start(), inside, shut.start(), shut.end()}), [], 0
    for k, spot in enumerate(spots):
        name, attributes = _INSERTS[(turn + 3 * k) % len(_INSERTS)]
        first, length, item = 37 * (turn + k) % len(words), 3 + 17 * (turn + 5 * k) % 60, "li" if name == "ul" else "p"
        body = " ".join(words[first : first + length])
        rows = "".join(f"<{item}>{body}</{item}>" for _ in range(1 + (turn + k) % 3)) if (turn + k) % 4 else body
        out += [page[at:spot], f"<{name} {attributes}>{rows}</{name}>"]
        at = spot
    return "".join(out) + page[at:]


def learn(df: DataFrame, html_col: str = "html", sample: int = 300, longest: int = 200_000) -> BoostedTrees | None:
    """Trees fitted on at most ``sample`` different pages that mark their article."""
    marks = F.col(html_col).rlike(r"(?i)<article|<main|role=.?main|articleBody") & (F.length(html_col) <= longest)
    hashed = df.where(marks).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("page"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not chosen:
        return None
    rows = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()
    xs, ys = [], []
    for turn, r in enumerate(rows):
        for page in (r["page"], varied(r["page"], 2 * turn), varied(r["page"], 2 * turn + 1)):
            nodes = parse(page)
            x, y = features(nodes), labels(nodes)
            if y is not None:
                xs.append(x)
                ys.append(y)
    return fit(np.concatenate(xs), np.concatenate(ys)) if xs and len(set(np.concatenate(ys))) > 1 else None


def main_text(model: BoostedTrees | None, page: Column) -> Column:
    """A column of main texts."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out = []
            for at in range(0, len(pages), 500):
                out += extract([p or "" for p in pages.iloc[at : at + 500]], model)
            yield pd.Series(out, dtype=object)

    return text(page)


def extract_pages(df: DataFrame, html_col: str = "html", **how) -> DataFrame:
    """Add text and n_chars (its code points)."""
    prepare(df.sparkSession)
    model = learn(df, html_col, **how)
    rows = df.drop(*[c for c in ("text", "n_chars") if c in df.columns and c != html_col])
    return rows.withColumn("text", main_text(model, F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))


@query("op8_html_text")
def op8_html_text(spark, sf) -> DataFrame:
    return extract_pages(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")
