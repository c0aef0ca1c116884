"""Main-text extraction by scoring the tree of a page.

Method: the page is parsed leniently into a tree (unclosed and cut tags included).
Parts that are never content are taken out: scripts, styles, menus, forms, page
headers, footers, side columns, and elements with a class, id or role that names such a
part (adverts, notices, comments, ...): the whole name is such a word, or is made of such
words and of words of place (``cookie-banner``, ``sidebar-left``; not ``related-work``).  Every paragraph passes points for its length
and its commas to its ancestors (in full to its parent, half to the next, a third of
half and so on), on top of a start value for the kind and name of the container;
points are discounted by the share of text that stands in links.  Where the best container
stands in an article (or else in the main part), all of that is kept.  Elsewhere it is kept
together with its siblings: headings, lists, tables, quotations, bare text, paragraphs and
containers with a score close to the best, and in a container below the body every
block, unless they are mostly links.  The text is the kept blocks in page order.

Pages are independent, so the job is one pass over the rows without a shuffle.

Defined results: null, empty or contentless html gives an empty text; html without
any tags is one paragraph; character references are decoded as in HTML (``&amp`` without
semicolon too, unknown ones stay); a tag cut off at the end of the page is dropped;
nesting has no limit (no recursion, and open tags are found by name, so a page takes time
in proportion to its length); repeated rows are extracted one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import table
from zonelens.session import prepare_workers

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option optgroup p pre search "
            "section summary table tbody td tfoot th thead tr ul".split())
NEVER = set("script style noscript iframe template textarea title xmp noembed noframes head nav footer aside form button "
            "select option input fieldset menu dialog svg canvas object audio video map search".split())
# Words of class, id and role that name parts of a page.
PARTS = set("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies "
            "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription share sharing "
            "social related recommended recommendations sidebar widget menu nav navbar navigation breadcrumb breadcrumbs "
            "pagination pager footer header masthead comment comments disqus reply replies respond login signup banner "
            "toolbar contentinfo complementary form dialog search skip hidden".split())
PLACES = set("list box container wrapper wrap left right top bottom bar item items block area section inner outer slot unit zone "
             "site page main global primary secondary link links post posts user reader group col column panel button buttons "
             "icon icons articles stories news topics row head foot up bottom sticky fixed".split())
COMMENTS = set("comment comments disqus reply replies respond".split())
GOOD = set("article body content entry main page post text blog story".split())
START = {"article": 25, "main": 15, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3,
         "ul": -3, "ol": -3, "dl": -3, "address": -3, "table": -3}
#: Blocks that belong to a text beside its container.
BESIDE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"table", "td", "th", "ul", "ol", "dl", "body", "html", "button"}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMING = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "kids", "names", "parts", "hidden", "score", "chars", "linked", "commas", "inside", "holds")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        self.tag, self.parent, self.kids = tag, parent, []
        self.names, self.parts, self.hidden = frozenset(), frozenset(), False
        self.inside = self.holds = False
        self.score, self.chars, self.linked, self.commas = 0.0, 0, 0, 0
        if attrs and not attrs.isspace():
            names, parts = set(), set()
            for m in _NAMING.finditer(attrs):
                key, value = m[1].lower(), (m[2] or "").strip("\"'")
                if key in ("class", "id", "role"):
                    for token in value.split():
                        words = {x.lower() for x in _NAME_PARTS.findall(token)}
                        names |= words
                        if words <= PARTS | PLACES:
                            parts |= words & PARTS
                elif key == "style":
                    self.hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                else:
                    self.hidden |= key == "hidden" or value.lower() == "true"
            self.names, self.parts = frozenset(names), frozenset(parts)


class _Open:
    """The open elements, and by name where they stand among them."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.blocks = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Closes the element at ``place`` and all within it."""
        for node in self.stack[place:]:
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.stack[place:]

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def end(self, tag: str) -> None:
        """An end tag: closes the element it names; one of an inline element does not
        reach out of its block."""
        place = self.last((tag,))
        if place and (tag in BLOCK or not self.blocks or place > self.blocks[-1]):
            self.close(place)

    def before(self, tag: str) -> None:
        """Closes what a start tag ends: paragraphs before blocks, items before items."""
        ends = CLOSED_BY.get(tag) or ({"p"} if tag in BLOCK else ())
        if not ends:
            return
        edge, place = self.last(SCOPE - set(ends)), self.last(ends)
        if place > edge:
            if tag in ("tr", "tbody"):  # the outermost of them
                place = min(x[i] for t in ends for x in (self.at[t],) if (i := bisect_right(x, edge)) < len(x))
            self.close(place)


def parse(page: str) -> Node:
    """The tree of a page; text nodes are decoded strings."""
    root = Node("#root", None)
    open_, at, size = _Open(root), 0, len(page)
    raw_ends: dict[str, re.Pattern] = {}
    while at < size:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            open_.stack[-1].kids.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name or not page.endswith(">", m.start(), m.end()):
            continue  # comment, declaration, or a tag cut off by the end
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            open_.end(tag)
            continue
        open_.before(tag)
        new = Node(tag, open_.stack[-1], attrs)
        new.parent.kids.append(new)
        if tag in RAW:
            pattern = raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I))
            end = pattern.search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attrs.endswith("/"):
            open_.push(new)
    return root


def never_content(node: Node) -> bool:
    tag = node.tag
    if tag in NEVER or node.hidden:
        return True
    if tag in ("html", "body"):
        return False
    if tag in ("article", "main"):
        return bool(node.parts & COMMENTS)
    if tag == "header":
        return not node.parent.inside or bool(node.parts - {"header"})
    return bool(node.parts)


def _prune_and_order(root: Node) -> list[Node]:
    """Takes out what is never content; the rest, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.inside = node.tag in ("article", "main") or node.parent is not None and node.parent.inside
        node.kids = [k for k in node.kids if isinstance(k, str) or not never_content(k)]
        stack.extend(k for k in node.kids if not isinstance(k, str))
    return order


def _measure(order: list[Node]) -> None:
    """Characters, characters in links and commas below each node, and whether it holds a
    block at any depth (an inline element may, where markup was never closed)."""
    for node in reversed(order):
        for k in node.kids:
            if isinstance(k, str):
                stripped = len(" ".join(k.split()))
                node.chars += stripped
                node.commas += k.count(",") + k.count("、") + k.count("，")
            else:
                node.chars += k.chars
                node.linked += k.linked
                node.commas += k.commas
                node.holds |= k.tag in BLOCK or k.holds
        if node.tag == "a":
            node.linked = node.chars


def _text(nodes: list[Node]) -> str:
    out, stack = [], list(reversed(nodes))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag in BLOCK or k.tag == "br":
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(k.kids))
        else:
            stack.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def paragraph_points(node: Node) -> float | None:
    """What a node passes to its ancestors; None for one that is no paragraph."""
    own_text = any(isinstance(k, str) and not k.isspace() for k in node.kids)
    paragraph = node.tag in PARAGRAPHS or (own_text and (node.tag in BLOCK or node.tag == "#root") and not node.holds)
    if not paragraph or not node.chars:
        return None
    points = min(node.chars / 100, 3) + node.commas + (1 if node.chars >= 25 else 0)
    points *= 1 - node.linked / node.chars
    return points * 0.25 if node.tag[0] == "h" else points  # headings stand outside content, too


def best_container(order: list[Node]) -> Node | None:
    """Scores the ancestors of the paragraphs (in ``score``) and returns the best."""
    scored: dict[int, Node] = {}
    for node in order:
        points = paragraph_points(node)
        if points is None:
            continue
        up, share, level = node.parent or node, 1.0, 1
        while up is not None and level <= 5:
            if id(up) not in scored:
                scored[id(up)] = up
                up.score = START.get(up.tag, 0) + (25 if up.names & GOOD else 0)
            up.score += points * share
            up, level = up.parent, level + 1
            share = 0.5 if level == 2 else 0.5 / (3 * (level - 2))
    best = None
    for node in scored.values():
        node.score *= 1 - (node.linked / node.chars if node.chars else 0)
        if node.score > 0 and (best is None or node.score > best.score):
            best = node
    return best or next(iter(scored.values()), None)


def _kept(k, best: Node, inner: bool) -> bool:
    """Does a sibling of the best container belong to the text?"""
    if isinstance(k, str) or k is best:
        return True
    links = k.linked / k.chars if k.chars else 1.0
    if k.tag == "p" and links == 0 and not inner and k.chars <= 80 and k.score < max(10.0, 0.2 * best.score):
        return _text([k]).endswith((".", "!", "?"))
    if links >= (0.5 if inner else 0.25):
        return False
    return inner or k.tag in BESIDE or k.tag not in BLOCK or k.score >= max(10.0, 0.2 * best.score)


def extract(page: str | None) -> str:
    if not page:
        return ""
    order = _prune_and_order(parse(page))
    _measure(order)
    if not order[0].chars:
        return ""
    best = best_container(order)
    if best is None:
        return ""
    around, up = {}, best
    while up is not None:
        around[up.tag] = up  # the outermost of each kind
        up = up.parent
    whole = around.get("article") or around.get("main")
    if whole is not None:
        return _text([whole])
    if best.parent is None:
        return _text([best])
    inner = best.parent.tag not in ("body", "html", "#root")
    return _text([k for k in best.parent.kids if _kept(k, best, inner)])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            texts = [extract(h if isinstance(h, str) else None) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    prepare_workers(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_tree_scoring(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
