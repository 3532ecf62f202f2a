"""Main text of web pages by wrapper induction.

Pages of one host are laid over a reference page of that host by simple tree matching: two nodes match if their
labels agree and their children, in order, match as well as they can.  A reference node that has the same text on
nearly all pages laid over it is template; places whose text varies are slots.  The template of a host is the
reference's tree with counts from *all* of the host's pages.  Pages with the same longest block have one vote
together: copies and near copies of an article don't make it template.  Copies are dealt by that block and counts
added up before they are shuffled, so a host with a third of all pages is no heavier than one with ten.

The main region is where the slots are: down from the reference's root as long as one child has most of the varying text
that isn't link text.  Article elements are a labelled candidate: they are the region where the host's counts put most
of the varying text into them, or where there are too few pages to count; else the induced region is.  A page of a
host without a template or article goes by names that sites give to their content, then by density.  Within the region,
of whichever origin, constant nodes go, unless they are a large part of it: template is little beside an article.

Text: character references decoded, white space within a block one space, blocks joined by line feeds.  Within the
region paragraphs stay whatever their names; containers go if their names, or a heading over them, say that they are
another part.  Formulas, captions and the text of embedded objects are text; what a browser shows only in place of media
that it can't play is not.

Defined cases: null and empty html give an empty text; a url without a host forms a host of its own ("");
a host with few pages has no template, so only the page's own structure speaks; rows that repeat are kept; damaged
markup closes where its parent closes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, ready

# Roles of elements and names that sites give to parts that aren't the article.
RAW = frozenset("script style textarea title noscript template iframe svg xmp annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("head nav aside footer form button select dialog menu audio video canvas input fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_NEXT = {"p": frozenset("p div ul ol dl table section article aside header footer nav main form pre blockquote h1 h2 h3 h4 h5 h6 hr figure fieldset address li dd dt".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
OTHER_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|paywall|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side|rail|widget\w*|footer\w*|masthead|topbar|"
    r"comment\w*|disqus|respon[ds]\w*|discussion|replies|share|sharing|social|related|recommend\w*|login|signup|search\w*|toolbar|pagination|pager|skip\w*|tags?|byline-actions|copyright|legal)(?:$|[\s_-])",
    re.I,
)
#: Names of containers, in parts between hyphens, that are no part of an article even within it; the first few also for paragraphs.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored notice".split())
WITHIN = ADVERTS | frozenset("promo comment comments disqus respond responses replies discussion newsletter subscribe paywall share sharing social related recommended recommendations sidebar nav navbar navigation menu breadcrumb breadcrumbs consent popup modal overlay widget pagination pager login signup".split())
COMMENTS = frozenset("comment comments reply replies disqus respond responses discussion".split())
CONTENT = frozenset("article post entry hentry story".split())
PARAGRAPHS = frozenset("p li dt dd blockquote pre td th tr figure figcaption caption address object h1 h2 h3 h4 h5 h6".split())
COMMENT_HEADING = re.compile(r"\s*(?:[0-9]+\s+)?(?:(?:reader|user)s?'?\s+)?(?:comments?|replies|responses|discussion|kommentare|commentaires|comentarios)\b.{0,20}\Z", re.I | re.S)
MAIN_PARTS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body-text|article-body)(?:$|[\s_-])", re.I)
OTHER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANK = re.compile(r"\s+")
#: A reference node is template if this share of the pages laid over it have its text, of at least so many pages.
SAME_SHARE, LEAST_PAGES = 0.7, 3
#: Share of a host's varying text that makes its article elements the region; share of a region that can be template.
ARTICLE_SHARE, MOST_CONSTANT = 0.5, 1 / 3
#: Elements deeper than this are flattened.
DEPTH = 150
#: Templates are broadcast up to this many bytes in all; beyond, they are joined by host.
BROADCAST_BYTES = 16 << 20


class Node:
    """A block of a page; inline elements are part of its text."""

    __slots__ = ("tag", "label", "names", "children", "text", "link_chars", "id")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names = tag, names
        self.label = f"{tag}.{names}" if names else tag
        self.children: list[Node | str] = []
        self.text: str | None = None
        self.link_chars = 0
        self.id = -1

    @property
    def nodes(self) -> list[Node]:
        return [c for c in self.children if type(c) is Node]


def _attributes(raw: str) -> tuple[str, str, bool]:
    """(class and id, role, hidden)"""
    if "=" not in raw:
        return "", "", " hidden" in raw
    names, role, hidden = [], "", False
    for key, a, b, c in _ATTRIBUTE.findall(raw):
        k = key.lower()
        if k in ("class", "id"):
            names.append(a or b or c)
        elif k in ("itemprop", "itemtype") and "comment" in (a or b or c).lower():
            names.append("comment")
        elif k == "role":
            role = (a or b or c).lower()
        elif k == "style":
            hidden = "display:none" in (a or b or c).replace(" ", "").lower()
    return " ".join(names), role, hidden


def parse(html: str) -> Node:
    """The tree of blocks.  Unclosed elements end with their parents; stray end tags are passed over."""
    root = Node("#root")
    stack, open_inline = [root], 0  # links that are open
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            piece = html[at : m.start()]
            stack[-1].children.append(piece)
            if open_inline:
                stack[-1].link_chars += len(piece)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        if tag in INLINE:
            if tag == "a":
                open_inline = 0 if closing else 1
            elif tag == "br":
                stack[-1].children.append(" ")
            continue
        if closing:
            if tag == "p" and stack[-1].tag != "p":
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    open_inline = 0
                    break
            continue
        raw = m[3] if m[2] else m[6] or ""
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at) if not raw.endswith("/") else None
            if not raw.endswith("/"):
                at = stop.end() if stop else end
            continue
        if tag == "body" or tag == "html":
            continue
        closes = stack[-1].tag in CLOSED_BY_NEXT and tag in CLOSED_BY_NEXT[stack[-1].tag]
        while closes and len(stack) > 1:
            stack.pop()
            closes = stack[-1].tag in CLOSED_BY_NEXT and tag in CLOSED_BY_NEXT[stack[-1].tag]
        names, role, hidden = _attributes(raw)
        if role in OTHER_ROLES or hidden:
            names = f"{names} sidebar"
        elif role == "main":
            tag = "main"
        node = Node(tag, names)
        stack[-1].children.append(node)
        # Beyond the depth a block still ends the text before it, but what it holds counts as its parent's.
        if tag not in VOID and not raw.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
            open_inline = 0
    return root


def _clean(pieces: list[str]) -> str:
    return _BLANK.sub(" ", unescape("".join(pieces))).strip()


def own_text(node: Node) -> str:
    """Text directly within a node, inline elements included."""
    if node.text is None:
        node.text = _clean([c for c in node.children if type(c) is str])
    return node.text


_SEAMS = re.compile(r"[\s_-]+")


def _parts(names: str) -> frozenset[str]:
    return frozenset(_SEAMS.split(names.lower()))


def is_comment(node: Node) -> bool:
    """Reader comments, by name or by the heading over them."""
    tokens = node.names.lower().split()
    if any(_SEAMS.split(t)[0] in COMMENTS for t in tokens) and CONTENT.isdisjoint(tokens):
        return True
    first = next(iter(node.nodes), None)
    return node.tag in ("div", "section", "article") and first is not None and first.tag in HEADINGS and bool(COMMENT_HEADING.match(own_text(first)))


def other_part(node: Node, inside: bool) -> bool:
    """By element, names and headings: is this not the article?  ``inside``: within the main region."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if not inside:
        return bool(node.names) and bool(OTHER_PARTS.search(node.names)) and node.tag != "article" or is_comment(node)
    if not node.names and node.tag not in ("div", "section", "article"):
        return False
    names = _parts(node.names) if node.names else frozenset()
    if node.tag in PARAGRAPHS:
        return not ADVERTS.isdisjoint(names)
    if "cookie" in names and not names.isdisjoint(("banner", "bar", "policy", "message")):
        return True
    return not WITHIN.isdisjoint(names) and not MAIN_PARTS.search(node.names) or is_comment(node)


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching of two nodes with equal labels: number of matched nodes; the pairs, if wanted.

    Children that agree in label from either end are matched outright; dynamic programming aligns what is between.
    """
    if pairs is not None:
        pairs.append((a, b))
    x, y = a.nodes, b.nodes
    total, lo = 1, 0
    while lo < len(x) and lo < len(y) and x[lo].label == y[lo].label:
        total += match(x[lo], y[lo], pairs)
        lo += 1
    hx, hy = len(x), len(y)
    while hx > lo and hy > lo and x[hx - 1].label == y[hy - 1].label:
        hx -= 1
        hy -= 1
        total += match(x[hx], y[hy], pairs)
    x, y = x[lo:hx], y[lo:hy]
    if not x or not y:
        return total
    weight: dict[tuple[int, int], int] = {}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x, 1):
        for j, q in enumerate(y, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if p.label == q.label:
                weight[i, j] = match(p, q)
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + weight[i, j])
    total += best[-1][-1]
    if pairs is not None:
        i, j = len(x), len(y)
        while i and j:
            if (i, j) in weight and best[i][j] == best[i - 1][j - 1] + weight[i, j]:
                match(x[i - 1], y[j - 1], pairs)
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return total


def _text_key(node: Node) -> str:
    """Short name of a node's own text; the empty text has the empty name."""
    t = own_text(node)
    return "" if not t else t if len(t) <= 24 else f"{t[:12]}~{len(t)}~{hash_text(t)}"


def hash_text(t: str) -> int:
    import zlib

    return zlib.crc32(t.encode("utf-8", "surrogatepass"))


def _dump(node: Node) -> list:
    return [node.tag, node.names, _text_key(node), [_dump(c) for c in node.nodes]]


def _load(data: list, counter: list[int]) -> Node:
    node = Node(data[0], data[1])
    node.text, node.id = data[2], counter[0]
    counter[0] += 1
    node.children = [_load(c, counter) for c in data[3]]
    return node


def skeleton(html: str) -> str:
    return json.dumps(_dump(parse(html)), ensure_ascii=False, separators=(",", ":"))


class Template:
    """A host's reference tree; with counts, also its constant nodes, its main region and whether articles are it."""

    def __init__(self, tree: str, counts: list[tuple[int, int, int, int]] = ()):
        counter = [0]
        self.root = _load(json.loads(tree), counter)
        self._counts = {i: (n, same, varying) for i, n, same, varying in counts}
        self.pages = self._counts.get(0, (0, 0, 0))[0]
        self.constant, self.region, self.articles = frozenset(), -1, True
        if self.pages >= LEAST_PAGES:
            self.constant = frozenset(i for i, (n, same, _) in self._counts.items() if n >= LEAST_PAGES and same >= SAME_SHARE * n)
            self.region = self._main(self.root).id
            whole, held = self._weight(self.root), sum(map(self._weight, _article(self.root, self._weight)))
            self.articles = not whole or held >= ARTICLE_SHARE * whole

    def _weight(self, node: Node) -> int:
        """Varying text below a node, over all pages."""
        return 0 if other_part(node, False) else self._counts.get(node.id, (0, 0, 0))[2] + sum(map(self._weight, node.nodes))

    def _main(self, node: Node) -> Node:
        """Down from the root, as long as one child has most of the varying text."""
        while node.nodes:
            whole = self._weight(node)
            top = max(node.nodes, key=self._weight)
            if top.tag in PARAGRAPHS or self._weight(top) < 0.8 * whole or not whole:
                break
            node = top
        return node


def _article(root: Node, size=None) -> list[Node]:
    """Article elements that aren't within another part, or the main element.  Of several articles those with at least half
    as much text as the longest: teasers and remarks are shorter."""
    found: list[Node] = []
    main: list[Node] = []

    def walk(node: Node) -> None:
        for c in node.nodes:
            if other_part(c, False):
                continue
            if c.tag == "article":
                found.append(c)
            else:
                if c.tag == "main":
                    main.append(c)
                walk(c)

    walk(root)
    if len(found) > 1:
        sizes = list(map(size or _size, found))
        found = [x for x, n in zip(found, sizes, strict=True) if 2 * n >= max(sizes)]
    return found or main


def _size(node: Node) -> int:
    """Characters of text of a subtree that aren't link text."""
    return 0 if other_part(node, False) else max(0, len(own_text(node)) - node.link_chars) + sum(map(_size, node.nodes))


def _named(root: Node) -> Node | None:
    """The outermost block that a site names as its content, if it has half of the page's text."""
    least = _size(root) / 2
    todo = root.nodes
    while todo:
        node = todo.pop(0)
        if other_part(node, False) or not _size(node):
            continue
        if node.names and MAIN_PARTS.search(node.names) and _size(node) >= least:
            return node
        todo += node.nodes
    return None


def _densest(root: Node) -> Node:
    """Without a template or an article: down as long as one child has most of the text."""
    node = root
    while node.nodes:
        top = max(node.nodes, key=_size)
        if top.tag in PARAGRAPHS or _size(top) < 0.8 * _size(node) or not _size(node):
            break
        node = top
    return node


def blocks_of(node: Node, constant: set[int], inside: bool) -> list[str]:
    """Texts of a region in page order, without other parts; ``constant`` are identities of template nodes."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            t = _clean(run)
            if t:
                out.append(t)
            run.clear()

    def walk(n: Node, headings_only: bool) -> None:
        keep = id(n) not in constant and (not headings_only or n.tag in HEADINGS)
        for c in n.children:
            if type(c) is str:
                if keep:
                    run.append(c)
            else:
                flush()
                if not other_part(c, inside):
                    walk(c, headings_only or c.tag == "header")
                flush()

    walk(node, False)
    flush()
    return out


def extract(html: str | None, template: Template | None = None) -> str:
    """Main text of a page, with its host's template if there is one."""
    return extract_with(html, template)[0]


def extract_with(html: str | None, template: Template | None = None) -> tuple[str, str, int]:
    """(text, how the region was found, number of constant blocks in the page)"""
    if not html:
        return "", "none", 0
    root = parse(html)
    pairs: list[tuple[Node, Node]] = []
    constant: set[int] = set()
    region = None
    if template is not None and template.pages >= LEAST_PAGES:
        match(root, template.root, pairs)
        constant = {id(x) for x, r in pairs if r.id in template.constant and _text_key(x) == r.text}
        region = next((x for x, r in pairs if r.id == template.region), None)
        if region is not None and not _size(region):
            region = None
    constant_blocks = sum(id(x) in constant and bool(own_text(x)) for x, _ in pairs)
    # The template says whether the host's articles are its content; a page with articles that the template has no place for speaks for itself.
    regions = _article(root) if template is None or template.articles or region is None else []
    how = "article"
    if not regions:
        named = _named(region or root)
        how = "named" if named else "template" if region is not None else "density"
        regions = [named or region or _densest(root)]
    inside = how == "article"
    whole = [t for x in regions for t in blocks_of(x, set(), inside)]
    kept = [t for x in regions for t in blocks_of(x, constant, inside)]
    # Constants are little beside an article; where they are much, the pages are alike in their content.
    if sum(map(len, kept)) < (1 - MOST_CONSTANT) * sum(map(len, whole)) and (inside or not kept):
        kept = whole
    return "\n".join(kept), how, constant_blocks


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _with_templates(pages: DataFrame, templates: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with their host's template: broadcast if the templates' total size, which is summed, allows."""
    size = templates.select(*[F.length(F.col(c).cast("string")).cast("long").alias(c) for c in columns]).agg(F.sum(sum(F.coalesce(F.col(c), F.lit(0)) for c in columns)).alias("n"), F.count("*").alias("hosts")).first()
    small = (size["n"] or 0) + 64 * size["hosts"] <= BROADCAST_BYTES
    return pages.join(F.broadcast(templates) if small else templates, "host", "left")


def references(pages: DataFrame) -> DataFrame:
    """(host, tree): the tree of one page of each host, chosen by a hash of its id and html."""
    first = ready(pages).groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("page_id"), F.xxhash64("html"))).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(h or "") for h in b.column(1).to_pylist()], pa.string())], names=["host", "tree"])

    return first.mapInArrow(run, "host string, tree string")


def _overlay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, host and longest block: the reference nodes that a page is laid over, packed as (node, same, varying)."""
    for b in batches:
        trees: dict[str, Template] = {}
        found: dict[tuple[str, bytes], bytes] = {}
        for host, html, tree in zip(*(b.column(n).to_pylist() for n in ("host", "html", "tree")), strict=True):
            if not html or not tree:
                continue
            t = trees.get(host)
            if t is None:
                t = trees[host] = Template(tree)
            root = parse(html)
            pairs: list[tuple[Node, Node]] = []
            match(root, t.root, pairs)
            rows = []
            for x, r in pairs:
                same = _text_key(x) == r.text
                rows.append((r.id, same, 0 if same else max(0, len(own_text(x)) - x.link_chars)))
            key = host, hashlib.blake2b(max(blocks_of(root, set(), False), key=len, default="").encode("utf-8", "surrogatepass"), digest_size=16).digest()
            laid = np.array(rows, dtype="<u4").tobytes()
            found[key] = min(laid, found.get(key, laid))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary()), pa.array(list(found.values()), pa.binary())], names=["host", "content", "laid"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, host and reference node: contents laid over it, contents with its text, characters of other texts."""
    for b in batches:
        counts: dict[tuple[str, int], list[int]] = {}
        for host, laid in zip(b.column("host").to_pylist(), b.column("laid").to_pylist(), strict=True):
            for node, same, varying in np.frombuffer(laid, dtype="<u4").reshape(-1, 3).tolist():
                c = counts.setdefault((host, node), [0, 0, 0])
                c[0] += 1
                c[1] += same
                c[2] += varying
        rows = [(h, i, *c) for (h, i), c in counts.items()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["host", "node", "pages", "same", "varying"])


def induce(pages: DataFrame) -> DataFrame:
    """(host, tree, counts): the templates of all hosts, counted over all contents of their pages."""
    refs = references(pages)
    laid = _with_templates(pages.select("host", "html"), refs, ["tree"]).select("host", "html", "tree").mapInArrow(_overlay, "host string, content binary, laid binary")
    once = laid.groupBy("host", "content").agg(F.min("laid").alias("laid")).select("host", "laid")
    counted = once.mapInArrow(_count, "host string, node int, pages bigint, same bigint, varying bigint").groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), F.sum("varying").alias("varying"))
    listed = counted.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.col("node").cast("bigint"), "pages", "same", "varying")))).alias("counts"))
    return refs.join(listed, "host", "left")


def add_main_text(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(page_id, url, text, region, constant_blocks) of pages with a column host, given their hosts' templates: the main text, how
    its region was found and how many blocks of the page are template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, Template | None] = {}
            out: list[tuple[str, str, int]] = []
            for host, html, tree, counts in zip(*(b.column(n).to_pylist() for n in ("host", "html", "tree", "counts")), strict=True):
                if host not in known:
                    known[host] = Template(tree, [tuple(c) for c in json.loads(counts)]) if tree and counts else None
                out.append(extract_with(html, known[host]))
            text, how, constant = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(how, pa.string()), pa.array(constant, pa.int32())], names=["page_id", "url", "text", "region", "constant_blocks"])

    given = _with_templates(ready(pages).select("page_id", "url", "html", "host"), templates, ["tree", "counts"]).select("page_id", "url", "html", "host", "tree", "counts")
    return given.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, region string, constant_blocks int")


def extract_pages(pages: DataFrame) -> DataFrame:
    """The contract's rows."""
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    text = add_main_text(hosted, materialise(induce(hosted), "templates"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "region", "constant_blocks")
