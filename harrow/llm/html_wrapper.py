"""Main text of HTML pages by wrapper induction.

Pages of one host with the same outline form a group. The DOM of the group's first page (runs of like siblings drawn together)
is its template; every page's DOM is aligned with it by simple tree matching (the largest order- and parent-preserving set
of node pairs with equal labels). Over the different pages of the group (pages with equal headlines, or without one with equal text
outside of furniture, count once, so that copies don't make an article constant) a template node whose own text is nearly always
the same is constant, the others are slots. The content is found by what varies: from the root down, always the container that holds most of the
slots' text (DOMINANT), up to where blocks of varying text stand side by side. Siblings of one name are told apart by their
shape (blocks, containers, bare text), so this needs no names. Names are a prior at its borders: what elements, classes, ids and roles
call furniture is no content, as menus vary from page to page too; article or main elements of the template that hold slots and lie in
the content, or around it, give the exact borders. Text that has no partner in
the template counts for the nearest ancestor that has one. A page's text is that of its nodes aligned with the content, without
furniture and without the own text of constant nodes (headings in an article are never taken for constant); article or
main elements of a page that the template lacks are content as well. If nothing varies, nothing is constant. The column aligned
says whether a page's content was found by alignment.

Outlines end at a depth of DEPTH and draw more than RUNS runs of like siblings together by label, whatever their order; what is
deeper belongs to its ancestor at that depth, as slot or constant.

Defined results: null, empty and text-free pages give ""; pages without a host form the group of the empty host; unclosed and
stray tags are repaired; text outside of any tag is content; rows repeat as they are; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

CONSTANT, LEAST_PAGES, DEPTH, RUNS = 0.8, 4, 24, 32
#: Templates up to this size are broadcast; beyond it they are joined by group.
BROADCAST_BYTES = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture".split())
#: Elements that are never the article's text.
FURNITURE = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu head title audio video map datalist".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
#: Words of class, id and role that mark furniture.
MARKS = frozenset(
    "nav navbar navigation menu menubar submenu header masthead topbar footer foot sidebar side aside ad ads adv advert advertisement adverts adbox adsense banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login register share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations breadcrumb breadcrumbs pagination pager pagenav widget widgets "
    "toolbar search searchbox form copyright legal disclaimer skip tags complementary contentinfo outbrain taboola paywall".split()
)
#: Elements that hold text themselves; the content is never one of them but the container around.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot tr td th address details summary hr".split())
#: What an opening tag closes, up to the nearest of the boundary elements.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_MARK = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "hidden", "children", "label")

    def __init__(self, tag: str, names: str = "", hidden: bool = False) -> None:
        self.tag, self.names, self.hidden = tag, names, hidden
        self.children: list[Node | str] = []
        self.label = f"{tag}.{names}" if names else tag


def parse(page: str) -> Node:
    """The page's DOM; text is unescaped."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].children.append(entities.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in NO_PARAGRAPH:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in CLOSES:
            closes, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in closes:
                    del stack[i:]
                    if tag != "tr":
                        break
        names, hidden = "", False
        if len(m[3]) > 4:
            for name, value in _ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif name in ("class", "id", "role", "itemprop"):
                    names = f"{names} {value}".strip()
        node = Node(tag, names, hidden)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def is_region(node: Node) -> bool:
    return node.tag in ("article", "main") or "articlebody" in node.names or "main" in node.names.split() and node.tag in ("div", "section")


def is_furniture(node: Node, inside: bool) -> bool:
    """inside: within an article, whose header (with its headings) belongs to it."""
    if node.hidden or node.tag in FURNITURE:
        return True
    if node.tag == "header":
        return not inside
    if not node.names or node.tag in ("html", "body") or node.tag == "main":
        return False
    found = set(_MARK.findall(node.names)) & MARKS
    if node.tag in ("article",) or re.fullmatch(r"h[1-6]", node.tag):
        found &= {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related", "teaser"}
    return bool(found - {"header"} if inside else found)


def blocks_in(node: Node) -> list[Node]:
    """The nearest nodes below node that aren't inline elements."""
    out: list[Node] = []
    work = list(reversed(node.children))
    while work:
        x = work.pop()
        if isinstance(x, Node):
            if x.tag in INLINE:
                work.extend(reversed(x.children))
            else:
                out.append(x)
    return out


def blocks(nodes: list[Node | str], inside: bool, drop: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below nodes, without furniture and the own text of nodes whose id() is in drop."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = _SPACE.sub(" ", "".join(line)).strip()
            line.clear()
            if text:
                out.append(text)

    work: list = list(reversed(nodes))
    while work:
        x = work.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif is_furniture(x, inside):
            if x.tag not in INLINE and x.tag not in ("script", "style"):
                close()
        elif id(x) in drop:
            close()
            work.append(None)
            work.extend(reversed(blocks_in(x)))
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in INLINE:
            work.extend(reversed(x.children))
        else:
            close()
            work.append(None)
            if inside and x.tag == "header":
                work.extend(reversed(headings(x)))
            else:
                work.extend(reversed(x.children))
    close()
    return out


def headings(node: Node) -> list[Node]:
    """The headings below node, in order."""
    out: list[Node] = []
    work = list(reversed(node.children))
    while work:
        x = work.pop()
        if isinstance(x, Node):
            if re.fullmatch(r"h[1-6]|hgroup", x.tag):
                out.append(x)
            else:
                work.extend(reversed(x.children))
    return out


def regions(root: Node) -> list[Node]:
    """Explicit article or main elements that are not furniture; of nested ones the outermost main or article."""
    found: list[Node] = []
    work: list[Node] = [root]
    while work:
        x = work.pop()
        if is_region(x) and not is_furniture(x, True):
            found.append(x)
            continue
        if x is root or not is_furniture(x, False):
            work.extend(c for c in reversed(x.children) if isinstance(c, Node))
    for x in found:  # a main that holds articles stands for them, but its articles are the text
        if x.tag != "article" and (inner := [c for c in regions_below(x)]):
            found[found.index(x)] = inner[0]
            found.extend(inner[1:])
    return found


def regions_below(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not is_furniture(c, True):
            if c.tag == "article":
                yield c
            else:
                yield from regions_below(c)


# -- Templates -----------------------------------------------------------------------------------------------------

#: A drawn-together tree: (label, children).
Tree = tuple
#: Between a label and the shape of what the node holds.
SHAPE = "\x1f"
#: A container with at least this share of what varies in its parent goes on being the content; its siblings don't.
DOMINANT = 0.5
#: But containers of blocks with at least this share belong together.
BESIDE = 0.2


def shaped(node: Node) -> str:
    """The label with the node's shape: text in blocks of their own (b), containers (c), nothing but bare text (t), or nothing. So siblings of
    one name that hold different things aren't drawn together, whatever they are called."""
    if node.tag in TEXTUAL or node.tag in ("#root", "html", "body"):
        return node.label
    tags = {c.tag for c in node.children if isinstance(c, Node) and c.tag not in INLINE}
    shape = "b" if tags & (TEXTUAL - {"ul", "ol", "hr"}) else "c" if tags else "t" if any(not isinstance(c, str) or c.strip() for c in node.children) else ""
    return f"{node.label}{SHAPE}{shape}"


def _named(label: str) -> Node:
    """A node of a template's label."""
    tag, _, names = label.partition(SHAPE)[0].partition(".")
    return Node(tag, names)


def outline(node: Node) -> tuple[Tree, list[list[Node]]]:
    """The tree without texts and inline elements, runs of like siblings as one; and the DOM nodes of each of its nodes, in preorder."""
    order: list[list[Node]] = []

    def below(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
        runs: list[tuple[str, list[Node]]] = []
        for x in nodes:
            for c in x.children:
                if isinstance(c, Node) and c.tag not in INLINE:
                    label = shaped(c)
                    if runs and runs[-1][0] == label:
                        runs[-1][1].append(c)
                    else:
                        runs.append((label, [c]))
        merged: dict[str, list[Node]] = {}
        if len(runs) > RUNS:  # long alternations are drawn together by label
            for label, group in runs:
                merged.setdefault(label, []).extend(group)
            runs = list(merged.items())
        return runs

    def draw(label: str, nodes: list[Node], depth: int) -> Tree:
        order.append(nodes)
        return (label, tuple(draw(k, g, depth + 1) for k, g in below(nodes)) if depth < DEPTH else ())

    return draw(node.label, [node], 0), order


def group_of(url: str | None, tree: Tree) -> str:
    """Host and outline: the labels below body."""
    host = re.match(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    body = next((t for t in _walk(tree, 3) if t[0].split(".")[0] == "body"), tree)
    return (host[1].lower() if host else "") + " " + "|".join(dict.fromkeys(c[0].partition(SHAPE)[0] for c in body[1]))


def _walk(tree: Tree, depth: int) -> Iterator[Tree]:
    yield tree
    if depth:
        for c in tree[1]:
            yield from _walk(c, depth - 1)


def _preorder(tree: Tree) -> Iterator[Tree]:
    yield tree
    for c in tree[1]:
        yield from _preorder(c)


def match_trees(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: preorder numbers of a's nodes to those of their partners in b."""

    def sizes(t: Tree, into: list[int]) -> int:
        k = len(into)
        into.append(0)
        into[k] = 1 + sum(sizes(c, into) for c in t[1])
        return into[k]

    size_a: list[int] = []
    size_b: list[int] = []
    sizes(a, size_a)
    sizes(b, size_b)

    def match(x: Tree, i: int, y: Tree, j: int) -> tuple[int, list[tuple[int, int]]]:
        if x[0] != y[0]:
            return 0, []
        at_x, at_y, k = [], [], i + 1
        for _ in x[1]:
            at_x.append(k)
            k += size_a[k]
        k = j + 1
        for _ in y[1]:
            at_y.append(k)
            k += size_b[k]
        best = [[(0, [])] * (len(at_y) + 1) for _ in range(len(at_x) + 1)]
        for p, c in enumerate(x[1], 1):
            for q, d in enumerate(y[1], 1):
                top = max(best[p - 1][q], best[p][q - 1], key=lambda z: z[0])
                if c[0] == d[0]:
                    n, pairs = match(c, at_x[p - 1], d, at_y[q - 1])
                    if best[p - 1][q - 1][0] + n > top[0]:
                        top = (best[p - 1][q - 1][0] + n, best[p - 1][q - 1][1] + pairs)
                best[p][q] = top
        n, pairs = best[-1][-1]
        return n + 1, [(i, j), *pairs]

    return dict(match(a, 0, b, 0)[1])


def headline(root: Node) -> str:
    """Text of the page's first h1 outside of furniture."""
    for x in headings(root):
        if x.tag == "h1" and (text := own_text([x])):
            return text
    return ""


def own_text(nodes: list[Node]) -> str:
    """Text that stands in the nodes themselves or in inline elements in them."""
    out: list[str] = []
    work: list = [c for x in reversed(nodes) for c in reversed(x.children)]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in INLINE:
            work.extend(reversed(x.children))
    return _SPACE.sub(" ", " ".join(out)).strip()


def page_texts(order: list[list[Node]], tree: Tree, pairs: dict[int, int]) -> list[tuple[int, str]]:
    """(template node, own text) outside of furniture; text in blocks below node k that have no partner comes as node -1 - k. Containers that have
    none say nothing about the template."""
    out: list[tuple[int, str]] = []
    lone: dict[int, list[str]] = {}
    k = 0

    def below(t: Tree, near: int, block: bool) -> None:
        nonlocal k
        nodes = [x for x in order[k] if not is_furniture(x, False)]
        partner = pairs.get(k)
        k += 1
        block = partner is not None or block and order[k - 1][0].tag in TEXTUAL
        if block and (text := own_text(nodes)):
            if partner is None:
                lone.setdefault(near, []).append(text)
            else:
                out.append((partner, text))
        if nodes:
            for c in t[1]:
                below(c, near if partner is None else partner, block)
        else:
            k += sum(map(_size, t[1]))

    below(tree, 0, True)
    return out + [(-1 - near, "\n".join(texts)) for near, texts in lone.items()]


def _size(tree: Tree) -> int:
    return 1 + sum(map(_size, tree[1]))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Wrapper:
    """A group's template with what its nodes are."""

    def __init__(self, tree: Tree, stats: dict[int, tuple[int, int, int]]) -> None:
        """stats: node (-1 - node for text without a partner) to (different pages, those with the commonest text, characters)."""
        self.tree = tree
        self.constant = frozenset(k for k, (n, top, _) in stats.items() if n >= LEAST_PAGES and top >= CONSTANT * n)
        mass: Counter = Counter()
        for k, (_, _, c) in stats.items():
            if k not in self.constant:
                mass[k if k >= 0 else -1 - k] += c
        lone = frozenset(-1 - k for k, (_, _, c) in stats.items() if k < 0 and k not in self.constant and c)
        enough = max((n for n, _, _ in stats.values()), default=0) >= LEAST_PAGES
        main, regions = self._content(mass, lone, DOMINANT if enough else 1.0), self._regions(mass)
        end = {k: k + _size(t) for k, t in enumerate(_preorder(tree))}
        within = frozenset(k for k in regions if main <= k < end[main])
        around = frozenset(k for k in regions if k < main < end[k])
        #: Article and main elements in the content, or around it, give it its exact borders; elsewhere they don't count.
        self.regions = regions if not mass else within or around
        self.content = self.regions or frozenset([main])
        if not mass:
            self.constant = frozenset()
        self.aligned: dict[Tree, dict[int, int]] = {}

    def _regions(self, mass: dict[int, int]) -> frozenset[int]:
        """Article and main nodes of the template (of nested ones the articles) that hold slots, or all if nothing varies."""
        found: dict[int, int] = {}

        def below(t: Tree, k: int, inside: int) -> int:
            """The number after k's subtree; inside: the region around, or -1."""
            node = _named(t[0])
            hidden = is_furniture(node, inside >= 0)
            if not hidden and is_region(node) and (inside < 0 or node.tag == "article" and self.labels[inside] != "article"):
                found.pop(inside, None)  # a main that holds articles stands for them
                inside = k
                found[k] = 0
            if inside in found and not hidden:
                found[inside] += mass.get(k, 0)
            at = k + 1
            for c in t[1]:
                at = below(c, at, inside) if not hidden else at + _size(c)
            return at

        self.labels = [_named(t[0]).tag for t in _preorder(self.tree)]
        below(self.tree, 0, -1)
        return frozenset(k for k, n in found.items() if n or not mass)

    def _content(self, mass: dict[int, int], lone: frozenset[int], share: float) -> int:
        """From the root down, the container that holds most of what varies (share), as long as there is one that isn't a block of text and
        no blocks of varying text, or large containers of such, stand beside it. lone: nodes with such blocks that the template's page lacks."""

        def total(t: Tree, k: int) -> tuple[int, int]:
            """Characters of slots in and below k, and the number after k's subtree."""
            tags.append(_named(t[0]).tag)
            shapes.append(t[0].partition(SHAPE)[2])
            hidden = is_furniture(_named(t[0]), False)
            own = 0 if hidden else mass.get(k, 0)
            at = k + 1
            kids = []
            for c in t[1]:
                n, after = total(c, at)
                kids.append((n, at))
                at = after
            if hidden:
                kids = []
            sums[k] = (own + sum(n for n, _ in kids), kids)
            return sums[k][0], at

        sums: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        tags: list[str] = []
        shapes: list[str] = []
        total(self.tree, 0)
        k = 0
        while sums[k][0] and (kids := [x for x in sums[k][1] if tags[x[1]] not in TEXTUAL]) and (best := max(kids))[0] >= share * sums[k][0]:
            beside = [(n, i) for n, i in sums[k][1] if n and i != best[1]]
            if k in lone or any(tags[i] in TEXTUAL or shapes[i] == "b" and n >= BESIDE * sums[k][0] for n, i in beside):
                break  # headings and paragraphs beside it belong to it
            k = best[1]
        return k

    def text(self, root: Node, tree: Tree, order: list[list[Node]]) -> tuple[str, bool]:
        """The page's text, and whether alignment found its content."""
        pairs = self.aligned.get(tree)
        if pairs is None:
            if len(self.aligned) > 1000:
                self.aligned.clear()
            pairs = self.aligned[tree] = match_trees(tree, self.tree)
        roots = [x for k, nodes in enumerate(order) if pairs.get(k) in self.content for x in nodes]
        aligned, inside = bool(roots), bool(self.regions)
        if lone := [x for x in regions(root) if not any(x is y for r in roots for y in _nodes(r))]:
            if inside or not aligned:
                wanted = {id(x) for x in (*roots, *lone)}
                roots = [x for x in _nodes(root) if id(x) in wanted]
                inside = True
        constant = frozenset(
            id(x) for k, nodes in enumerate(order) if pairs.get(k) in self.constant for x in nodes if not (inside and re.fullmatch(r"h[1-6]|hgroup", x.tag))
        )
        return "\n\n".join(blocks(roots or [root], inside, constant)), aligned


def _nodes(node: Node) -> Iterator[Node]:
    """node and what is below it, in page order."""
    work = [node]
    while work:
        x = work.pop()
        yield x
        work.extend(c for c in reversed(x.children) if isinstance(c, Node))


def _templates(pages: DataFrame) -> DataFrame:
    """group, tree: the outline of each group's page with the smallest id (a tree's text decides ties)."""

    def first():
        best: dict[str, tuple] = {}

        def block(ids, urls, htmls):
            seen = {}
            for page_id, url, page in zip(ids, urls, htmls):
                tree, _ = outline(parse(page or ""))
                group, rank = group_of(url, tree), (page_id is None, page_id or 0, repr(tree))
                if group not in best or rank < best[group]:
                    best[group] = seen[group] = rank
            if len(best) > 100_000:
                best.clear()
            return {"group": list(seen), "none": [r[0] for r in seen.values()], "id": [r[1] for r in seen.values()], "tree": [r[2] for r in seen.values()]}

        return block

    found = map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), first, "group string, none boolean, id long, tree string")
    return found.groupBy("group").agg(F.min(F.struct("none", "id", "tree")).alias("best")).select("group", F.col("best.tree").alias("tree"))


def _with_template(pages: DataFrame, templates: DataFrame, most: int, f, schema: str) -> DataFrame:
    """Apply f, which gets a function for the template rows by group, to blocks of pages.

    Templates of up to most bytes are broadcast; others are joined by group, with the pages compressed.
    """
    if (templates.agg(F.sum(F.length("tree") + F.length("group"))).first()[0] or 0) <= most:
        known = pages.sparkSession.sparkContext.broadcast({r.group: r for r in templates.collect()})
        return map_rows(pages, lambda: f(lambda: known.value), schema)
    import zlib

    def keyed():
        def block(ids, urls, htmls):
            return {"page_id": ids, "url": urls, "html": [zlib.compress((h or "").encode(), 1) for h in htmls], "group": [group_of(u, outline(parse(h or ""))[0]) for u, h in zip(urls, htmls)]}

        return block

    with_group = map_rows(pages, keyed, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, html binary, group string")
    joined = with_group.join(templates.select(F.col("group").alias("of"), F.struct(*templates.columns).alias("template")), F.col("group") == F.col("of"))

    def unpacked():
        def block(templates_, ids, urls, htmls):
            from types import SimpleNamespace

            rows = {t["group"]: SimpleNamespace(**t) for t in templates_}
            return f(lambda: rows)(ids, urls, [zlib.decompress(h).decode() for h in htmls])

        return block

    return map_rows(joined.select("template", "page_id", "url", "html"), unpacked, schema)


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, aligned for each row of pages (page_id, url, html)."""
    import ast

    pages = pages.select("page_id", "url", "html")
    templates = table(_templates(pages), "templates")

    def slots(known):
        trees: dict[str, Tree] = {}
        aligned: dict[tuple, dict[int, int]] = {}

        def block(ids, urls, htmls):
            out: dict[tuple[str, int], tuple[int, list[dict]]] = {}
            for url, page in zip(urls, htmls):
                root = parse(page or "")
                tree, order = outline(root)
                group = group_of(url, tree)
                if group not in trees:
                    trees[group] = ast.literal_eval(known()[group].tree)
                pairs = aligned.get((group, tree))
                if pairs is None:
                    if len(aligned) > 5000:
                        aligned.clear()
                    pairs = aligned[group, tree] = match_trees(tree, trees[group])
                found = page_texts(order, tree, pairs)
                digest = _hash(repr(found))
                title = headline(root)
                key = (group, _hash("h " + title) if title else digest)
                if key not in out or digest < out[key][0]:
                    out[key] = digest, [{"node": k, "hash": _hash(text), "chars": len(text)} for k, text in found]
            return {"group": [k[0] for k in out], "page": [k[1] for k in out], "first": [{"digest": d, "texts": x} for d, x in out.values()]}

        return block

    found = _with_template(pages, templates, broadcast_bytes, slots, "group string, page long, first struct<digest: long, texts: array<struct<node: int, hash: long, chars: long>>>")
    # of pages with equal headlines one counts, whatever the partitions
    different = found.groupBy("group", "page").agg(F.min("first").alias("first")).select("group", F.explode("first.texts").alias("t")).select("group", "t.*")
    by_text = different.groupBy("group", "node", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    by_node = by_text.groupBy("group", "node").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("chars").alias("chars"))
    stats = by_node.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("node", "n", "top", "chars"))).alias("stats"))  # a few a template
    wrappers = table(templates.join(stats.withColumnRenamed("group", "g"), F.col("group") == F.col("g"), "left").select("group", "tree", "stats"), "wrappers")

    def texts(known):
        wrapped: dict[str, Wrapper] = {}

        def block(ids, urls, htmls):
            out, aligned = [], []
            for url, page in zip(urls, htmls):
                if not page:
                    out.append("")
                    aligned.append(False)
                    continue
                root = parse(page)
                tree, order = outline(root)
                group = group_of(url, tree)
                if group not in wrapped:
                    row = known()[group]
                    wrapped[group] = Wrapper(ast.literal_eval(row.tree), {s["node"]: (s["n"], s["top"], s["chars"]) for s in row.stats or []})
                text, found = wrapped[group].text(root, tree, order)
                out.append(text)
                aligned.append(found)
            return {"page_id": ids, "url": urls, "text": out, "n_chars": [len(t) for t in out], "aligned": aligned}

        return block

    kind = pages.schema["page_id"].dataType.simpleString()
    return _with_template(pages, wrappers, broadcast_bytes, texts, f"page_id {kind}, url string, text string, n_chars long, aligned boolean")
