"""Main text of web pages by wrapper induction.

Pages of a host are parsed to DOM trees and aligned by simple tree matching (the largest number of nodes
two trees can share in order, found by dynamic programming over child lists).  Runs of like siblings are
one node there (a list slot).  Aligned nodes whose text is the same on all pages are the template, nodes
whose text varies are slots.  The subtree that holds most of the varying text, apart from what its tag or
class marks as menu, header, footer, sidebar, notice, advert, form or comments, is the content; its text is
given in page order.  A page that has no partner, or no place in the wrapper, is read by its tags alone.
Names mark whole (``with-sidebar`` is no sidebar), and neither the page's main part nor all it has is clutter by name.

A host's pages are dealt over groups of about ``GROUP_PAGES`` (by a hash of the page_id), so that a hot host
fills many tasks; a wrapper is induced from one group.

Defined cases: null html is empty and gives empty text; a null or odd url belongs to the host ``""``;
unclosed and crossed tags are closed as browsers do, cut pages end where they end, an unclosed quote is a
character; pages may be nested to any depth; repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, narrowed, trimmed

#: Pages and bytes of one group, about.
GROUP_PAGES, GROUP_BYTES = 256, 8 << 20
#: Bytes of html that one task reads, about.
TASK_BYTES = 32 << 20
#: Hosts whose group counts are sent to every task, at most; beyond that they are joined.
SENT_HOSTS = 100_000
#: Distinct pages that a node must be the same on before it counts as template inside the content.
TEMPLATE_PAGES = 6
#: Share of a group's distinct pages that must have such a node.
TEMPLATE_PERCENT = 90

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in these up to their end tag is no text of the page; an end tag that is missing ends only scripts and styles with the page.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
TO_THE_END = frozenset(("script", "style"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var "
    # formulas and drawings stand in the line, as do the parts that lay them out
    "object svg g path rect circle ellipse line polyline polygon tspan textpath defs use symbol clippath mask lineargradient radialgradient stop "
    "pattern filter image marker math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mstyle mpadded mphantom merror menclose mfenced maction".split())
FOREIGN = frozenset(("svg", "math"))
#: Parts of drawings and formulas in which HTML may stand, and the HTML that ends an open drawing or formula elsewhere.
HTML_INSIDE = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SELECT_INSIDE = frozenset("option optgroup hr script template".split())
CLUTTER_TAGS = frozenset("nav footer aside form button head dialog menu select".split())
# Words of class names, ids and roles.  A name is clutter if it is made of nothing but these, one at least of the first.
_CLUTTER = frozenset(
    "ad ads advert adverts advertising advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup popups modal share sharing sharebar social "
    "comment comments disqus respond reply replies footer related recommend recommended recommendations newsletter subscribe signup login search pagination "
    "pager widget widgets masthead topbar toolbar skip siteheader pageheader".split())
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
_AROUND = frozenset(
    "site page main top bottom left right global primary secondary post article entry user reader readers header head bar box area wrapper wrap container "
    "list section block links link text content inner outer item items group panel form media icons buttons button side col column row thread body slot unit "
    "image link sticky fixed floating mobile desktop js".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*>"
    # quotes count only after the sign =; one that is never closed is an ordinary character
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>"
    r"|</?[a-zA-Z][^>]*\Z",  # the page ends inside a tag
    re.S,
)
_LABEL = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("tag", "label", "parts", "sign", "clutter", "named", "blocks")

    def __init__(self, tag: str, label: str = ""):
        self.tag, self.label = tag, label
        self.parts: list = []  # nodes and strings, in page order
        self.sign = -1
        self.clutter = False  # by tag or by label
        self.named = False  # by label alone
        self.blocks: list[list[Node]] | None = None


@lru_cache(maxsize=4096)
def _label(attributes: str) -> str:
    return " ".join(a or b or c for _, a, b, c in _LABEL.findall(attributes)).strip()


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[-_:.]+|(?<=[a-z])(?=[A-Z])|\d+", name) if w]


@lru_cache(maxsize=4096)
def clutter_name(label: str) -> bool:
    """Whether one of the names in ``label`` says menu, header, footer, sidebar, notice, advert, form or comments, whole:
    ``comment-list`` does, ``with-sidebar`` and ``social-science`` do not."""
    for name in label.split():
        words = [w.lower() for w in _words(name)]
        if words in (["site", "header"], ["page", "header"]):
            return True
        if any(w in _CLUTTER for w in words) and all(w in _CLUTTER or w in _AROUND for w in words):
            return True
    return False


def parse(page: str) -> Node:
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    opened: Counter = Counter()  # open elements by tag: nothing is searched for that is not there

    def shut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def close(tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return shut(i)
                if stack[i].tag in limits:
                    return

    def foreign() -> int:
        """Where the innermost open drawing or formula stands on the stack; 0 outside, and where HTML may stand inside."""
        if any(opened[t] for t in FOREIGN):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in HTML_INSIDE:
                    return 0
                if stack[i].tag in FOREIGN:
                    return i
        return 0

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close((tag,), ())
            continue
        if tag in ("html", "body"):
            continue
        own = foreign()
        if own and tag in ENDS_FOREIGN:
            shut(own)
            own = 0
        closed = m[3].endswith("/")
        if tag in RAW and not (own and closed):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in TO_THE_END and not closed:
                at = n
            continue
        if tag not in SELECT_INSIDE:
            close(("select",), ())
        if tag in CLOSES_P:
            close(("p",), ("article", "section", "div", "td", "li", "button"))
        elif tag in SAME:
            close(SAME[tag], ("ul", "ol", "dl", "table", "menu", "select"))
        node = Node(tag, _label(m[3]) if m[3] else "")
        node.named = bool(node.label) and tag not in CLUTTER_TAGS and tag != "main" and clutter_name(node.label)
        node.clutter = node.named or tag in CLUTTER_TAGS
        stack[-1].parts.append(node)
        if tag not in VOID and not closed:
            stack.append(node)
            opened[tag] += 1
    _reconsidered(root)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every node before those below it, and whether clutter stands above it."""
    todo = [(root, False)]
    while todo:
        node, dull = todo.pop()
        yield node, dull
        dull = dull or node.clutter
        todo += [(p, dull) for p in reversed(node.parts) if not isinstance(p, str)]


def _reconsidered(root: Node) -> None:
    """A name makes no clutter of what holds the page's main part or only article, nor of all that a page has."""
    named = [x for x, _ in _walk(root) if x.named]
    if not named:
        return
    free = any(x.tag == "article" and not dull and not x.clutter for x, dull in _walk(root))
    for x in named:
        x.clutter = False  # for the walk that follows
        inside = [y for y, dull in _walk(x) if not dull and not y.clutter]
        words = {w.lower() for w in _words(x.label.replace(" ", "-"))}
        holds = any(y.tag == "main" for y in inside) or (not free and not words & _COMMENTS and any(y.tag == "article" and not y.named for y in inside))
        x.clutter = not holds
    if not any(isinstance(p, str) and not p.isspace() for x, dull in _walk(root) if not dull and not x.clutter for p in x.parts):
        for x in named:
            x.clutter = False


def text_of(node: Node, skip=frozenset()) -> str:
    """Text without clutter and without the nodes in ``skip``; one space between words and blocks."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not (x.clutter or id(x) in skip):
            block = x.tag not in INLINE
            if block:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.parts)
    return " ".join(entities.unescape("".join(out)).split())


# --------------------------------------------------------------------- skeletons


class Signs:
    """Block structures, each known by a number: name, numbers of its children, count of its nodes, digest."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.names: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.digests: list[bytes] = []

    def of(self, name: str, kids: tuple[int, ...]) -> int:
        key = (name, kids)
        if key not in self.known:
            self.known[key] = len(self.names)
            self.names.append(name)
            self.kids.append(kids)
            self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            self.digests.append(hashlib.sha1(name.encode("utf-8", "surrogatepass") + b"\0" + b"".join(self.digests[k] for k in kids)).digest())
        return self.known[key]


def skeleton(root: Node, signs: Signs) -> int:
    """The number of ``root``'s block structure, with runs of like siblings as one child; ``node.sign`` keeps it."""
    todo = [(root, False)]
    while todo:
        node, below = todo.pop()
        if below:
            node.sign = signs.of(f"{node.tag}.{node.label}", tuple(g[0].sign for g in runs(node)))
        else:
            todo.append((node, True))
            todo += [(g[0], False) for g in runs(node)]
    return root.sign


def runs(node: Node) -> list[list[Node]]:
    """Child blocks in order, consecutive ones of the same tag and label together (inline ones are passed through)."""
    if node.blocks is None:
        out: list[list[Node]] = []
        todo = list(reversed(node.parts))
        while todo:
            part = todo.pop()
            if isinstance(part, str) or part.tag == "br":
                continue
            if part.tag in INLINE:
                todo += reversed(part.parts)
            elif out and out[-1][0].tag == part.tag and out[-1][0].label == part.label:
                out[-1].append(part)
            else:
                out.append([part])
        node.blocks = out
    return node.blocks


def tree_match(signs: Signs, a: int, b: int, memo: dict) -> int:
    """Simple tree matching: nodes that a and b share, roots matched."""
    if signs.names[a] != signs.names[b]:
        return 0
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if x == y or (x, y) in memo:
            todo.pop()
            continue
        by_name: dict[str, set[int]] = {}
        for k in signs.kids[y]:
            by_name.setdefault(signs.names[k], set()).add(k)
        need = [(i, j) for i in set(signs.kids[x]) for j in by_name.get(signs.names[i], ()) if i != j and (i, j) not in memo]
        if need:
            todo += need
        else:
            todo.pop()
            memo[x, y] = 1 + int(_rows(signs, x, y, memo)[0][-1])
    return signs.sizes[a] if a == b else memo[a, b]


def _rows(signs: Signs, a: int, b: int, memo: dict) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The last row of the matching table over the children, and for each row where it equals the row above, or its left neighbour."""
    kids = signs.kids[b]
    at: dict[int, list[int]] = {}
    for j, k in enumerate(kids):
        at.setdefault(k, []).append(j)
    row, above, beside = np.zeros(len(kids) + 1, dtype=np.int64), [], []
    shared: dict[int, np.ndarray] = {}
    for i in signs.kids[a]:
        if i not in shared:
            shared[i] = np.zeros(len(kids), dtype=np.int64)
            for k, places in at.items():
                if signs.names[k] == signs.names[i]:
                    shared[i][places] = signs.sizes[i] if i == k else memo[i, k]
        now = row.copy()
        now[1:] = np.maximum(row[1:], row[:-1] + shared[i])
        np.maximum.accumulate(now, out=now)
        above.append(np.packbits(now == row).tobytes())
        beside.append(np.packbits(np.r_[False, now[1:] == now[:-1]]).tobytes())
        row = now
    return row, above, beside


def align(signs: Signs, a: int, b: int, memo: dict) -> dict[int, int]:
    """Places of a's nodes (their rank before those below them) -> places of the nodes of b they are matched with."""
    out, todo = {}, [(a, b, 0, 0)]
    tree_match(signs, a, b, memo)
    while todo:
        x, y, i, j = todo.pop()
        if x == y:
            out.update(zip(range(i, i + signs.sizes[x]), range(j, j + signs.sizes[x]), strict=True))
            continue
        out[i] = j
        _, above, beside = _rows(signs, x, y, memo)
        starts = [np.cumsum([base + 1, *(signs.sizes[k] for k in signs.kids[z])]).tolist() for z, base in ((x, i), (y, j))]
        p, q = len(signs.kids[x]), len(signs.kids[y])
        bit = lambda bits, k: bits[k >> 3] >> (7 - (k & 7)) & 1
        while p and q:
            if bit(above[p - 1], q):
                p -= 1
            elif bit(beside[p - 1], q):
                q -= 1
            else:
                p, q = p - 1, q - 1
                todo.append((signs.kids[x][p], signs.kids[y][q], starts[0][p], starts[1][q]))
    return out


# ----------------------------------------------------------------------- wrapper


class Wrapper:
    """What the pages of a group have in common.  A place is a node of the model, the most frequent structure."""

    def __init__(self, trees: list[Node]):
        self.trees, signs = trees, Signs()
        counts: dict[int, int] = {}
        for t in trees:
            s = skeleton(t, signs)
            counts[s] = counts.get(s, 0) + 1
        self.signs = signs
        self.model = max(counts, key=lambda s: (counts[s], signs.sizes[s], signs.digests[s]))
        memo: dict = {}
        self.places = {s: align(signs, s, self.model, memo) if signs.names[s] == signs.names[self.model] else {} for s in counts}
        self.up, self.down = self._family()
        self.texts: dict[int, set[int]] = {}  # place -> hashes of its text, a few at most
        self.mass: dict[int, int] = {}  # place -> characters of its own text, over all pages
        self.held: dict[int, int] = {}  # place -> distinct pages that have text there
        self.lists: set[int] = set()
        self.names: dict[int, tuple[str, bool]] = {}
        known: set[int] = set()
        for t in trees:
            page = hash((t.sign, _strings(t)))
            self._read(t, page not in known)
            known.add(page)
        self.pages = len(known)
        self.above = {self.up[p] for p in self.names}  # places with places below
        self.root = self._content()

    def _family(self) -> tuple[list[int], list[int]]:
        """The place above each place, and the end of the places below it."""
        n = self.signs.sizes[self.model]
        up, down = [-1] * n, [0] * n
        todo = [(self.model, 0, -1)]
        while todo:
            s, at, over = todo.pop()
            up[at], down[at] = over, at + self.signs.sizes[s]
            begin = at + 1
            for k in self.signs.kids[s]:
                todo.append((k, begin, at))
                begin += self.signs.sizes[k]
        return up, down

    def nodes(self, tree: Node) -> Iterator[tuple[int, list[Node], bool]]:
        """(place, run of nodes, whether in clutter) for the matched nodes of a page."""
        places, rank = self.places[tree.sign], 0
        todo = [([tree], False)]
        while todo:
            group, dull = todo.pop()
            dull = dull or group[0].clutter
            if rank in places:
                yield places[rank], group, dull
            rank += 1
            todo += [(child, dull) for child in reversed(runs(group[0]))]

    @staticmethod
    def own(group: list[Node]) -> str:
        """Text that stands in the nodes themselves, not in blocks below."""
        out: list[str] = []
        todo: list = [part for node in reversed(group) for part in reversed(node.parts)]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag in INLINE or part.tag == "br":
                todo += reversed(part.parts)
        return " ".join("".join(out).split())

    def _read(self, tree: Node, new: bool) -> None:
        for place, group, dull in self.nodes(tree):
            if len(group) > 1:
                self.lists.add(place)
            own = "\n".join(self.own([g]) for g in group)
            seen = self.texts.setdefault(place, set())
            if own.strip():
                if len(seen) < TEMPLATE_PAGES + 1:
                    seen.add(hash(own))
                self.held[place] = self.held.get(place, 0) + new
            self.names[place] = (group[0].tag, dull)
            whole = sum(len(self.own([d])) for g in group for d in _blocks(g)) if len(group) > 1 else len(own)
            self.mass[place] = self.mass.get(place, 0) + (0 if dull else whole)

    def varies(self, place: int) -> bool:
        return len(self.texts.get(place, ())) > 1 or place in self.lists

    def _content(self) -> int | None:
        if len(self.trees) < 2:
            return None
        total: dict[int, int] = {}
        for place in sorted((p for p in self.mass if self.varies(p)), reverse=True):
            total[place] = total.get(place, 0) + self.mass[place]
        for place in range(len(self.up) - 1, 0, -1):  # those below come first
            if place in total:
                total[self.up[place]] = total.get(self.up[place], 0) + total[place]
        whole = total.get(0, 0)
        if not whole:
            return None
        marked = [p for p, (tag, dull) in self.names.items() if tag in ("article", "main") and not dull and total.get(p, 0) * 2 >= whole]
        if marked:
            return max(marked, key=lambda p: (self.names[p][0] == "article", total[p], p))
        children: dict[int, list[int]] = {}
        for p in total:
            children.setdefault(self.up[p], []).append(p)
        at = 0
        while True:
            best = max(children.get(at, ()), key=lambda p: (total[p], p), default=None)
            if best is None or total[best] * 10 < whole * 9 or best in self.lists:
                return at
            at = best

    def extract(self, tree: Node) -> str:
        if self.root is None:
            return plain(tree)
        at, skip = None, set()
        for place, group, dull in self.nodes(tree):
            if place == self.root and not dull:
                at = group
            elif at is not None and self.root <= place < self.down[self.root] and self._fixed(place):
                skip.update(id(g) for g in group)
        if at is None:
            return plain(tree)
        return " ".join(t for g in at if (t := text_of(g, skip))) or plain(tree)

    def _fixed(self, place: int) -> bool:
        """Template inside the content: one text on nearly all distinct pages, of several that do differ."""
        if self.varies(place) or len(self.texts.get(place, ())) != 1 or place in self.above:
            return False
        if self.pages < TEMPLATE_PAGES or self.held[place] * 100 < self.pages * TEMPLATE_PERCENT:
            return False
        return max(map(len, self.texts.values())) >= TEMPLATE_PAGES


def _strings(node: Node) -> tuple[str, ...]:
    out: list[str] = []
    todo = [node]
    while todo:
        for part in todo.pop().parts:
            (out if isinstance(part, str) else todo).append(part)
    return tuple(out)


def _blocks(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [child for group in reversed(runs(x)) for child in reversed(group)]


def plain(tree: Node) -> str:
    """By tags alone: the article, else the main part, else the page."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "role": []}
    todo: list[tuple[Node, frozenset]] = [(tree, frozenset())]
    while todo:
        x, inside = todo.pop()
        kind = x.tag if x.tag in found else "role" if x.label.split()[-1:] == ["main"] else None
        if kind and kind not in inside and "article" not in inside:  # what stands in one of its kind comes with it
            found[kind].append(x)
        if kind:
            inside = inside | {kind}
        todo += [(part, inside) for part in reversed(x.parts) if not isinstance(part, str) and not part.clutter]
    for kind in ("article", "main", "role"):
        texts = [t for x in found[kind] if (t := text_of(x))]
        if texts:
            return " ".join(texts)
    headers = frozenset(id(part) for part in tree.parts if isinstance(part, Node) and part.tag == "header")  # no article: page headers are clutter too
    return text_of(tree, headers) or text_of(tree)


# ------------------------------------------------------------------------- query


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = narrowed(pages, page_id="bigint", url="string", html="string").withColumn("_host", host())
    counted = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("b"))
    deals = F.greatest(F.ceil(F.col("n") / GROUP_PAGES), F.ceil(F.coalesce("b", F.lit(0)) / GROUP_BYTES), F.lit(1))
    groups = cut(counted.select("_host", deals.cast("bigint").alias("_deals"), F.coalesce("b", F.lit(0)).alias("_bytes")))
    # hosts with one group need no row
    several = groups.where(F.col("_deals") > 1).drop("_bytes")
    if several.limit(SENT_HOSTS + 1).count() <= SENT_HOSTS:  # checked: a few megabytes
        several = F.broadcast(several)
    rows = rows.join(several, "_host", "left")
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("_deals", F.lit(1)))).drop("_deals")

    def induce(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [parse(h) if isinstance(h, str) else Node("html") for h in pdf["html"]]
        wrapper = Wrapper(trees)
        texts = [wrapper.extract(t) for t in trees]
        del trees, wrapper
        trimmed()
        return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts})

    # as many tasks as the bytes call for, however many partitions the session asks for
    size = groups.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return rows.repartition(parts, "_host", "_deal").groupBy("_host", "_deal").applyInPandas(induce, "page_id bigint, url string, text string")


def page_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return main_texts(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
