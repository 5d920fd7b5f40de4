"""HTML extraction by wrapper induction.

Pages of one host are parsed into DOM trees. Siblings of one kind (tag, class
and id) are one repeating node, so a tree is as small as its page's layout and
a node's children all differ in kind. Simple tree matching then is a heaviest
increasing subsequence of the children that two nodes have in common, weighed
by the matches below them: exact, and in n log n steps for n children.

As the children of a node differ in kind, a node is told by the kinds on its way to
the root. A host's template has the nodes that half of its distinct pages have,
counted over all of them, siblings in the order that more pages have. Every page
of the host is aligned with that template, and (node, text) is counted over all distinct pages of the host;
pages that differ in dropped places only are one. At a node, the texts that
stand on ``CONSTANT_SHARE`` of the host's pages are template if they are all that
stands there, or no more than half of it; otherwise the node is a slot (near
copies of one article differ somewhere in it). Inside an article or main element
texts of ``LONG_WORDS`` words are never template. A slot is content unless its
place says otherwise (menu, header, footer, sidebar, notice, advert, form,
comment, by element, role or class), and if the page has an article or main
element, only slots inside it.

Every page is then extracted whole with its host's wrapper, aligned again, so a
template text goes where it is template only. A host with fewer than
``MIN_PAGES`` distinct pages has no template texts, and the places alone decide.

Pages of one layout are counted together; the counts of layouts, nodes, neighbours and
texts combine before the shuffle, so a hot host sends few rows. Templates and
constants are staged before they are joined to the pages, so the planner broadcasts
them only if their real size allows it.

All walks over trees are loops; elements nested deeper than ``MAX_DEPTH`` become
siblings, as in browsers, and keep their texts. Defined results: a null or empty
html gives an empty text; a null URL belongs to the host ``""``; malformed markup
never fails (unclosed elements end with their parent, a tag cut off by the end of
the page is dropped); repeated rows are extracted alike and count once; an empty
table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import by_value, release, stage
from evidentia.llm.url_filter import split_url

by_value(__name__)

MIN_PAGES, CONSTANT_SHARE, LONG_WORDS, MAX_DEPTH = 4, 0.8, 8, 512
_CACHE = 200_000
WHOLE, PART = 0.9, 0.52      # shares of a node's texts: all of them, no more than half, with some noise

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|(\Z))", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NOT_OWN = re.compile(r"\b(?:has|with|without|no)[-_]\w+")  # "with-sidebar" is no sidebar
_BLANK = re.compile(r"\s+")

# Element and class names of HTML.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
DROP = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu",
              "svg", "object", "canvas", "audio", "video"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu",
              "menubar"}
DROP_NAMES = {"ad", "adbox", "ads", "adsense", "adslot", "adunit", "adv", "alert", "announcement", "banner", "consent",
              "copyright", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navigation",
              "notice", "overlay", "pager", "pagination", "paywall", "popup", "related", "replies", "respond", "share",
              "sharing", "skip", "skiplink", "social", "subscribe", "subscription", "toolbar", "topbar", "topnav",
              "widget", "widgets"}
DROP_PREFIXES = ("advert", "breadcrumb", "comment", "cookie", "navbar", "newsletter", "promo", "sidebar", "sponsor")
# names that make even an article element no main text (a comment, a teaser)
DROP_MAIN = {"ad", "ads", "related", "replies"}
MAIN = {"article", "main"}
# an open element that a start tag ends
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"article", "aside", "body", "div", "dl", "form", "main", "nav", "ol", "section", "table", "ul"}
_P_ENDS = _SCOPE | {"blockquote", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "p", "pre"}


class Node:
    """An element: kind (tag and class), dropped by its place, inside article or main."""
    __slots__ = ("tag", "kind", "drop", "main", "up", "children", "texts", "depth")

    def __init__(self, tag: str, kind: str, drop: bool, main: bool, up: Node | None):
        self.tag, self.kind, self.drop, self.main, self.up = tag, kind, drop, main, up
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.depth = 0 if up is None else up.depth + 1
        if up is not None:
            up.children.append(self)


def _dropped(names: str, tag: str, inside_main: bool) -> bool:
    """Whether class or id names say that an element is no article text."""
    for name in re.split(r"[^a-z0-9]+", _NOT_OWN.sub("", names)):
        if tag in ("html", "body") or name == "header" and inside_main:
            continue  # the head of an article belongs to it
        if name.startswith(("comment", "advert", "promo", "sponsor")) or name in DROP_MAIN:
            return True
        if tag not in MAIN and (name in DROP_NAMES or name.startswith(DROP_PREFIXES)):
            return True
    return False


def _element(tag: str, attrs: str, up: Node) -> Node:
    if up.depth >= MAX_DEPTH:
        up = up.up
    kind, drop = tag, tag in DROP and not (tag == "header" and up.main)
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name in ("class", "id"):
                kind += "." + value
                drop = drop or _dropped(value, tag, up.main)
            elif name == "role":
                drop = drop or value in DROP_ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                drop = True
            elif name == "style":
                drop = drop or "display:none" in value.replace(" ", "")
    return Node(tag, kind, up.drop or drop, up.main or tag in MAIN, up)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The DOM tree, and the text blocks in page order with their elements."""
    root = node = Node("#root", "#root", False, False, None)
    blocks: list[tuple[Node, str]] = []
    parts: list[str] = []
    owner = root

    def flush():
        if parts:
            text = _BLANK.sub(" ", html_lib.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append((owner, text))
                owner.texts.append(text)

    def add(text: str):
        nonlocal owner
        place = node
        while place.tag in INLINE and place.up is not None and not (place.drop and not place.up.drop):
            place = place.up
        if place is not owner:
            flush()
            owner = place
        parts.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or m[7] is not None:
            continue  # comment, declaration, or a tag cut off by the end
        tag = tag.lower()
        if close:
            up = node
            while up is not None and up.tag != tag:
                up = up.up
            if up is not None and up is not root:
                if tag not in INLINE:
                    flush()
                node = up.up
            elif tag in ("p", "br"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            ended = ENDS.get(tag, {"p"} if tag in _P_ENDS else ())
            up = node
            while ended and up is not root and up.tag not in _SCOPE:
                if up.tag in ended:
                    node = up.up
                    break
                up = up.up
        if tag in RAW:
            child = _element(tag, attrs, node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not child.drop:
                parts.append(page[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag in VOID or attrs.endswith("/"):
            continue
        else:
            node = _element(tag, attrs, node)
    flush()
    return root, blocks


# --- alignment ------------------------------------------------------------------

class Place:
    """A node of a compact tree: children by kind, in the order of their first ones."""
    __slots__ = ("children", "name")

    def __init__(self, name: int = -1):
        self.children: dict[str, Place] = {}
        self.name = name


def compact(root: Node) -> tuple[Place, dict[Node, Place]]:
    """The compact tree, and the place of each element."""
    top = Place()
    at, todo = {root: top}, [root]
    while todo:
        node = todo.pop()
        place = at[node]
        for c in node.children:
            if c.tag not in INLINE or c.texts or c.children:
                at[c] = place.children.setdefault(c.kind, Place())
        todo.extend(c for c in reversed(node.children) if c in at)
    return top, at


def _heaviest(items: list[tuple[int, int]]) -> list[int]:
    """Which of the (place in the other tree, weight) items make the heaviest
    increasing subsequence. Best sums by place, rising in both, are kept in a list."""
    if all(a[0] < b[0] for a, b in zip(items, items[1:])):
        return list(range(len(items)))
    ends: list[tuple[int, int, int]] = []       # (place, sum, item): sums rise with places
    before: list[int] = []
    for k, (place, weight) in enumerate(items):
        i = bisect_left(ends, (place,))
        before.append(ends[i - 1][2] if i else -1)
        total = weight + (ends[i - 1][1] if i else 0)
        j = i
        while j < len(ends) and ends[j][1] <= total:
            j += 1
        ends[i:j] = [(place, total, k)]
    out, k = [], ends[-1][2]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def match(a: Place, b: Place) -> tuple[int, list[tuple[Place, Place]]]:
    """Simple tree matching: size of the largest match of two compact trees that keeps
    parents and the order of siblings, and its pairs, parents first."""
    pairs, at = [(a, b)], 0
    below: list[list[int]] = []
    while at < len(pairs):
        x, y = pairs[at]
        common = [k for k in x.children if k in y.children]
        below.append(list(range(len(pairs), len(pairs) + len(common))))
        pairs += [(x.children[k], y.children[k]) for k in common]
        at += 1
    size = [1] * len(pairs)
    for at in range(len(pairs) - 1, -1, -1):
        if below[at]:
            order = {id(c): i for i, c in enumerate(pairs[at][1].children.values())}
            kept = _heaviest([(order[id(pairs[k][1])], size[k]) for k in below[at]])
            below[at] = [below[at][k] for k in kept]
            size[at] += sum(size[k] for k in below[at])
    out, todo = [], [0]
    for k in todo:
        out.append(pairs[k])
        todo += below[k]
    return size[0], out


def layout(top: Place) -> list[tuple[int, str]]:
    """A compact tree as (place of the parent in the list, kind), parents first and
    siblings in order; the root is place 0."""
    out, todo = [], [(-1, "#root", top)]
    for up, kind, place in todo:
        out.append((up, kind))
        todo += [(len(out) - 1, k, c) for k, c in place.children.items()]
    return out


def node_names(flat: list[tuple[int, str]]) -> list[int]:
    """A 64-bit name for each node of a layout, from the kinds on its way to the root:
    siblings differ in kind, so nodes of two pages are one node if their names agree."""
    names: list[int] = []
    for up, kind in flat:
        names.append(text_hash(f"{names[up] if up >= 0 else ''} {kind}"))
    return names


def followers(flat: list[tuple[int, str]], kept: frozenset[int] | set[int]) -> list[tuple[int, int]]:
    """(node, next kept sibling) of the kept nodes of a layout."""
    last: dict[int, int] = {}
    out = []
    for (up, _), name in zip(flat, node_names(flat)):
        if name in kept:
            if up in last:
                out.append((last[up], name))
            last[up] = name
    return out


def assembled(nodes: dict[int, tuple[int | None, str]], follows: dict[tuple[int, int], int]) -> list[tuple[int, str]]:
    """The layout of the kept ``nodes`` (name -> (name of the parent, kind)). Siblings
    stand in the order in which more pages have them one after the other; where these
    orders run in a circle, first comes the one that fewest pages have behind another."""
    below: dict[int | None, list[int]] = {}
    for name, (up, _) in nodes.items():
        below.setdefault(up, []).append(name)
    behind, after = dict.fromkeys(nodes, 0), {name: [] for name in nodes}
    for (x, y), n in follows.items():
        more = n - follows.get((y, x), 0)
        if more > 0:
            after[x].append((y, more))
            behind[y] += more
    out, todo = [], [(-1, name) for name in below.get(None, ())]
    for up, name in todo:
        out.append((up, nodes[name][1]))
        heap = [(behind[c], nodes[c][1], c) for c in below.get(name, ())]
        heapify(heap)
        done = set()
        at = len(out) - 1
        while heap:
            left, _, c = heappop(heap)
            if c in done or left != behind[c]:
                continue
            done.add(c)
            todo.append((at, c))
            for y, more in after[c]:
                if y not in done:
                    behind[y] -= more
                    heappush(heap, (behind[y], nodes[y][1], y))
    return out


def induce(pages: list[str]) -> list[tuple[int, str]]:
    """The template of some pages: the layout of the nodes that half of them have.
    Empty for fewer than MIN_PAGES pages."""
    if len(pages) < MIN_PAGES:
        return []
    flats = [layout(compact(parse(page)[0])[0]) for page in pages]
    counts: Counter[int] = Counter()
    nodes: dict[int, tuple[int | None, str]] = {}
    for flat in flats:
        names = node_names(flat)
        counts.update(names)
        nodes.update((name, (names[up] if up >= 0 else None, kind)) for name, (up, kind) in zip(names, flat))
    kept = {name for name, n in counts.items() if 2 * n >= len(pages)}
    follows = Counter(pair for flat in flats for pair in followers(flat, kept))
    return assembled({name: nodes[name] for name in kept}, follows)


def rebuilt(flat: list[tuple[int, str]]) -> Place:
    """The tree of a layout; names are places in the list."""
    places: list[Place] = []
    for name, (up, kind) in enumerate(flat):
        places.append(Place(name))
        if up >= 0:
            places[up].children[kind] = places[-1]
    return places[0]


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def slots(page: str, template: Place) -> list[tuple[int, str, bool]]:
    """(template node or -1, text, protected) of the blocks that their places do not drop."""
    root, blocks = parse(page)
    tree, at = compact(root)
    names = {id(y): x.name for x, y in match(template, tree)[1]}
    return [(names.get(id(at[node]), -1), text, node.main and text.count(" ") >= LONG_WORDS - 1)
            for node, text in blocks if not node.drop]


def extract(page: str | None, template: Place | None = None, constant: frozenset | set = frozenset()) -> str:
    """The content slots of one page, joined by one space; ``constant`` has the
    (template node, text hash) of template texts."""
    if not page:
        return ""
    root, blocks = parse(page)
    only_main = any(node.main and not node.drop for node, _ in blocks)
    names: dict[int, int] = {}
    if constant:
        tree, at = compact(root)
        names = {id(y): x.name for x, y in match(template, tree)[1]}

    def is_template(node: Node, text: str) -> bool:
        return bool(constant) and not (node.main and text.count(" ") >= LONG_WORDS - 1) and (
            names.get(id(at[node]), -1), text_hash(text)) in constant
    return " ".join(text for node, text in blocks
                    if not node.drop and (node.main or not only_main) and not is_template(node, text))


# --- on Spark -----------------------------------------------------------------------

class Templates(dict):
    """Templates by their JSON, remembered for the last few hosts of a task."""

    def __missing__(self, packed: str) -> Place:
        if len(self) >= 64:
            self.clear()
        made = self[packed] = rebuilt(json.loads(packed))
        return made


def templates(pages: DataFrame) -> DataFrame:
    """Staged w_host, template (JSON of a layout) of the hosts of ``pages`` (host, html):
    ``induce`` over all distinct pages of each host, as counts."""
    rows = pages.filter(F.length("html") > 0).select("host", F.xxhash64("html").alias("mark"), "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for b in batches:
            names, trees = [], []
            for page in b.column("html"):
                tree = json.dumps(layout(compact(parse(page.as_py())[0])[0]), separators=(",", ":"))
                names.append(text_hash(tree))
                trees.append(None if names[-1] in sent else tree)
                if len(sent) >= _CACHE:
                    sent.clear()
                sent.add(names[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), b.column("mark"), pa.array(names, pa.int64()), pa.array(trees, pa.string())],
                names=["host", "mark", "layout", "tree"])
    read_all = stage(rows.mapInArrow(read, "host string, mark long, layout long, tree string"), "layouts")
    uses = read_all.select("host", "mark", "layout").dropDuplicates(["host", "mark"]).groupBy("host", "layout").agg(
        F.count(F.lit(1)).alias("n"))
    total = uses.groupBy(F.col("host").alias("t_host")).agg(F.sum("n").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    trees = read_all.filter("tree is not null").select(F.col("layout").alias("t_layout"), "tree").dropDuplicates(["t_layout"])
    used = stage(uses.join(total, F.col("host") == F.col("t_host")).join(trees, F.col("layout") == F.col("t_layout")).select(
        "host", "n", "pages", "tree"), "used")
    release(read_all)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, n, pages, tree in zip(*(b.column(c).to_pylist() for c in ("host", "n", "pages", "tree"))):
                flat = json.loads(tree)
                names, k = node_names(flat), len(flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * k, pa.string()), pa.array(names, pa.int64()),
                     pa.array([names[up] if up >= 0 else None for up, _ in flat], pa.int64()), pa.array([kind for _, kind in flat], pa.string()),
                     pa.array([n] * k, pa.int64()), pa.array([pages] * k, pa.int64())],
                    names=["host", "node", "up", "kind", "n", "pages"])
    each = used.mapInArrow(nodes, "host string, node long, up long, kind string, n long, pages long")
    kept = each.groupBy("host", "node", "up", "kind", "pages").agg(F.sum("n").alias("n")).filter(2 * F.col("n") >= F.col("pages"))
    kept = stage(kept.groupBy(F.col("host").alias("w_host")).agg(           # twice as many nodes as a page has at most
        F.collect_list(F.struct("node", "up", "kind")).alias("nodes")), "nodes")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, n, tree, some in zip(*(b.column(c).to_pylist() for c in ("host", "n", "tree", "some"))):
                found = followers(json.loads(tree), set(some))
                if found:
                    first, second = zip(*found)
                    k = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([host] * k, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array([n] * k, pa.int64())],
                        names=["host", "first", "second", "n"])
    order = used.join(kept.select("w_host", F.col("nodes.node").alias("some")), F.col("host") == F.col("w_host")).select(
        "host", "n", "tree", "some").mapInArrow(pairs, "host string, first long, second long, n long")
    follows = order.groupBy("host", "first", "second").agg(F.sum("n").alias("n")).groupBy(F.col("host").alias("f_host")).agg(
        F.collect_list(F.struct("first", "second", "n")).alias("follows"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flats = [json.dumps(assembled({x["node"]: (x["up"], x["kind"]) for x in some},
                                          {(x["first"], x["second"]): x["n"] for x in seen or ()}))
                     for some, seen in zip(b.column("nodes").to_pylist(), b.column("follows").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("w_host"), pa.array(flats, pa.string())], names=["w_host", "template"])
    whole = kept.join(follows, F.col("w_host") == F.col("f_host"), "left").select("w_host", "nodes", "follows")
    out = stage(whole.mapInArrow(put, "w_host string, template string"), "templates")
    release(used, kept)
    return out


def constants(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Staged c_host, constant (an array of (node, text)): the template texts of
    each host, counted over all its distinct pages."""
    rows = pages.filter(F.length("html") > 0).join(found, F.col("host") == F.col("w_host")).select("host", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for b in batches:
            hosts, marks, nodes, texts = [], [], [], []
            for host, page, template in zip(b.column("host").to_pylist(), b.column("html"), b.column("template").to_pylist()):
                entries = {(node, text_hash(text), safe) for node, text, safe in slots(page.as_py(), known[template])}
                if entries:
                    hosts.append(host)
                    marks.append(xxhash.xxh3_64_intdigest(repr(sorted(entries))) - (1 << 63))
                    open_ = [(node, text) for node, text, safe in entries if node >= 0]
                    nodes.append([node for node, _ in open_])
                    texts.append([None if (node, text, True) in entries else text for node, text in open_])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(marks, pa.int64()), pa.array(nodes, pa.list_(pa.int32())),
                 pa.array(texts, pa.list_(pa.int64()))], names=["host", "mark", "nodes", "texts"])
    seen = stage(rows.mapInArrow(run, "host string, mark long, nodes array<int>, texts array<long>").dropDuplicates(
        ["host", "mark"]), "places")
    total = seen.groupBy(F.col("host").alias("t_host")).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    each = seen.select("host", F.inline(F.arrays_zip("nodes", "texts"))).groupBy(
        "host", F.col("nodes").alias("node"), F.col("texts").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    often = F.when(F.col("text").isNotNull() & (F.col("n") >= CONSTANT_SHARE * F.col("pages")), F.col("text"))
    at_node = each.join(total, F.col("host") == F.col("t_host")).groupBy("host", "node", "pages").agg(
        F.sum("n").alias("all"), F.sum(F.when(often.isNotNull(), F.col("n")).otherwise(0)).alias("same"),
        F.collect_list(often).alias("texts"))              # at most a page's texts, over CONSTANT_SHARE
    is_template = (F.col("same") >= WHOLE * F.col("all")) | (F.col("same") <= PART * F.col("all"))
    pairs = at_node.filter((F.size("texts") > 0) & is_template).select("host", "node", F.explode("texts").alias("text"))
    return stage(pairs.groupBy(F.col("host").alias("c_host")).agg(
        F.collect_list(F.struct("node", "text")).alias("constant")), "constants")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        split_url(F.col(url_col))[0].alias("host"))
    found = templates(rows.select("host", "html"))
    fixed = constants(rows.select("host", "html"), found)
    wrapper = found.join(fixed, F.col("w_host") == F.col("c_host")).select("w_host", "template", "constant")
    joined = rows.join(stage(wrapper, "wrappers"), F.col("host") == F.col("w_host"), "left").select(
        "page_id", "url", "html", "host", "template", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = Templates(), {}
        for b in batches:
            texts = []
            for page, host, template, constant in zip(b.column("html"), b.column("host").to_pylist(),
                                                      b.column("template").to_pylist(), b.column("constant")):
                if template is None:
                    texts.append(extract(page.as_py()))
                    continue
                if host not in sets:
                    if len(sets) >= 64:
                        sets.clear()
                    sets[host] = {(c["node"], c["text"]) for c in constant.as_py()}
                texts.append(extract(page.as_py(), known[template], sets[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    out = f"page_id {joined.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.mapInArrow(run, out)
