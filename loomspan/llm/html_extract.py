"""HTML main-text extraction by wrapper induction.

Pages of a host are read in groups. The DOM trees of a group are aligned with a reference
page's by simple tree matching. An aligned node whose text is the same on (nearly) all pages is
template; the others are slots, and what they hold on different pages, each text counted once, is
their varying mass. The wrapper's content region is the deepest container of the reference
that holds most of that mass; on every page the main text is the text of the nodes aligned
with it, without template and without elements that HTML itself sets apart (menus, footers,
asides, forms, scripts, hidden ones).

* Mass inside a declared ``article`` or ``main`` counts ``DECLARED`` times. With fewer than
  ``MIN_PAGES`` different pages nothing can be told apart by repetition, and such elements decide;
  a page without any, or one that has nothing in the region, is its own wrapper.
* Outside of declared articles, containers named as advert, comments, sidebar and so on are left out as well.
* Copies of a page count once in a group, so that copied articles don't become template; inside
  a declared article constant blocks go only on the word of ``MIN_ARTICLE_PAGES`` pages.
* A host is dealt by hash of (page_id, url) into even groups of about ``GROUP`` different pages,
  and no more than about ``GROUP_ROWS`` rows or ``GROUP_CHARS`` characters, from counts over all its
  pages; no group depends on the order of rows. A hot host is many groups.
* A null or empty html has the empty text. A null url is a host of its own, as are
  addresses without one. Repeated rows are each returned, with equal texts.
* Broken markup is read as far as it goes: open elements end with the page, cut tags and
  references stay out or as they are. Nesting and lists may be of any depth and length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, _to_batch, materialize, pick

GROUP, GROUP_ROWS, GROUP_CHARS = 48, 4096, 16 << 20
MIN_PAGES, MIN_ARTICLE_PAGES, CONSTANT, REGION, DECLARED = 4, 12, 0.9, 0.6, 16
SPACES = re.compile(r"[\s\xa0]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=<))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Elements of the HTML standard by the part they play here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p",
         "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILERPLATE = {"nav", "aside", "footer", "form", "button", "select", "option", "fieldset", "menu", "dialog", "head", "script", "style", "noscript", "iframe",
               "template", "svg", "canvas", "object", "audio", "video", "map", "textarea", "title", "noembed", "noframes", "datalist", "search"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Class and id names of containers, read outside of declared articles only.
BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner", "nav",
                     "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "footer", "foot", "masthead", "topbar", "comment",
                     "comments", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal",
                     "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget",
                     "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer", "tags", "teaser", "outbrain", "taboola", "form", "search"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "caption", "figcaption", "summary", "address", "hr"}
SCOPE = {"article", "main", "section", "div", "table", "ul", "ol", "dl", "td", "th", "body", "aside", "nav", "form", "footer", "header", "blockquote", "figure", "button"}


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    parent: Node | None
    off: bool = False
    article: bool = False
    children: list = field(default_factory=list)
    blocks: list = field(default_factory=list)  # (order, text, link characters) that the node owns
    runs: list = field(default_factory=list)  # children, equal leaf siblings together


def _parse_attributes(text: str) -> tuple[list[str], str, bool]:
    words: list[str] = []
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words += value.lower().split()
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return words, role, hidden


def _is_boilerplate(tag: str, words: list[str], role: str, hidden: bool, inside_article: bool) -> bool:
    if tag in BOILERPLATE or role in BOILERPLATE_ROLES or hidden:
        return True
    if inside_article:
        return False
    if tag == "header":
        return True
    if tag in ("body", "html", "article", "main") or tag in LEAF:
        return False
    for w in words:
        parts = re.split(r"[^a-z]+", w)
        if any(p in BOILERPLATE_WORDS for p in parts):
            return True
        if "header" in parts and not any(p in ("article", "post", "entry", "content") for p in parts):
            return True
    return False


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """DOM tree of block elements and the blocks of text in page order: (owner, text, characters in links)."""
    root = Node("#root", "#root", None)
    stack: list[tuple[str, Node]] = [("#root", root)]
    opened: Counter = Counter()  # tags on the stack
    blocks: list[tuple[Node, str, int]] = []
    text: list[str] = []
    said_in: list[Node] = [root]  # whose block the text at hand is
    linked = [0]
    depth_link = [0]

    def flush():
        if text:
            joined = SPACES.sub(" ", "".join(text)).strip()
            if joined:
                owner = said_in[0]
                owner.blocks.append((len(blocks), joined, linked[0]))
                blocks.append((owner, joined, min(linked[0], len(joined))))
            text.clear()
        linked[0] = 0

    def say(raw: str):
        here = stack[-1][1]
        if raw and not here.off:  # boilerplate within a line leaves the line whole
            said = entities.unescape(raw)
            if not text:
                said_in[0] = here
            text.append(said)
            if depth_link[0]:
                linked[0] += len(said)

    def pop():
        tag, _ = stack.pop()
        opened[tag] -= 1
        if tag == "a":
            depth_link[0] -= 1

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                if tag not in BLOCK:  # an inline end tag never closes a block
                    k = len(stack) - 1
                    while stack[k][0] != tag and stack[k][0] not in BLOCK:
                        k -= 1
                    if stack[k][0] != tag:
                        continue
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
            closes = CLOSES.get(tag, ())
            k = len(stack) - 1 if opened["p"] or any(opened[t] for t in closes) else 0
            cut = None
            while k > 0:
                t = stack[k][0]
                if t == "p" or t in closes:
                    cut = k
                if t in SCOPE and t not in closes:
                    break
                k -= 1
            if cut is not None:
                while len(stack) > cut:
                    pop()
        if tag in VOID:
            continue
        above = stack[-1][1]
        words, role, hidden = _parse_attributes(m[3]) if m[3] else ((), "", False)
        if tag in BLOCK or tag in BOILERPLATE or words and _is_boilerplate(tag, words, role, hidden, above.article):
            node = Node(tag, tag + "." + ".".join(sorted(re.sub(r"\d+", "", w) for w in words)), above)
            node.off = above.off or _is_boilerplate(tag, words, role, hidden, above.article)
            node.article = above.article or tag in ("article", "main") or role in ("main", "article")
            above.children.append(node)
        else:
            node = above
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW or tag == "template":
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                shut = page.find(">", close.start())
                at = shut + 1 if shut >= 0 else end
            continue
        stack.append((tag, node))
        opened[tag] += 1
        if tag == "a":
            depth_link[0] += 1
    flush()
    return root, blocks


def collapse(node: Node) -> None:
    """Give every node its runs: children, with neighbours of equal label and no children of their own together."""
    todo = [node]
    while todo:
        n = todo.pop()
        runs: list[list[Node]] = []
        for c in n.children:
            if runs and not c.children and not runs[-1][0].children and runs[-1][0].label == c.label:
                runs[-1].append(c)
            else:
                runs.append([c])
            todo.append(c)
        n.runs = runs


class Shapes:
    """Subtrees by shape: equal subtrees share a number, so that each pair of shapes is matched once."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.of: dict[int, int] = {}  # id of a node -> its shape
        self.best: dict[tuple[int, int], int] = {}
        self.chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, root: Node) -> None:
        for n in reversed(list(_walk(root))):  # children before their parents
            key = (n.label, tuple(self.of[id(r[0])] for r in n.runs))
            k = self.number.get(key)
            if k is None:
                k = self.number[key] = len(self.label)
                self.label.append(n.label)
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            self.of[id(n)] = k

    def _middle(self, a: int, b: int) -> tuple[int, int, int]:
        """Equal shapes at both ends match each other in a best alignment: (how many in front, end in a, end in b)."""
        x, y = self.kids[a], self.kids[b]
        front = 0
        while front < len(x) and front < len(y) and x[front] == y[front]:
            front += 1
        i, j = len(x), len(y)
        while i > front and j > front and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        return front, i, j

    def below(self, a: int, b: int) -> int:
        """Size of the best alignment of the children of two shapes."""
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            if (a, b) not in self.best:
                front, i, j = self._middle(a, b)
                x, y = self.kids[a][front:i], self.kids[b][front:j]
                open_ = [(p, q) for p in set(x) for q in set(y) if p != q and self.label[p] == self.label[q] and self.kids[p] and self.kids[q] and (p, q) not in self.best]
                if open_:
                    todo += open_
                    continue
                ends = sum(self.size[c] for c in self.kids[a][:front]) + sum(self.size[c] for c in self.kids[a][i:])
                self.best[a, b] = ends + (int(_last_row(*self._weights(x, y))[-1]) if x and y else 0)
            todo.pop()
        return self.best[a, b]

    def _weights(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, columns of y, and the sizes of their matches, over distinct shapes."""
        xs, ys = sorted(set(x)), sorted(set(y))
        w = np.zeros((len(xs), len(ys)), dtype=np.int64)
        for i, p in enumerate(xs):
            for j, q in enumerate(ys):
                if p == q:
                    w[i, j] = self.size[p]
                elif self.label[p] == self.label[q]:
                    w[i, j] = 1 + (self.best[p, q] if self.kids[p] and self.kids[q] else 0)
        at_x, at_y = {p: i for i, p in enumerate(xs)}, {q: j for j, q in enumerate(ys)}
        return np.array([at_x[p] for p in x]), np.array([at_y[q] for q in y]), w

    def align(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the children that the best alignment pairs."""
        if (a, b) not in self.chosen:
            self.below(a, b)
            front, i, j = self._middle(a, b)
            x, y = self.kids[a][front:i], self.kids[b][front:j]
            out = [(k, k) for k in range(front)]
            if x and y:
                out += [(front + p, front + q) for p, q in _trace(*self._weights(x, y))]
            self.chosen[a, b] = out + [(i + k, j + k) for k in range(len(self.kids[a]) - i)]
        return self.chosen[a, b]


def _last_row(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of the best alignments of all of x with each beginning of y."""
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for p in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w[p, y] * (w[p, y] > 0)))
    return row


def _trace(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a best alignment: by table, and in halves where that would be large (Hirschberg)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > 1 << 16:
            mid = (a + b) // 2
            cut = c + int((_last_row(x[a:mid], y[c:d], w) + _last_row(x[mid:b][::-1], y[c:d][::-1], w)[::-1]).argmax())
            todo += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), dtype=np.int64)
        for i, p in enumerate(x[a:b]):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w[p, y[c:d]]))
        i, j = b - a, d - c
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return sorted(out)


def match(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[list[Node], list[Node]]]]:
    """Simple tree matching over runs: (nodes of the largest order-keeping alignment, its pairs of runs)."""
    if shapes is None:
        shapes = Shapes()
        shapes.add(a)
        shapes.add(b)
    if a.label != b.label:
        return 0, []
    pairs = [([a], [b])]
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        for i, j in shapes.align(shapes.of[id(x)], shapes.of[id(y)]):
            pairs.append((x.runs[i], y.runs[j]))
            if len(x.runs[i]) == len(y.runs[j]) == 1 and x.runs[i][0].runs and y.runs[j][0].runs:
                todo.append((x.runs[i][0], y.runs[j][0]))
    return 1 + shapes.below(shapes.of[id(a)], shapes.of[id(b)]), pairs


def _run_text(run: list[Node]) -> str:
    return "\n".join(t for n in run for _, t, _ in n.blocks)


def _walk(node: Node):
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(n.children)


@dataclass(slots=True)
class Wrapper:
    """What induction found on one page: nodes that are template, and those of the content region."""

    template: set[int]
    region: set[int]


def induce(trees: list[Node]) -> list[Wrapper]:
    """The wrapper of distinct pages of one host, as it lies on each of them. The order of ``trees`` decides between equal sizes."""
    shapes = Shapes()
    for t in trees:
        shapes.add(t)
    by_size = sorted(range(len(trees)), key=lambda i: (shapes.size[shapes.of[id(trees[i])]], i))
    reference = trees[by_size[len(by_size) // 2]]
    aligned = [match(reference, t, shapes)[1] for t in trees]

    texts: dict[int, Counter] = {}
    for pairs in aligned:
        for ref, own in pairs:
            texts.setdefault(id(ref[0]), Counter())[_run_text(own)] += 1
    constant = {}
    for ref, seen in texts.items():
        (text, n), total = seen.most_common(1)[0], sum(seen.values())
        if text and total >= MIN_PAGES and n >= CONSTANT * total:
            constant[ref] = (text, total)

    template: list[set[int]] = []
    mass: dict[int, dict[str, float]] = {}  # slot -> what varies in it, each text once
    for tree, pairs in zip(trees, aligned):
        slot = {id(n): id(ref[0]) for ref, own in pairs for n in own}
        found: set[int] = set()
        for ref, own in pairs:
            hit = constant.get(id(ref[0]))
            if hit and hit[0] == _run_text(own):
                found.update(id(n) for n in own if not n.article or hit[1] >= MIN_ARTICLE_PAGES)
        template.append(found)
        within = {id(tree): slot[id(tree)]}
        for n in _walk(tree):
            if n is not tree:
                within[id(n)] = slot.get(id(n), within[id(n.parent)])  # what has no partner counts for what is around it
            if n.blocks and not n.off and id(n) not in found:
                weight = DECLARED if n.article and len(trees) >= MIN_PAGES else 10**9 if n.article else 1
                for _, t, links in n.blocks:
                    mass.setdefault(within[id(n)], {})[t] = weight * max(0, len(t) - 2 * links)

    ref_nodes = list(_walk(reference))
    under = {id(n): sum(mass.get(id(n), {}).values()) for n in ref_nodes}
    for n in reversed(ref_nodes):
        if n.parent is not None:
            under[id(n.parent)] += under[id(n)]
    region = reference
    while True:
        inner = next((r[0] for r in region.runs if len(r) == 1
                      and under[id(r[0])] > 0 and under[id(r[0])] >= REGION * under[id(reference)] and (r[0].runs or r[0].tag not in LEAF)
                      and (not region.article or r[0].tag in ("article", "main"))), None)  # a declared article is taken whole
        if inner is None:
            break
        region = inner

    out = []
    for tree, pairs, found in zip(trees, aligned, template):
        own = next((o[0] for ref, o in pairs if ref[0] is region), None)
        inside = {id(n) for n in _walk(own)} if own is not None else set()
        if len(trees) > 1 and not any(id(n) in inside and not n.off and id(n) not in found for n in _walk(tree) if n.blocks):
            out += induce([tree])
        else:
            out.append(Wrapper(found, inside))
    return out


def main_text(blocks: list[tuple[Node, str, int]], wrapper: Wrapper) -> str:
    """The region's blocks in page order. Where no article is declared, blocks that are mostly links are menus."""
    kept = [b for b in blocks if id(b[0]) in wrapper.region and not b[0].off and id(b[0]) not in wrapper.template]
    if any(b[0].article for b in kept):
        return "\n".join(t for o, t, _ in kept if o.article)
    return "\n".join(t for _, t, links in kept if links <= 0.5 * len(t))


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host, whatever their order."""
    distinct = sorted({p or "" for p in pages}, key=lambda p: (xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")), p))
    parsed = {p: parse(p) for p in distinct}
    for root, _ in parsed.values():
        collapse(root)
    wrappers = induce([root for root, _ in parsed.values()])
    texts = {p: main_text(blocks, w) for (p, (_, blocks)), w in zip(parsed.items(), wrappers)}
    return [texts[p or ""] for p in pages]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    base = pick(pages, "page_id", "url", "html").withColumn("__host", host_of(F.col("url")))
    seen = base.groupBy(F.col("__host").alias("__of")).agg(
        F.approx_count_distinct(F.xxhash64("html")).alias("pages"), F.count("*").alias("rows"), F.sum(F.length("html")).alias("chars")
    )
    groups = F.greatest(F.floor(F.col("pages") / GROUP), F.ceil(F.col("rows") / GROUP_ROWS), F.ceil(F.col("chars") / GROUP_CHARS))
    several = materialize(seen.select("__of", groups.cast("long").alias("__groups")).where("__groups > 1"), "html-hosts")
    dealt = base.join(several, F.col("__host") == F.col("__of"), "left")
    dealt = dealt.withColumn("__group", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("__groups", F.lit(1))))
    dealt = dealt.repartition("__host", "__group").sortWithinPartitions("__host", "__group")
    schema = "page_id long, url string, text string"
    arrow = _arrow_schema(pages.sparkSession, schema)

    def run(batches):
        held: list[tuple] = []
        here = None

        def done():
            texts = extract_group([h for _, _, h in held])
            return _to_batch([(i, u, t) for (i, u, _), t in zip(held, texts)], arrow)

        for batch in batches:
            for page_id, url, page, host, group in zip(*(batch.column(k) for k in range(5))):
                key = host.as_py(), group.as_py()
                if held and key != here:
                    yield done()
                    held = []
                here = key
                held.append((page_id.as_py(), url.as_py(), page.as_py()))
        if held:
            yield done()

    return dealt.select("page_id", "url", "html", "__host", "__group").mapInArrow(run, schema)


def extract_digest(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
