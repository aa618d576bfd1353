"""Main text of web pages by consensus host paths.

Pages of one host share a template. Each page scores its containers by how much of the page's
prose they hold and how little else; the scores are votes for the containers' paths of tags and
classes, with digits generalised. Spark sums the votes by host, and every page is extracted again
from the containers on its host's winning path.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import materialise

# Element and attribute names of HTML and words that templates use.
DROPPED = "script|style|noscript|template|title|textarea|select|svg|iframe|object|canvas|button|audio|video|map"
BLOCKS = frozenset(
    "html head body main article section div aside nav header footer form fieldset ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption address details summary dialog menu center hgroup search".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd tr caption figcaption summary".split())
BOILERPLATE = frozenset("head nav aside footer menu search".split())
#: Boilerplate as well, unless the whole page lies in one.
FORMS = frozenset("form fieldset dialog".split())
ROOTS = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar".split())
NEGATIVE = re.compile(
    r"(?:^|[-_\s])(?<!\bwith[-_])(?<!\bhas[-_])(?<!\bno[-_])(?<!\bwithout[-_])(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|side-?bar\w*|footer\w*|"
    r"cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup\w*|modal\w*|overlay|newsletter|subscri\w*|sign-?up|log-?in|share|sharing|social|"
    r"related|recommend\w*|comments?|commentlist|disqus\w*|respond|repl(?:y|ies)|widgets?|toolbar|pagination|pager|skip-?link|hidden|sr-only|search)(?:$|[-_\s\d])",
    re.I,
)
HEADER = re.compile(r"(?:^|[-_\s])(?:header|masthead|topbar)(?:$|[-_\s\d])", re.I)
#: An open element is closed by the start of one of these.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
#: What stands between two values of a tag: names, blanks and slashes, then the start of a value or the tag's end.
BEFORE_VALUE = re.compile(r"[^>=]*+(?:=\s*+(?![\s\"'])[^\s>]*+[^>=]*+)*+(?:=\s*+(?P<quote>[\"'])|(?P<end>>))")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w=-])""", re.S)
ENDS_OF_DROPPED = {name: re.compile(rf"</{name}\s*+>?", re.I) for name in DROPPED.split("|")}

#: Share of a page's prose that a path must hold to be voted for, or to be used.
LEAST_SHARE = 0.2


@dataclass(eq=False)
class Node:
    tag: str
    #: A hash of the tags and classes from the root to here, and how many they are.
    path: int
    depth: int
    bad: bool
    parent: Node | None
    in_article: bool
    #: Whether its own class or id is one of boilerplate.
    named: bool = False
    #: Whether it is a form or a dialog.
    form: bool = False
    prose: int = 0
    linked: int = 0


@dataclass
class Block:
    node: Node
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    text: str = ""

    @property
    def prose(self) -> int:
        return max(0, len(self.text) - self.linked)


@dataclass
class Page:
    """Blocks of text in page order, each with the element that holds it, and all elements, outer ones first."""

    nodes: list[Node]
    blocks: list[Block]


def _attributes(source: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def _open(tag: str, source: str, parent: Node) -> Node:
    attributes = _attributes(source) if source.strip() else {}
    classes = attributes.get("class", "").split()
    label = tag + ("." + re.sub(r"\d+", "#", classes[0]) if classes else "")
    in_article = tag in ("article", "main") or parent.in_article
    bad = parent.bad or tag in BOILERPLATE
    named, form = False, tag in FORMS
    if tag not in ROOTS:
        form = form or attributes.get("role", "").lower() in ("form", "dialog")
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        bad = bad or attributes.get("role", "").lower() in ROLES
        bad = bad or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
        bad = bad or not in_article and tag == "header"
        named = bool(NEGATIVE.search(names)) or not in_article and bool(HEADER.search(names))
    path = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent.path) >> 1
    return Node(tag, path, parent.depth + 1, bad, parent, in_article, named, form)


def _add_up(page: Page, prose: Callable[[Block], int], linked: Callable[[Block], int] = lambda b: 0) -> None:
    """Sums of the blocks within each element: inner elements come after those that hold them."""
    for node in page.nodes:
        node.prose = node.linked = 0
    for block in page.blocks:
        block.node.prose += prose(block)
        block.node.linked += linked(block)
    for node in reversed(page.nodes):
        if node.parent is not None:
            node.parent.prose += node.prose
            node.parent.linked += node.linked


def _within(page: Page, holds: Callable[[Node], bool]) -> set[Node]:
    """The elements that are such or lie in one that is."""
    found: set[Node] = set()
    for node in page.nodes:
        if node.parent in found or holds(node):
            found.add(node)
    return found


def _judge(page: Page) -> None:
    """Says which blocks are boilerplate.

    Layouts are named after their parts, too, so a class or an id doesn't count on an element that
    holds main or the page's longest article, nor on one that holds most of the page's prose if
    these are missing or in doubt, too, nor where nothing would remain. Forms and dialogs go, but
    for those around the whole page, as some frameworks write them: such a one holds main or an article, or
    where there is neither four fifths of the prose.
    """
    for block in page.blocks:
        block.bad = block.node.bad
    _add_up(page, lambda b: 0 if b.bad else b.prose)
    if any(n.form for n in page.nodes):
        around: set[Node] = set()
        for node in page.nodes:
            if node.tag in ("main", "article") and node.prose:
                while node is not None and node not in around:
                    around.add(node)
                    node = node.parent
        total = page.nodes[0].prose
        whole = lambda n: n in around if around else 5 * n.prose >= 4 * total > 0
        forms = _within(page, lambda n: n.form and not whole(n))
        for block in page.blocks:
            block.bad = block.bad or block.node in forms
        _add_up(page, lambda b: 0 if b.bad else b.prose)
    total = page.nodes[0].prose
    held = [n for n in page.nodes if n.tag == "main" and n.prose]
    articles = [n for n in page.nodes if n.tag == "article" and n.prose]
    held += [max(articles, key=lambda n: n.prose)] if articles else []
    named = _within(page, lambda n: n.named)
    doubted = all(n in named for n in held)
    done: set[Node] = set()
    for node in held:
        while node is not None and node not in done:
            done.add(node)
            node.named = False
            node = node.parent
    if doubted:
        for node in page.nodes:
            node.named = node.named and 2 * node.prose <= total
    named = _within(page, lambda n: n.named)
    condemned = [b for b in page.blocks if not b.bad and b.node in named]
    if sum(b.prose for b in condemned) < total:
        for block in condemned:
            block.bad = True


class Tags:
    """Reads a page's tags from left to right, each character a bounded number of times.

    A quoted value may hold any character, however long it is. Where the quotes of a tag never
    close, they don't count from there on and tags end at the next ``>``.
    """

    def __init__(self, source: str):
        self.source = source
        self.quotes_count = True
        self.missing: set[str] = set()

    def find(self, what: str, start: int) -> int:
        """As str.find; what isn't there from some place on isn't looked for again."""
        if what in self.missing:
            return -1
        at = self.source.find(what, start)
        if at < 0:
            self.missing.add(what)
        return at

    def end_of_tag(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        start = at
        while self.quotes_count:
            m = BEFORE_VALUE.match(self.source, at)
            if m is not None and m["end"]:
                return m.end() - 1
            close = self.source.find(m["quote"], m.end()) if m is not None else -1
            if close < 0:
                self.quotes_count = False
            at = close + 1
        return self.find(">", start)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(text before, tag, attributes); an end tag's name has a slash before it, the last one is empty."""
        source, done, at = self.source, 0, 0
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                stop = self.find("-->", at + 4)
                yield source[done:at], "!", ""
                done = at = stop + 3 if stop >= 0 else len(source)
                continue
            slash = source.startswith("/", at + 1)
            m = TAG.match(source, at + 1 + slash)
            if m is None:
                stop = self.find(">", at + 1) if source[at + 1 : at + 2] in ("!", "?", "/") else -1
                if stop < 0:
                    at += 1
                    continue
                yield source[done:at], "!", ""
                done = at = stop + 1
                continue
            stop = self.end_of_tag(m.end())
            if stop < 0:
                at = m.end()
                continue
            name = m[0].lower()
            if not slash and name in ENDS_OF_DROPPED:
                end = None if name in self.missing else ENDS_OF_DROPPED[name].search(source, stop + 1)
                if end is None:
                    self.missing.add(name)
                yield source[done:at], "!", ""
                done = at = end.end() if end else len(source)
                continue
            yield source[done:at], "/" + name if slash else name, source[m.end() : stop]
            done = at = stop + 1
        yield source[done:], "", ""


def parse(source: str) -> Page:
    """Blocks of text and elements of a page. The work is linear in its length, whatever it holds."""
    root = Node("", 0, 0, False, None, False)  # holds what no element does
    page = Page([root], [])
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
    block: Block | None = None
    links = 0

    def add(text: str) -> None:
        nonlocal block
        if block is None:
            if not text or text.isspace():
                return
            block = Block(stack[-1])
            page.blocks.append(block)
        block.pieces.append(entities.unescape(text) if "&" in text else text)
        if links:
            block.linked += len(text)

    def close(depth: int) -> None:
        """Close the element at a place in the stack and all within it."""
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def innermost(tags: Collection[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    for text, tag, attributes in Tags(source):
        if text:
            add(text)
        ends = tag.startswith("/")
        tag = tag.removeprefix("/")
        if tag == "a":
            links = 0 if ends else 1
        elif tag in ("br", "hr"):
            add(" ")
        if tag == "hr":
            block = None
        if tag not in BLOCKS:
            continue
        block = None
        if ends:
            if places.get(tag):
                close(places[tag][-1])
            continue
        links = 0
        if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
            close(len(stack) - 1)
        if tag in CLOSED_BY:
            closes, within = CLOSED_BY[tag]
            limit = innermost(within)
            # the outermost of those that it closes, down to the list or table that holds it
            outer = min((places[t][bisect_right(places[t], limit)] for t in closes if places.get(t) and places[t][-1] > limit), default=0)
            if outer:
                close(outer)
        if tag == "body" and places.get("head"):
            close(places["html"][-1] + 1 if places.get("html") else 1)
        if not attributes.endswith("/"):
            node = _open(tag, attributes, stack[-1])
            places[tag].append(len(stack))
            stack.append(node)
            page.nodes.append(node)
    for block in page.blocks:
        block.text = " ".join("".join(block.pieces).split())
    _judge(page)
    return page


def _paths(page: Page) -> dict[int, tuple[int, int, int]]:
    """Prose, linked text and depth by the path of the containers."""
    _add_up(page, lambda b: 0 if b.bad else b.prose, lambda b: 0 if b.bad else len(b.text) - b.prose)
    out: dict[int, tuple[int, int, int]] = {}
    for node in page.nodes:
        if node.tag not in TEXT_BLOCKS and (node.prose or node.linked):
            prose, linked, _ = out.get(node.path, (0, 0, 0))
            out[node.path] = prose + node.prose, linked + node.linked, node.depth
    return out


def scores(page: Page) -> dict[int, float]:
    """Votes of one page: a score for each path whose containers hold enough of its prose."""
    return _scores(_paths(page))


def _scores(paths: dict[int, tuple[int, int, int]]) -> dict[int, float]:
    total = paths[0][0] if 0 in paths else 0
    return {path: g / total * (g / (g + linked)) ** 2 for path, (g, linked, _) in paths.items() if total and g >= LEAST_SHARE * total}


def main_text(source: str, path: int | None = None, lists: Collection[int] = ()) -> str:
    """Text of a page: all of its prose, and what is linked in its container.

    The container is the host's path or the lowest one above it that holds all the prose of the
    page's own best container; without the host's path, or where that holds too little, the
    page's own. ``lists`` are paths that are link lists on most of the host's pages that have
    them. They are left out of pages that the host's path serves.
    """
    page = parse(source)
    own = scores(page)
    if path in own and lists:
        above: set[int] = set()
        for node in page.nodes:
            while node is not None and node.path == path:
                node = node.parent
                while node is not None and node.path not in above:
                    above.add(node.path)
                    node = node.parent
        inside = {n.path for n in _within(page, lambda n: n.path == path)}
        left_out = set(lists) - above - inside
        lists_here = _within(page, lambda n: n.path in left_out)
        for block in page.blocks:
            block.bad = block.bad or block.node in lists_here
        own = scores(page)
    if not own:
        return ""
    depth = {n.path: n.depth for n in page.nodes}
    # exact ties go to the deepest
    best = max(sorted(own), key=lambda p: (own[p], depth[p]))
    if path not in own:
        path = best
    in_best = _within(page, lambda n: n.path == best)
    _add_up(page, lambda b: int(not b.bad and b.prose > 0 and b.node in in_best))
    held: dict[int, int] = defaultdict(int)
    for node in page.nodes:
        held[node.path] += node.prose
    # a path's elements don't lie in each other, so these are all blocks that they hold
    upward = {n.path: n.parent.path for n in page.nodes if n.parent is not None}
    while held[path] < held[0]:
        path = upward[path]
    container = _within(page, lambda n: n.path == path)
    kept = [b.text for b in page.blocks if not b.bad and (2 * b.linked < len(b.text) or b.node in container)]
    return "\n".join(t for t in kept if t)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, its winning path and its link lists, as hashes.

    The path is the one with the largest sum of votes, ties to the deepest, then to the least. The
    lists are the paths that hold more links than prose on most of the host's pages that have them, but not on all.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                paths = _paths(parse(html.as_py()))
                score = _scores(paths)
                rows += [(host, path, depth, score.get(path), linked > prose) for path, (prose, linked, depth) in paths.items()]
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            types = {"host": pa.string(), "path": pa.int64(), "depth": pa.int32(), "score": pa.float64(), "links": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

    votes = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(vote, "host string, path long, depth int, score double, links boolean")
    # sums of rounded votes don't depend on the order of the rows
    by_path = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1e6).cast("long")).alias("votes"), F.max("depth").alias("depth"), F.count_if("links").alias("links"), F.count("*").alias("n"))
    rank = F.struct((-F.col("votes")).alias("rank"), (-F.col("depth")).alias("depth"), "path")
    return by_path.groupBy("host").agg(
        F.min(F.when(F.col("votes").isNotNull(), rank))["path"].alias("path"),
        F.collect_list(F.when((2 * F.col("links") > F.col("n")) & (F.col("links") < F.col("n")), F.col("path"))).alias("lists"),
    )


#: Numbers in the table of host paths up to which it is broadcast: 8 MB.
BROADCAST_NUMBERS = 1_000_000
#: Parts that the pages of a host are dealt to where the table is too large for that.
SALTS = 32


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and its number of code points.

    Null and empty html give an empty text. Pages without a host vote together as one host. No
    prose is left out but boilerplate and, on pages that the host's path serves, what lies in the
    host's link lists. Repeated rows give repeated results; an empty table gives no rows. Columns
    beyond page_id, url and html are not read. A page is read in linear time whatever it holds.
    """
    paths = materialise(host_paths(pages), "paths")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            texts = [main_text(page.as_py(), path, lists or ()) for page, (path, lists) in zip(batch.column(2), hosts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    numbers = paths.agg(F.sum(4 + F.size("lists"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        joined = held.join(F.broadcast(paths), "host", "left")
    else:  # a host may have a third of all pages
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = held.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path", "lists").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
