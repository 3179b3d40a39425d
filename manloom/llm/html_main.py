"""Main text of web pages by the consensus of each host's pages.

Each page scores its containers by the running text that they hold and names its best one by a
generalised path of tags and classes.  Spark counts these votes per host.  A block whose name only
hints at a side (``related-x9``, but ``search-history`` too), or that stands beside the best container
in a larger one, is judged by its host as well: it is one if it is mostly links or says the same on
most pages.  Every page is then read again with the
winning paths and the sides of its host; a page that has none of the paths falls back on its own
best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|iframe|svg|canvas|object|select|textarea|button|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[a-zA-Z/][^>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("article main section div td body center".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split())
#: What a start tag ends when it stands open above it.
_PARAGRAPH_ENDS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_GROUP = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_SCOPE = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt",), "table": ("tr", "td"), "tr": ("td",), "select": ("option",), **{t: ("p",) for t in _CONTAINERS - {"td"}}, "td": ("p",), "th": ("p",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
#: Words that name a side, and words that say nothing about what a block holds.
_SIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside footer ad ads advert adverts advertisement advertising banner sponsor sponsors sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts "
    "comment comments discussion discussions disqus respond reply replies form forms newsletter subscribe subscription signup login search share sharing social related recommended breadcrumb breadcrumbs popup modal overlay pagination pager skip toc masthead widget widgets".split()
)
_PLAIN_WORDS = frozenset("wrapper wrap container layout page box block area section item items list inner outer left right top bottom side bar column col row group panel holder slot unit text body site global primary secondary main the and for to of us links link posts post articles stories btn button icon icons".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_FRAME_WORDS = frozenset("has with no without main content".split())
_RUN = 16  # equal segments in a row that a path tells apart


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())


def _segment(tag: str, classes: list[str]) -> str:
    """A tag with its classes, digits taken out of them."""
    return ".".join([tag, *sorted({c for c in (re.sub(r"[\d>]+", "", x).strip("-_") for x in classes) if c})]).replace(">", "")


def _side(tag: str, classes: list[str], ids: list[str], role: str, hidden: bool, in_article: bool) -> bool | None:
    """Whether an element is a side by itself; None if its name hints at one but says more, too.

    A section's id within an article is made from its heading as a rule, so it only hints; a heading is
    no side."""
    if tag in ("html", "body", "main"):
        return False
    if hidden or tag in _SIDE_TAGS or role in _ROLES:
        return True
    if in_article and tag in _HEADINGS:
        return False
    told = [_words(n) for n in (classes if in_article and tag == "section" else classes + ids)]
    words = {w for n in classes + ids for w in _words(n)}
    framed = bool(words & _FRAME_WORDS)
    if not in_article and tag != "article" and (tag == "header" or (any(ws and set(ws) <= {"header", *_PLAIN_WORDS} and "header" in ws for ws in told) and not framed)):
        return True
    for ws in told:
        if any(w in _SIDE_WORDS for w in ws) and all(w in _SIDE_WORDS or w in _PLAIN_WORDS for w in ws) and not set(ws) & _FRAME_WORDS:
            return True
    return None if words & _SIDE_WORDS else False


class _Element:
    __slots__ = ("depth", "doubt", "in_article", "key", "link", "node", "opened", "parent", "places", "run", "score", "segment", "side", "tag")

    def __init__(self, tag, segment, parent, side, in_article, link, doubt):
        self.tag, self.segment, self.parent, self.side, self.in_article, self.link = tag, segment, parent, side, in_article, link
        self.run = parent.run + 1 if parent and parent.segment == segment else 1
        self.key = parent.key if self.run > _RUN else xxhash.xxh64_intdigest(segment, parent.key if parent else 0)  # of the whole path
        self.doubt = self if doubt else parent.doubt if parent else None  # nearest element that may be a side
        self.score, self.depth = 0.0, parent.depth + 1 if parent else 0
        self.places: tuple[tuple[int, _Element], ...] | None = None
        self.node = self if tag in _CONTAINERS or parent is None else parent.node  # nearest container
        self.opened: dict[str, int] = {}  # where an element stands open that a start tag may end


def _walk(page: str, sides: frozenset[int] = frozenset()):
    """Yields ``(element, text)`` for text and ``(element, None)`` where a block or line ends.  Elements
    whose path is among ``sides`` are sides.  The time is in proportion to the page, however deep."""
    stack = [_Element("", "", None, False, False, False, False)]
    standing: Counter = Counter()  # open elements by tag

    def cut(at: int) -> None:
        for e in stack[at:]:
            standing[e.tag] -= 1
        del stack[at:]

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield stack[-1], text
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE and tag not in _MATH:
            yield stack[-1], None
        if m["end"] or m["end2"]:
            if standing[tag] > 0:
                at = len(stack) - 1
                while stack[at].tag != tag:
                    at -= 1
                cut(at)
            continue
        if tag in _VOID:
            continue
        opened = stack[-1].opened
        ends = [opened[g] for g in (("p",) if tag in _PARAGRAPH_ENDS else ()) + ((_GROUP[tag],) if tag in _GROUP else ()) if g in opened]
        if ends:
            cut(min(ends))
        attrs, classes, ids, role, hidden = m["attrs"] or m["attrs2"], [], [], "", False
        if attrs:
            for name, value in _ATTRIBUTE.findall(attrs):
                name, value = name.lower(), html.unescape(value.strip("\"'"))
                if name == "class":
                    classes = value.split()
                if name == "id":
                    ids = value.split()
                role, hidden = value.lower() if name == "role" else role, hidden or name == "hidden"
        up = stack[-1]
        own = _side(tag, classes, ids, role, hidden, up.in_article)
        one = _Element(tag, _segment(tag, classes), up, up.side or bool(own), up.in_article or tag == "article", up.link or tag == "a", own is None)
        one.side = one.side or one.key in sides
        one.opened = up.opened
        if tag in _SCOPE or tag in _GROUP:
            one.opened = {g: i for g, i in up.opened.items() if g not in _SCOPE.get(tag, ())}
            if tag in _GROUP:
                one.opened[_GROUP[tag]] = len(stack)
        stack.append(one)
        standing[tag] += 1


def _path(element: _Element) -> str:
    segments = []
    while element.parent is not None:
        if element.run <= _RUN:
            segments.append(element.segment)
        element = element.parent
    return ">".join(reversed(segments))


class _Told:
    """What is said directly in a container or block: a hash, characters, and those of them in links."""

    __slots__ = ("hash", "links", "size")

    def __init__(self) -> None:
        self.hash, self.size, self.links = xxhash.xxh64(), 0, 0

    def add(self, text: str, size: int, link: bool) -> None:
        self.hash.update(text.strip().encode("utf-8", "surrogatepass"))
        self.size += size
        self.links += size if link else 0


def _lifted(best: _Element, direct: dict[_Element, _Told]) -> tuple[_Element, list[_Element]]:
    """The container around ``best``, short of the page's body, that says a tenth more in running text
    than what is below it; and the containers that it adds, of which the host may find some sides."""
    nodes: set[_Element] = set()
    for node in direct:
        while node is not None and node not in nodes:
            nodes.add(node)
            node = node.parent.node if node.parent is not None else None
    order = sorted(nodes, key=lambda e: e.depth)
    whole = {e: max(0, t.size - 2 * t.links) if (t := direct.get(e)) else 0 for e in order}
    for e in reversed(order):
        if e.parent is not None:
            whole[e.parent.node] += whole[e]
    root, at = best, best
    while at.parent is not None and (at := at.parent.node).tag not in ("body", "html", ""):
        if whole[at] * 10 >= whole[root] * 11:
            root = at
    if root is best:
        return best, []
    inside, added = {root: True, best: False}, []
    for e in order:
        if e.parent is not None and e not in inside:
            inside[e] = inside.get(e.parent.node, False)
            if inside[e] and e in direct:
                added.append(e)
    on_the_way = set()
    while best is not root:
        on_the_way.add(best)
        best = best.parent.node
    return root, [e for e in added if e not in on_the_way]


def surveyed(page: str, sides: frozenset[int] = frozenset()) -> tuple[str | None, list[tuple[str, int, int, int]]]:
    """The page's best path, and ``(path, hash, characters, of them in links)`` of the text of each
    block that may be a side.

    The best is the container with the most running text, lifted to the article or main element
    around it, or else to the container that holds the rest of it; None if no text stands outside
    of the sides."""
    direct: dict[_Element, _Told] = {}
    doubts: dict[_Element, _Told] = {}
    scored: dict[_Element, None] = {}
    for element, text in _walk(page, sides):
        if text is None or element.side or not (size := len(text.strip())):
            continue
        worth = -size / 2 if element.link else size
        if (doubt := element.doubt) is not None:
            doubts.setdefault(doubt, _Told()).add(text, size, element.link)
        node = element.node
        direct.setdefault(node, _Told()).add(text, size, element.link)
        node.score += worth
        scored[node] = None
        if node.parent is not None:
            above = node.parent.node
            above.score += worth / 2
            scored[above] = None
    best = max(scored, key=lambda e: e.score, default=None)
    blocks = list(doubts.items())
    if best is not None:
        framed = next((at for wanted in ("article", "main") if (at := _around(best, wanted)) is not None), None)
        if framed is not None:
            best = framed
        else:
            best, added = _lifted(best, direct)
            blocks += [(e, direct[e]) for e in added if e not in doubts]
    found = [(_path(e), t.hash.intdigest() - (1 << 63), t.size, t.links) for e, t in blocks]
    return (None if best is None else _path(best)), found


def _around(element: _Element | None, tag: str) -> _Element | None:
    while element is not None and element.tag != tag:
        element = element.parent
    return element


def path_key(path: str) -> int:
    key = xxhash.xxh64_intdigest("", 0)
    for segment in path.split(">") if path else []:
        key = xxhash.xxh64_intdigest(segment, key)
    return key


def _places(element: _Element, wanted: dict[int, int]) -> tuple[tuple[int, _Element], ...]:
    """Which wanted paths the element stands at or below, each once, and at which element."""
    above = element.parent.places if element.parent is not None else ()
    own = wanted.get(element.key)
    return above if own is None or any(p == own for p, _ in above) else (*above, (own, element))


def text_at(page: str, paths: list[str], sides: frozenset[int] = frozenset()) -> str | None:
    """The text at the first of ``paths`` that the page has text at: of all elements there, but of
    several articles only those with a third of the running text of the fullest, as shorter ones
    lead elsewhere."""
    wanted = {path_key(p): i for i, p in reversed(list(enumerate(paths)))}
    found: dict[int, dict[int, list]] = {}
    for element, text in _walk(page, sides):
        if element.side:
            continue
        if element.places is None:
            chain = []
            while element is not None and element.places is None:
                chain.append(element)
                element = element.parent
            for x in reversed(chain):
                x.places = _places(x, wanted)
            element = chain[0]
        for place, root in element.places:
            told = found.setdefault(place, {}).setdefault(id(root), [root, 0, []])
            told[2].append(" " if text is None else html.unescape(text))
            if text is not None:
                told[1] += len(text.strip()) * (-1 if element.link else 2)
    for place in sorted(found):
        parts = list(found[place].values())
        if parts[0][0].tag in ("article", "main"):
            most = max(p[1] for p in parts)
            parts = [p for p in parts if p[1] * 3 >= most]
        if text := " ".join(" ".join("".join(p[2]) for p in parts).split()):
            return text
    return None


def main_text(page: str, paths: list[str], sides: frozenset[int] = frozenset()) -> str:
    """Text at the winning paths, else at the page's own best path, else empty."""
    text = text_at(page, paths, sides) if paths else None
    if text is None:
        own, _ = surveyed(page, sides)
        text = text_at(page, [own], sides) if own is not None else None
    return text or ""


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def host_paths(pages: DataFrame, least_share: float = 0.05, repeats: int = 3) -> DataFrame:
    """``(host, html)`` -> ``(host, paths, sides)``: the paths with at least ``least_share`` of the
    host's votes, best first, and the paths of doubtful blocks that are sides on this host: half of
    their text in links, or the same text on half of the pages that have one and on ``repeats``."""

    def each(batches):
        told: dict[tuple, list[int]] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best, doubts = surveyed(page.as_py())
                rows = [(best, 0, 0, 0, False)] if best is not None else []
                for path, text, size, links, doubtful in [*rows, *((*d, True) for d in doubts)]:
                    sums = told.setdefault((host, path, text, doubtful), [0, 0, 0])
                    sums[0], sums[1], sums[2] = sums[0] + 1, sums[1] + size, sums[2] + links
            if len(told) > 100_000:
                yield flushed(told)
        yield flushed(told)

    def flushed(told):
        columns = [list(c) for c in zip(*told, strict=True)] or [[], [], [], []]
        sums = [list(c) for c in zip(*told.values(), strict=True)] or [[], [], []]
        told.clear()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, *sums], kinds, strict=True)], ["host", "path", "text", "doubtful", "n", "size", "links"])

    told = pages.select("host", "html").mapInArrow(each, "host string, path string, text long, doubtful boolean, n long, size long, links long")
    told = keep(told.groupBy("host", "path", "text", "doubtful").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links")), "host-votes")
    votes = told.where("NOT doubtful").select("host", "path", F.col("n").alias("votes"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    winners = votes.withColumn("share", share).where(F.col("share") >= least_share).groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))
    blocks = told.where("doubtful").groupBy("host", "path").agg(F.sum("n").alias("n"), F.max("n").alias("same"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    is_side = (F.col("links") * 2 >= F.col("size")) | ((F.col("same") * 2 >= F.col("n")) & (F.col("same") >= repeats))
    sides = blocks.where(is_side).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("sides"))
    return winners.join(sides, "host", "full")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, slices: int = 32) -> DataFrame:
    """``(page_id, url, text, n_chars, paths)``, one row per input row.

    Null or empty html gives empty text.  Pages without a host in their url (null too) form one
    host.  Repeated rows repeat, with their votes; a null id keeps its row; an empty table gives no
    rows; other columns are ignored whatever their names.  A host's pages are dealt over
    ``slices`` tasks at least, however many it has.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    winners = keep(host_paths(rows), "host-paths").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("page_id", "html"), F.lit(slices))).join(winners, ["host", "slice"], "left")

    def each(batches):
        for batch in batches:
            paths, sides = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            texts = [main_text(page.as_py(), ways or [], frozenset(map(path_key, out or ()))) for page, ways, out in zip(batch.column(2), paths, sides, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.list_(pa.string()))],
                ["page_id", "url", "text", "n_chars", "paths"],
            )

    return dealt.select("page_id", "url", "html", "paths", "sides").mapInArrow(each, "page_id long, url string, text string, n_chars long, paths array<string>")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
