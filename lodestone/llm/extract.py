"""Main text of web pages by consensus host paths.

Each page's containers are scored, and the page votes for the generalised
tag-class path of its best one. Votes are summed by host in Spark; the host's
leading paths then extract all its pages again. A path counts if it leads or if
SUPPORT of the host's pages, and two at least, vote for it. A page goes by its
own best container if it has none of the paths, or if the path is the whole
body, or if its own container's score is CLEARLY higher.

Elements are left out by what they are (menus, headers, footers, asides, forms,
scripts and the like), if they are hidden, and by names made for such parts: a
class or id that is one of these words or made of them and plain ones. Words
that an article may use as well (related, search, social) leave out only what
is mostly links.

Defined cases: null or empty html gives an empty text; pages without a host (and
null URLs) vote together as host ``""``; rows with equal ids are separate pages;
an empty table gives an empty result. Text outside any container counts as the
body's. Tags are read by HTML's rules: what a page's end cuts off within a tag, a
comment or a script is no text. Time and memory are linear in the page's length.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .common import written

#: Leading paths that a host keeps; the share of its pages that has to vote for one; how many times better a page's own container must be.
PATHS, SUPPORT, CLEARLY = 3, 0.05, 50
#: Bytes of hosts and paths that are broadcast at most; beyond it they are joined by a shuffle. Characters of the longest path that is written out.
BROADCAST, LONGEST = 16 << 20, 300

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("aside button canvas datalist dialog footer form frame frameset head header iframe input label map menu nav noembed noframes noscript object option script select style svg template textarea title audio video".split())
CONTAINERS = frozenset("article body div main section td".split())
#: An open element of the second kind ends where one of the first begins, unless one of the third stands between.
_CLOSES = [
    (BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption", "body", "html"} | {"form", "nav", "aside", "footer", "header", "menu"}, {"p"}, {"table", "td", "th", "button", "body", "article", "section", "div", "li", "blockquote", "aside", "footer", "header", "nav", "form"}),
    ({"li"}, {"li", "p"}, {"ul", "ol", "menu", "body", "table"}),
    ({"dd", "dt"}, {"dd", "dt", "p"}, {"dl", "body", "table"}),
    ({"td", "th"}, {"td", "th", "p"}, {"tr", "table", "body"}),
    ({"tr"}, {"tr", "td", "th", "p"}, {"table", "tbody", "thead", "tfoot", "body"}),
    ({"tbody", "thead", "tfoot"}, {"tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption"}, {"table", "body"}),
    ({"option"}, {"option"}, {"select", "body"}),
]
CLOSES = {name: (tuple(ends), tuple(stops - SKIPPED)) for names, ends, stops in _CLOSES for name in names}
#: Elements whose content an end tag of another kind doesn't close, and those whose end tags go through them.
BARRIERS = frozenset("article main td table".split())
THROUGH = CONTAINERS | SKIPPED | {"table", "tr", "tbody", "html", "body"}
# Words in classes, ids and roles of what is no main text; those that an article's parts may have, too; words that say nothing beside them.
STRONG = frozenset("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promos promoted replies respond sidebar signup skiplink sponsor sponsored subscribe taboola toolbar widget widgets".split())
WEAK = frozenset("header recommended related search share sharing social".split())
PLAIN = frozenset("add area article aside bar block body bottom box button buttons container content copyright form global google group inner item items legal left link links list main mobile module new outer page panel post posts primary privacy reader right section secondary site skip slot story sub text thread title top unit user view wrap wrapper".split())
#: Those of them that name a part of its own as soon as another word stands beside them.
FIRM = WEAK - {"header", "search"}
#: Those that a section of an article may be about, when they are all that names it, as the place that a link leads to.
TOPICS = frozenset("advertisement advertisements banner captcha consent cookie cookies login menu modal navigation newsletter notice notices pagination popup signup toolbar widget widgets".split())
#: Elements within a line or of code, which no name makes a part of the page.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark pre q s samp small span strong sub sup time tt u var".split())
STRUCTURE = frozenset("article aside center dd details div dl dt fieldset figure li ol section table tbody td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup body main".split())
#: Words that speak for a container.
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.IGNORECASE)

_NAME = re.compile(r"[^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|(["'])|([^\t\n\f\r >]*)))?)""")


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, where the tag ends, whether the page ends before it does), from behind a tag's name."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        # A quote that nothing closes takes the rest of the page.
        if m is None or m[5]:
            return found, len(page), True
        at = m.end()
        if m[1]:
            return found, at, False
        found.setdefault(m[2].lower(), m[3] or m[4] or m[6] or "")


@functools.lru_cache(1 << 14)
def marked(tag: str, class_: str, id_: str, role: str) -> int:
    """2 if the names are those of what is no main text, 1 if they may be, 0 if they aren't."""
    found = 0
    for name in (*class_.split(), id_, *role.split()):
        words = re.sub(r"(?<=[a-z])(?=[A-Z])|[\d_-]+", " ", name).lower().split()
        if not words or tag in HEADINGS or tag in INLINE:
            continue
        if name == id_ and not class_ and tag in ("section", "article") and len(words) == 1 and words[0] in TOPICS:
            found = 1
            continue
        if len(words) == 1 or tag in STRUCTURE and all(w in STRONG or w in WEAK or w in PLAIN for w in words):
            if any(w in STRONG for w in words) or len(words) > 1 and any(w in FIRM for w in words):
                return 2
            if tag in STRUCTURE and any(w in WEAK for w in words):
                found = 1
    return found


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", found.get("style", "").lower())


class Node:
    """An element: the number of its generalised path, whether it is skipped, and where its text begins and ends among the page's pieces."""

    __slots__ = ("above", "commas", "depth", "good", "inside", "links", "mark", "path", "size", "skipped", "start", "stop", "tag")

    def __init__(self, tag: str, path: int, depth: int, skipped: bool, mark: int, good: bool, start: int, inside: int):
        self.tag, self.path, self.depth, self.skipped, self.mark, self.good, self.start, self.inside = tag, path, depth, skipped, mark, good, start, inside
        self.stop, self.size, self.links, self.commas = None, 0, 0, 0
        self.above: Node | None = None


class Paths:
    """A page's generalised paths, each as its last step and the number of the path above it."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "body")]

    def below(self, path: int, step: str) -> int:
        key = path, step
        if key not in self.numbers:
            self.numbers[key] = len(self.steps)
            self.steps.append(key)
        return self.numbers[key]

    def text(self, path: int) -> str:
        """The path's steps, or a digest of more than LONGEST characters."""
        out = []
        while path >= 0:
            path, step = self.steps[path]
            out.append(step)
        whole = ">".join(reversed(out))
        return whole if len(whole) <= LONGEST else "#" + hashlib.sha256(whole.encode()).hexdigest()

    def find(self, text: str, deepest: list[int]) -> int | None:
        """The number of a path; those among ``deepest`` are asked for a digest."""
        if text.startswith("#"):
            return next((p for p in dict.fromkeys(deepest) if self.text(p) == text), None)
        first, *steps = text.split(">")
        at: int | None = 0 if first == "body" else None
        for step in steps:
            at = None if at is None else self.numbers.get((at, step))
        return at


def parse(page: str) -> tuple[list[str | None], list[Node], Paths]:
    """(pieces, containers, paths): the page's kept text in order, with None where a block begins or ends, and its container elements."""
    pieces: list[str | None] = []
    paths = Paths()
    root = Node("body", 0, 0, False, 0, False, 0, 0)
    stack, nodes = [root], [root]
    # Places on the stack of the open elements by tag, of skipped kinds, and of barriers.
    places: dict[str, list[int]] = defaultdict(list)
    skips, barriers = [], []

    def end(k):
        """Close the open elements from place ``k`` on; what they hold counts for their parents, too."""
        while len(stack) > k:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag in SKIPPED:
                skips.pop()
            if node.tag in BARRIERS:
                barriers.pop()
            if node.mark == 1 and not node.skipped and 2 * node.links > node.size:
                # Names that may be an article's, but mostly links: what it held is the end of the pieces.
                del pieces[node.start :], nodes[node.inside :]
                pieces.append(None)
                continue
            if node.tag in BLOCKS:
                pieces.append(None)
            node.stop = len(pieces)
            if not node.skipped:
                stack[-1].size += node.size
                stack[-1].commas += node.commas
                stack[-1].links += node.size if node.tag == "a" else node.links

    def text(raw):
        top = stack[-1]
        if top.skipped or not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        pieces.append(value)
        top.size += len(value.strip())
        top.commas += value.count(",") + value.count(".")

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        while start >= 0 and not (page[start + 1 : start + 2].isascii() and (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("/", "!", "?"))):
            start = page.find("<", start + 1)
        if start < 0 or start + 1 >= n:
            text(page[at:])
            break
        text(page[at:start])
        mark = page[start + 1]
        if mark in "!?" or mark == "/" and not (page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha()):
            if page.startswith("<!--", start):
                close = re.compile("--!?>").search(page, start + 2 if page.startswith(("<!-->", "<!--->"), start) else start + 4)
                at = close.end() if close else n
            else:
                at = page.find(">", start) + 1 or n
            continue
        closing = mark == "/"
        name = _NAME.match(page, start + 1 + closing)
        tag = name[0].lower()
        found, at, cut = attributes(page, name.end())
        if cut:
            break
        if closing:
            if places[tag] and not (barriers and barriers[-1] > places[tag][-1] and tag not in THROUGH):
                end(places[tag][-1])
            if tag in BLOCKS:
                pieces.append(None)
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if not stack[-1].skipped:
                pieces += [" "] if tag == "br" else [None] if tag == "hr" else []
            continue
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            if opened := [places[t] for t in ends if places[t]]:
                stop = max([places[t][-1] for t in stops if places[t]] + skips[-1:], default=0)
                low = min((p[bisect_right(p, stop)] for p in opened if p[-1] > stop), default=None)
                if low is not None:
                    end(low)
        up = stack[-1]
        class_, id_ = html.unescape(found.get("class", "")), html.unescape(found.get("id", ""))
        names = marked(tag, class_, id_, found.get("role", "").lower()) if found else 0
        skipped = up.skipped or tag in SKIPPED or names == 2 or bool(found) and _hidden(found)
        if tag in BLOCKS and not up.skipped:
            pieces.append(None)
        path = up.path
        if tag in CONTAINERS:
            own = (class_ or id_).split()
            path = paths.below(up.path, tag + ("." + re.sub(r"\d+", "#", own[0].lower()).replace(">", "") if own else ""))
        node = Node(tag, path, up.depth + 1, skipped, names, bool(class_ or id_) and bool(GOOD.search(f"{class_} {id_}")), len(pieces), len(nodes))
        node.above = up if up.tag in CONTAINERS else up.above
        if tag in RAW or tag == "plaintext":
            close = re.compile(rf"</{re.escape(tag)}[\t\n\f\r />]", re.IGNORECASE).search(page, at) if tag != "plaintext" else None
            stop = close.start() if close else n
            if not skipped:
                text(page[at:stop])
            at = (page.find(">", stop) + 1 or n) if close else n
            continue
        if tag in ("svg", "math", "path") and page[at - 2] == "/":
            continue
        places[tag].append(len(stack))
        if tag in SKIPPED:
            skips.append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        stack.append(node)
        if tag in CONTAINERS and not skipped:
            nodes.append(node)
    end(1)
    root.stop = len(pieces)
    return pieces, nodes, paths


def score(node: Node) -> float:
    """What speaks for a container as the main one: kept text outside links, more for elements and names made for it."""
    plain = max(0, node.size - node.links)
    weight = {"article": 2.0, "main": 1.6, "body": 0.5}.get(node.tag, 1.0) * (1.3 if node.good else 1.0)
    return weight * (plain + 10 * node.commas) * (plain / node.size if node.size else 0)


def _whole(node: Node) -> bool:
    """Whether the container around a node holds text that the node leaves out: no more than it has, and hardly any of it links."""
    up = node.above
    if up is None or node.tag not in ("div", "section"):
        return False
    more, links = up.size - up.links - node.size + node.links, up.links - node.links
    return 0 < more <= node.size - node.links and 4 * links <= more


def best(nodes: list[Node]) -> Node:
    """The container with the highest score; of equal ones the innermost, then the first. What stands beside it as text belongs to it: then the one around both counts."""
    found = max(enumerate(nodes), key=lambda x: (score(x[1]), x[1].depth, -x[0]))[1]
    while _whole(found):
        found = found.above
    return found


def joined(pieces: list[str | None], spans: list[tuple[int, int]]) -> str:
    """The blocks of these stretches: white space runs as one space, blocks apart by an empty line."""
    out = []
    for a, b in spans:
        held: list[str] = []
        for x in [*pieces[a:b], None]:
            if x is not None:
                held.append(x)
            elif held:
                if block := " ".join("".join(held).split()):
                    out.append(block)
                held = []
    return "\n\n".join(out)


def main_text(page: str | None, leading: list[str] | None = None) -> tuple[str, str]:
    """(text, path): by the first of the ``leading`` paths that the page has with any text, else by its own best container."""
    if not page:
        return "", ""
    pieces, nodes, paths = parse(page)
    own = best(nodes)
    for path in leading or ():
        number = paths.find(path, [x.path for x in nodes if x.size])
        chosen: list[Node] = []
        for node in nodes if number else ():
            if node.path == number and node.size and (not chosen or node.start >= chosen[-1].stop):
                chosen.append(node)
        if chosen and score(own) <= CLEARLY * sum(map(score, chosen)):
            return joined(pieces, [(x.start, x.stop) for x in chosen]), path
    return joined(pieces, [(own.start, own.stop)]), paths.text(own.path)


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, score) of each page with any text, from (host, html)."""
    for part in slices(batches, "html"):
        out = []
        for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if page:
                _, nodes, paths = parse(page)
                node = best(nodes)
                if node.size:
                    out.append((host, paths.text(node.path), score(node)))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["host", "path", "score"])


def host_paths(rows: DataFrame, keep: int = PATHS, support: float = SUPPORT) -> DataFrame:
    """(host, paths): each host's leading paths by pages that vote for them, then by score; the first, and others with enough votes."""
    voted = rows.mapInArrow(votes, "host string, path string, score double")
    # Written, as it is read twice and pages should be parsed once for it.
    summed = written(voted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score", 3).cast("decimal(20,3)")).alias("score")), "votes")
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    led = summed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    enough = (F.col("place") == 1) | (F.col("n") >= F.greatest(F.lit(2.0), support * F.col("pages")))
    led = led.join(summed.groupBy("host").agg(F.sum("n").alias("pages")), "host").filter(enough)
    return led.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, path): the main text of each page and the path that it was found on."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    led = written(host_paths(rows.select("host", "html")), "paths")
    size = led.agg(F.sum(64 + F.octet_length("host") + F.aggregate("paths", F.lit(0), lambda a, x: a + 32 + F.octet_length(x)))).first()[0] or 0
    few = size <= BROADCAST
    found = rows.join(F.broadcast(led) if few else led, "host", "left").select("page_id", "url", "paths", "html")
    kind = dict(found.dtypes)["page_id"]

    def run(batches):
        for part in slices(batches, "html"):
            out = [main_text(page, paths) for paths, page in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            text, path = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(path, pa.string())], names=["page_id", "url", "text", "path"])

    return found.mapInArrow(run, f"page_id {kind}, url string, text string, path string")
