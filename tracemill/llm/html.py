"""Main text of web pages by consensus paths of their host (operator 7).

Every page is cut into tags and text. Its text blocks give points to the containers around them; a
container is known by its generalised path, the tags and classes from the root with numbers taken out.
Each page votes for its best path with its points, Spark adds up the votes of each host, and every page
is extracted again with its host's winning path: all blocks inside containers of that path, in page
order, without the parts that are never main text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments of readers), whether told by tag or by class. A page without the winning path
uses its own best one.

Defined cases: NULL or empty html has an empty text. Pages without a host in their url vote together.
Repeated rows vote and are extracted as often as they occur. Texts are whole: nothing is cut off.
Ties go to the path that sorts first. Columns of the input other than id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import text_blocks
from tracemill.operators.joins import join_spread
from tracemill.session import BROADCAST_ROWS, durable

# The rest of a tag up to its end; quotes count only where a value begins. Nothing is tried twice.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)""", re.I)
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
# Those that go on to the end of the page if they are not closed.
ENDLESS = frozenset("script style".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded semantics""".split()
)
CONTAINERS = frozenset("html body div section article main center td table tbody tr blockquote ul ol dl figure details".split())
# Parts that are never main text, by tag and by the words of class, id or role.
NEVER_TAGS = frozenset("nav footer aside form header dialog button menu".split())
NEVER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent
    contentinfo cookie cookies discussion disqus footer form gdpr masthead menu modal nav navbar navigation newsletter notice
    notices notification paywall popup promo promoted promotion recommended related replies respond share sharing sidebar
    social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)
GOOD_WORDS = frozenset("article content entry main post story text".split())
# Start tags that end an open element of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


class _Parts:
    """The tags and texts of a page, in order: ``(text, None, False, "")`` or ``("", tag, is_end, attributes)``.

    Time grows with the length of the page, whatever it holds. A ``<`` without an end of its tag is text.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.loose = False  # a tag was found whose quotes never close: they count no more
        self.closed: dict[str, bool] = {}

    def _tag_end(self, at: int) -> int:
        if not self.loose:
            m = _REST.match(self.html, at)
            if m:
                return m.end()
            self.loose = True
        return self.html.find(">", at) + 1

    def _skip_raw(self, tag: str, at: int) -> int:
        """Where the content and end tag of a raw element end; ``at`` if it is never closed."""
        end = None
        if self.closed.get(tag, True):
            end = re.compile(rf"</{tag}(?=[\\s/>])[^>]*+>", re.I).search(self.html, at)
            self.closed[tag] = end is not None
        return end.end() if end else len(self.html) if tag in ENDLESS else at

    def __iter__(self):
        html, at = self.html, 0
        while True:
            start = html.find("<", at)
            while 0 <= start <= self.last and not (html[start + 1 : start + 2] in ("!", "?", "/") or _NAME.match(html, start + 1)):
                start = html.find("<", start + 1)
            if start < 0 or start > self.last:
                yield html[at:], None, False, ""
                return
            if start > at:
                yield html[at:start], None, False, ""
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                if end < 0:
                    return
                at = end + 3
                continue
            is_end = html[start + 1] == "/"
            name = _NAME.match(html, start + 1 + is_end)
            if name is None:  # a declaration
                at = html.find(">", start) + 1
                continue
            tag = name[0].lower()
            at = self._tag_end(name.end())
            rest = html[name.end() : at - 1]
            yield "", tag, is_end, rest
            if tag in RAW and not is_end and (tag in ENDLESS or not rest.endswith("/")):
                at = self._skip_raw(tag, at)


# Why an element may be left out: its tag, its names, or its names though some of them are those of main text.
BY_TAG, BY_NAME, DOUBTFUL = 1, 2, 3


class Page:
    """Containers and text blocks of a page.

    Elements that are never main text by tag or by name are left out, unless the page would lose its text
    with them: where no ``article`` or ``main`` stands outside of them, those that hold one stay, and
    doubtful ones that hold more than half of the text; where nothing at all would be left, those told by
    name stay, and if that is not enough, all.
    """

    def __init__(self, html: str | None) -> None:
        # Node 0 is the page. Paths are numbers of (path of the parent, name); only a winner is spelled out.
        self.parents, self.paths = [-1], [0]
        self.known: dict[tuple[int, str], int] = {(-1, "html"): 0}
        self.spelled: list[tuple[int, str]] = [(-1, "html")]
        self.good, self.main, self.flags = [False], [False], [0]
        # Pieces of text with their node, and characters in links, of each block.
        self._pieces: list[tuple[list[tuple[int, str]], int]] = []
        self._parse(html or "")
        self.alive = self._alive()
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        for pieces, links in self._pieces:
            kept = [(node, part) for node, part in pieces if self.alive[node]]
            line = " ".join(unescape("".join([part for _, part in kept])).split())
            if line:
                self.blocks.append((kept[0][0], line, links))

    def _node(self, parent: int, tag: str, rest: str) -> int:
        """The node of an element; its parent's if it is neither a container nor to be left out."""
        found = _ATTR.findall(rest) if rest else []
        words = set(_WORD.findall(" ".join(v.strip("\"'").lower() for _, v in found)))
        good = tag in ("article", "main") or not words.isdisjoint(GOOD_WORDS)
        flag = 0
        if tag in NEVER_TAGS:
            flag = BY_TAG
        elif tag not in ("html", "body") and not words.isdisjoint(NEVER_WORDS):
            flag = 0 if tag == "main" else DOUBTFUL if good else BY_NAME
        if tag == "html" or not flag and tag not in CONTAINERS:
            return parent
        classes = {_NUMBER.sub("#", c) for k, v in found if k.lower() == "class" for c in v.strip("\"'").lower().replace(">", "").split()}
        key = (self.paths[parent], ".".join([tag, *sorted(classes)]))
        if key not in self.known:
            self.known[key] = len(self.spelled)
            self.spelled.append(key)
        self.parents.append(parent)
        self.paths.append(self.known[key])
        self.good.append(good)
        self.main.append(tag in ("article", "main"))
        self.flags.append(flag)
        return len(self.parents) - 1

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, node, whether it is a scope
        opened: Counter[str] = Counter()  # open elements, and those of the innermost scope
        scopes: list[tuple[str, Counter[str]]] = [("", Counter())]
        text: list[tuple[int, str]] = []
        in_link = links = 0

        def flush() -> None:
            nonlocal text, links
            if text:
                self._pieces.append((text, links))
            text, links = [], 0

        def close(tag: str) -> None:
            nonlocal in_link
            while stack:
                name, _, scope = stack.pop()
                opened[name] -= 1
                if scope:
                    scopes.pop()
                else:
                    scopes[-1][1][name] -= 1
                in_link -= name == "a"
                if name == tag:
                    return

        for part, tag, is_end, rest in _Parts(html):
            if tag is None:
                text.append((stack[-1][1] if stack else 0, part))
                if in_link:
                    links += len(part)
                continue
            if tag not in INLINE:
                flush()
            if is_end:
                if opened[tag]:
                    close(tag)
                continue
            if tag in VOID or tag in RAW:
                continue
            for ended in CLOSES.get(tag, ("p",) if tag in CLOSES_P else ()):
                # Only within the innermost scope.
                if scopes[-1][0] == ended or scopes[-1][1][ended]:
                    close(ended)
            if rest.endswith("/") and tag in INLINE:
                continue
            parent = stack[-1][1] if stack else 0
            node = self._node(parent, tag, rest)
            scope = tag in CONTAINERS or tag in NEVER_TAGS
            stack.append((tag, node, scope))
            opened[tag] += 1
            in_link += tag == "a"
            if scope:
                scopes.append((tag, Counter()))
            else:
                scopes[-1][1][tag] += 1
        flush()

    def _alive(self) -> list[bool]:
        n = len(self.parents)
        if not any(self.flags):
            return [True] * n
        own, texts = [0] * n, []
        for pieces, links in self._pieces:
            for node, part in pieces:
                size = len(" ".join(part.split()))
                own[node] += max(0, size - 2 * min(links, size)) if links else size
                if size:
                    texts.append(node)
        total, mains = own[:], [int(m and not f) for m, f in zip(self.main, self.flags)]
        for i in range(n - 1, 0, -1):
            total[self.parents[i]] += total[i]
            mains[self.parents[i]] += mains[i]

        def spread(kept) -> list[bool]:
            alive = [True] * n
            for i in range(1, n):
                alive[i] = alive[self.parents[i]] and (not self.flags[i] or kept(i))
            return alive

        def told(alive: list[bool]) -> bool:
            return any(alive[node] for node in texts)

        alive = spread(lambda i: False)
        if not any(m and a for m, a in zip(self.main, alive)):
            alive = spread(lambda i: mains[i] > 0 or self.flags[i] == DOUBTFUL and 2 * total[i] > total[0])
        if not told(alive):
            alive = spread(lambda i: self.flags[i] != BY_TAG or mains[i] > 0)
        return alive if told(alive) else [True] * n

    def spell(self, path: int) -> str:
        names = []
        while path >= 0:
            path, name = self.spelled[path]
            names.append(name)
        return ">".join(reversed(names))

    def _number(self, path: str | None) -> int:
        """The number of a spelled path; -1 if the page has none."""
        at = -1
        for name in path.split(">") if path else ():
            at = self.known.get((at, name), -2)
            if at < 0:
                return -1
        return at

    def points(self) -> list[float]:
        """Points of each path: a block counts whole for its container, half for each one further out.

        Containers that are called main text count blocks of any depth whole and get a fifth more.
        """
        n = len(self.parents)
        whole, near = [0] * n, [0.0] * n
        for node, line, links in self.blocks:
            if self.alive[node]:
                worth = max(0, len(line) - 2 * links)
                whole[node] += worth
                near[node] += worth
        found = [0.0] * len(self.spelled)
        for i in range(n - 1, -1, -1):
            found[self.paths[i]] += 1.2 * whole[i] if self.good[i] else near[i]
            if i:
                whole[self.parents[i]] += whole[i]
                near[self.parents[i]] += near[i] / 2
        return found

    def best(self) -> tuple[str, float] | None:
        """The path with the most points; of equal ones that which sorts first. None without text."""
        found = self.points()
        most = max(found)
        if not most:
            return None
        return min(self.spell(i) for i, p in enumerate(found) if p == most), most

    def _inside(self, path: int) -> str:
        inside = [False] * len(self.parents)
        for i, p in enumerate(self.paths):
            inside[i] = self.alive[i] and (p == path or i > 0 and inside[self.parents[i]])
        return " ".join([line for node, line, _ in self.blocks if inside[node]])

    def text(self, path: str | None) -> str:
        """Blocks inside containers of a path; of the page's own best one if it has no text there."""
        found = self._inside(self._number(path))
        if found:
            return found
        own = self.best()
        return self._inside(self._number(own[0]) if own else 0)


def host_of(url: str):
    """Lower-case host of a url column; empty if there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, points`` of each page's best path; ``pages`` has ``host, html``."""

    def run(batches):
        for b in batches:
            for block in text_blocks(b, "html"):
                best = [Page(h).best() for h in block.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [block.column("host"), pa.array([x and x[0] for x in best], pa.string()), pa.array([x and x[1] for x in best], pa.float64())],
                    names=["host", "path", "points"],
                )

    return pages.select("host", "html").mapInArrow(run, "host string, path string, points double").where("path IS NOT NULL")


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, n_pages`` with the winning path of each host; a page's vote is its points in whole."""
    found = votes(pages).groupBy("host", "path").agg(F.sum(F.round("points").cast("long")).alias("points"), F.count(F.lit(1)).alias("n"))
    return found.groupBy("host").agg(F.min(F.struct((-F.col("points")).alias("less"), "path")).alias("won"), F.sum("n").alias("n_pages")).select(
        "host", F.col("won.path").alias("path"), "n_pages"
    )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, path`` of every page."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host_of(url).alias("host"))
    winners = durable(host_paths(rows))
    small = winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    size = winners.agg(F.sum(F.length("host") + F.length("path"))).head()[0] or 0
    if small and size <= 64 << 20:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        joined = join_spread(rows, winners, ["host"], "n_pages", ["id", "url"], how="left")

    def run(batches):
        for b in batches:
            for block in text_blocks(b, "html"):
                texts = [Page(h).text(p) for h, p in zip(block.column("html").to_pylist(), block.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("url"), pa.array(texts, pa.string()), block.column("path")], names=["id", "url", "text", "path"])

    kind = rows.schema["id"].dataType.simpleString()
    found = joined.select("id", "url", "html", "path").mapInArrow(run, f"id {kind}, url string, text string, path string")
    return found.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", "path")
