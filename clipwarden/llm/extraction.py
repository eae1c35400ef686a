"""Main text of web pages, from the container paths that pages of a host agree on.

Each page is read into a tree of block elements.  Elements that their tag, role
or class names as a menu, footer, notice, advert, form or discussion count as
boilerplate, unless they enclose the article.  From the top, the page's
container is narrowed down while one container inside holds most of the plain
text; the path of tags and classes to it (numbers left out) gets the page's
vote.  Spark sums the votes by host and path, and a page is then read by a path
its host agrees on, if it has one, otherwise by its own.

A page is parsed once: its tree with the kept text is written, read for the
votes and read again with the paths.  A host keeps at most 1 / ``LEAST_SHARE`` paths.
Hosts with at least 1 / ``HOT_HOSTS`` of all pages are at most ``HOT_HOSTS``:
their paths go to all workers, so pages of a large host are never dealt by host.

Null pages give empty text; a null address counts as a host of its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .line_dedup import url_host
from .text import stored

MOST = 0.7  # of the text that a container inside must hold to be chosen over the outer one
LEAST_SHARE = 0.05  # of a host's votes that a path needs
AGREED = 3  # pages behind a path that a host agrees on
VOTE = 2000  # characters that a page's vote counts for at most
HOT_HOSTS = 1000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']++|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: element names of HTML by their role
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr input link meta param source track".split())
_RAW = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in "script style textarea title xmp iframe noembed noframes".split()}
_ABOVE = frozenset("html head body".split())
_CONTAINERS = frozenset("article center div main section td th".split())
_NEVER = frozenset("aside audio button canvas datalist dialog footer menu meter nav noscript object progress select svg template video".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
_WITHIN = frozenset("ul ol dl table div section article main td body".split())  # implied ends stop at these
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# words of class and id names
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie "
    "cookies copyright disclaimer discussion disqus dropdown footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond rail "
    "search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
_ARTICLE = frozenset("article entry post story".split())
_NOT_OWN = frozenset("has have is js no not with without".split())
_COMMENTS = re.compile(r"^(?:\d+\s+)?(?:comments?|reader comments|responses?|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?:?$", re.I)


def _attributes(tag: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(tag[_NAME.match(tag).end() :]):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _general(name: str) -> str:
    """A class or id name up to its first digit, so that numbered and generated names agree."""
    at = next((k for k, c in enumerate(name) if c.isdigit()), None)
    return name if at is None else name[:at] + "*"


@lru_cache(20_000)
def _element(name: str, tag: str) -> tuple[str, bool, bool]:
    """Step of the path, whether tag and attributes speak of boilerplate, and whether of an article."""
    given = _attributes(tag) if len(tag) > len(name) + 2 else {}
    classes = given.get("class", "").split()
    marked = [c for c in classes + [given.get("id", "")] if c]
    step = name + "".join(sorted({"." + _general(c) for c in classes})) + ("#" + _general(given["id"]) if given.get("id") else "")
    words = [[w.lower() for w in _WORD.findall(c)] for c in marked]
    words = [w for w in words if w and w[0] not in _NOT_OWN]
    asked = [w[:1] for w in words] if name in ("article", "main") else words
    hint = (
        name in _NEVER or name in ("form", "header") or given.get("role", "").lower() in _ROLES or "hidden" in given
        or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        or any(not _BOILERPLATE.isdisjoint(w) for w in asked)
    )
    return step, hint, name == "article" or given.get("itemprop") == "articleBody" or any(not _ARTICLE.isdisjoint(w) for w in words)


class Page:
    """Block elements of a page, with their texts, in page order."""

    def __init__(self, source: str):
        # one entry per element; the first stands for the page
        self.parent, self.tag, self.path, self.hint, self.stop = [-1], ["body"], [""], [False], [False]
        self.blocks: list[tuple[int, str, int, bool]] = []  # element, text, characters in links, in a heading
        self.links = [0]
        self._read(source)
        self._judge()

    def _open(self, parent: int, name: str, tag: str) -> int:
        step, hint, stop = _element(name, tag)
        path = f"{self.path[parent]}/{step}"
        self.path.append(path if len(path) < 600 else xxhash.xxh3_128_hexdigest(path.encode()))
        self.hint.append(hint)
        self.stop.append(stop)
        self.parent.append(parent)
        self.tag.append(name)
        self.links.append(0)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack, held, linked, link_depth = [0], [], 0, None
        heading = False

        def flush():
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1], text, min(linked, len(text)), heading))
            held, linked = [], 0

        def cut(depth):
            nonlocal link_depth
            del stack[depth:]
            if link_depth is not None and link_depth > depth:
                link_depth = None

        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            text = source[at : found.start() if found else end]
            if found is None and (broken := re.search(r"</?[a-zA-Z!?][^<>]*\Z", text)):
                text = text[: broken.start()]  # a tag that the page's end cuts off
            if text:
                text = unescape(text) if "&" in text else text
                held.append(text)
                if link_depth is not None:
                    linked += len(text.strip())
            if found is None:
                break
            at, tag = found.end(), found.group()
            if tag[1] in "!?":
                continue
            name = _NAME.match(tag).group(1).lower()
            if name == "a":
                link_depth = len(stack) if tag[1] != "/" and "href" in tag.lower() else None
                self.links[stack[-1]] += link_depth is not None
                continue
            if name in _INLINE:
                continue
            flush()
            if tag[1] == "/":
                if name in _HEADINGS:
                    heading = False
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        cut(depth)
                        break
                continue
            if name in _RAW:
                close = _RAW[name].search(source, at)
                at = close.start() if close else end
                continue
            if name in _VOID or name in _ABOVE:
                continue
            ends = _CLOSES.get(name, ()) if name in _CLOSES else {"p"}
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[depth]]
                if open_tag in ends or open_tag == "p":
                    cut(depth)
                elif open_tag in _WITHIN or name not in _CLOSES:
                    break
            heading = name in _HEADINGS
            stack.append(self._open(stack[-1], name, tag))
        flush()

    def _sums(self, value: list[int]) -> list[int]:
        """Adds the values of the elements inside to each element's own."""
        total = list(value)
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return total

    def _judge(self) -> None:
        n = len(self.parent)
        size, linked, titled = [0] * n, [0] * n, [0] * n
        for k, text, in_links, heading in self.blocks:
            size[k] += len(text)
            linked[k] += in_links
            titled[k] += heading and self.tag[k] == "h1"
        articles = self._sums([int(t in ("article", "main")) for t in self.tag])
        size, linked, links, title_in = self._sums(size), self._sums(linked), self._sums(self.links), self._sums(titled)
        first: dict[int, str] = {}
        for k, text, _, heading in self.blocks:
            first.setdefault(self.parent[k] if heading else k, text)
        inside = [False] * n
        self.dropped = dropped = [False] * n
        for k in range(1, n):
            up, tag = self.parent[k], self.tag[k]
            inside[k] = inside[up] or tag in ("article", "main")
            enclosing = articles[k] > (tag in ("article", "main")) or size[k] > 0.6 * max(size[0], 1)
            drop = self.hint[k] and (tag in _NEVER or not enclosing)
            if tag == "header" and inside[up] and not links[k]:
                drop = False  # the heading of the article itself
            # a discussion may be longer than the article
            if tag in _CONTAINERS and k in first and _COMMENTS.match(first[k]) and not title_in[k] and articles[k] == (tag in ("article", "main")):
                drop = True
            # lists of links
            if links[k] >= 3 and linked[k] > 0.6 * size[k] and not enclosing and tag not in _HEADINGS:
                drop = True
            dropped[k] = dropped[up] or drop
        good = [0] * n
        for k, text, in_links, _ in self.blocks:
            if not dropped[k] and 2 * in_links <= len(text):
                good[k] += len(text) - in_links
        self.good = self._sums(good)
        self.titles = self._sums([0 if d else t for t, d in zip(titled, dropped)])

    def container(self) -> int:
        """The innermost container that holds most of the plain text, with the page's title if that is beside it."""
        inner: dict[int, list[int]] = defaultdict(list)
        around = [0] * len(self.parent)
        for k in range(1, len(self.parent)):
            up = self.parent[k]
            around[k] = up if up == 0 or self.tag[up] in _CONTAINERS else around[up]
            if self.tag[k] in _CONTAINERS and not self.dropped[k]:
                inner[around[k]].append(k)
        at = 0
        while not self.stop[at] and at in inner:
            best = max(inner[at], key=lambda k: (self.good[k], -k))
            if self.good[best] < MOST * self.good[at] or not self.good[best]:
                break
            if self.titles[at] == 1 and not self.titles[best]:
                break
            at = best
        return at

    def compact(self) -> tuple[int, list[int], list[str], list[int], list[str]]:
        """Own container, then parents and paths of the elements around kept text, then element and text of each kept block."""
        own, used = self.container(), {0}
        kept = [(k, text) for k, text, _, _ in self.blocks if not self.dropped[k]]
        for k in [own, *(k for k, _ in kept)]:
            while k not in used:
                used.add(k)
                k = self.parent[k]
        order = sorted(used)
        place = {k: n for n, k in enumerate(order)}
        return (
            place[own], [place.get(self.parent[k], -1) for k in order], [self.path[k] for k in order], [place[k] for k, _ in kept], [t for _, t in kept],
        )


def _text_at(path: str, parents: list[int], paths: list[str], elements: list[int], texts: list[str]) -> str:
    """The blocks of all elements at this path."""
    chosen = [p == path for p in paths]
    for k in range(1, len(parents)):
        chosen[k] |= chosen[parents[k]]
    return " ".join(t for k, t in zip(elements, texts) if chosen[k])


def _agreed_text(own: int, parents: list[int], paths: list[str], elements: list[int], texts: list[str], agreed: list[dict] | tuple) -> str:
    tree = parents, paths, elements, texts
    wide = [found["path"] for found in agreed if found["pages"] >= AGREED]
    if paths[own] not in wide:
        for path in wide:
            if path in paths and (text := _text_at(path, *tree)):
                return text
    return _text_at(paths[own], *tree)


def main_text(source: str | None, agreed: list[dict] | tuple = ()) -> str:
    """Text of a page by its host's paths: its own choice if several pages share it, else the most voted one that the page has."""
    return _agreed_text(*Page(source).compact(), agreed) if source else ""


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page its id, address and ``host``, the compact tree of its kept text and ``good``, the plain characters of its own container."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, good = [], []
                for source in part.column(3):
                    page = Page(source.as_py() or "")
                    rows.append(page.compact())
                    good.append(page.good[page.container()])
                own, parents, paths, elements, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array(own, pa.int32()), pa.array(parents, pa.list_(pa.int32())), pa.array(paths, pa.list_(pa.string())),
                        pa.array(elements, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(good, pa.int64()),
                    ],
                    ["id", "url", "host", "own", "parents", "paths", "elements", "texts", "good"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    host = F.coalesce(url_host(F.col(url_col)), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(
        read,
        f"id {kinds[id_col]}, url {kinds[url_col]}, host string, own int, parents array<int>, paths array<string>, elements array<int>, texts array<string>, good bigint",
    )


def path_votes(trees: DataFrame) -> DataFrame:
    """(host, path, weight, pages): plain characters, up to ``VOTE`` a page, and pages behind each path."""
    return trees.filter("good > 0").groupBy("host", F.get("paths", F.col("own")).alias("path")).agg(
        F.sum(F.least("good", F.lit(VOTE))).alias("weight"), F.count(F.lit(1)).alias("pages")
    )


def host_paths(votes: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, pages, agreed): the paths with their share of the host's votes, the most voted first."""
    totals = votes.groupBy("host").agg(F.sum("weight").alias("_all"), F.sum("pages").alias("_pages"))
    kept = votes.join(totals, "host").filter(F.col("weight") >= least_share * F.col("_all"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "path", "pages")))
    return kept.groupBy("host").agg(F.max("_pages").alias("pages"), ordered.alias("agreed"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hot_hosts: int = HOT_HOSTS, least_share: float = LEAST_SHARE
) -> DataFrame:
    """Per page: its id, address, main ``text`` and ``n_chars``, its code points."""
    trees = stored(read_pages(pages, id_col, url_col, html_col))
    paths = stored(host_paths(path_votes(trees), least_share))
    paths = paths.withColumn("_all", paths.agg(F.sum("pages")).scalar())
    hot = paths.filter(F.col("pages") * hot_hosts >= F.col("_all")).select("host", "agreed")
    rest = paths.filter(F.col("pages") * hot_hosts < F.col("_all")).select("host", "agreed")
    # at most ``hot_hosts`` rows of few paths
    rows = trees.join(F.broadcast(hot), "host").unionByName(
        trees.join(F.broadcast(hot.select("host")), "host", "left_anti").join(rest, "host", "left"), allowMissingColumns=True
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = [part.column(c).to_pylist() for c in ("own", "parents", "paths", "elements", "texts", "agreed")]
                texts = [_agreed_text(*row[:5], row[5] or ()) for row in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return rows.select("id", "url", "own", "parents", "paths", "elements", "texts", "agreed").mapInArrow(
        choose, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint"
    )
